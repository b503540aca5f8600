"""Fixed folds by the checksum of an id."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of a null id as of an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
