"""A bounded bitmap of ids, which spares a join the rows that surely have no partner; the size of Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.bitmaps import bitmap_of, has_bit, set_words
from passagemill.sources.scratch import discard, materialize, shared_dir

__all__ = ["BITMAP_BITS", "bitmap_of", "bounded_batches", "discard", "has_bit", "materialize", "shared_dir", "split_by_bitmap", "with_id"]

#: Bits of a membership bitmap at most: 18 MB as a broadcast table, whatever the number of ids.
BITMAP_BITS = 1 << 27
#: Words of 64 bits in a row of that table.
_ROW = 64
#: Rows of an Arrow batch at most: what a task holds of a table at once, in the JVM and in its Python worker.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_id(docs: DataFrame, id_col: str, rest: str) -> T.StructType:
    """The schema of doc_id, of the type of ``id_col`` whatever that is (also a struct of a whole row), and of ``rest``."""
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(rest)])


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS at most in this session; a smaller number that is set already stays."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)


def split_by_bitmap(rows: DataFrame, key: str, ids: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key is probably among ids, and those whose key is surely not.

    One bit for each hash value; eight bits for each id until BITMAP_BITS, beyond which more of the others pass. It
    only spares a join the rows that surely have no partner: the join still decides. Tasks put the bits together; the
    table of the bitmap's rows is broadcast within that bound, and the test is part of the scan's own stage.
    """
    bits = max(64 * _ROW, min(BITMAP_BITS, 1 << max(1, 8 * ids.count() - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    own = uuid.uuid4().hex
    part, words = f"part_{own}", f"words_{own}"
    one = set_words(ids.select(place(F.col(col).cast("long")).alias("at")))
    found = one.groupBy(F.floor(F.col("place") / _ROW).alias(part)).agg(F.map_from_entries(F.collect_list(F.struct((F.col("place") % _ROW).cast("int").alias("i"), "word"))).alias("m"))  # _ROW entries at most
    table = materialize(found.select(part, F.transform(F.sequence(F.lit(0), F.lit(_ROW - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias(words)))
    bit = place(F.col(key).cast("long"))
    word = F.get(F.col(words), F.pmod(F.floor(bit / 64), F.lit(_ROW)).cast("int"))
    test = F.coalesce(F.call_function("getbit", word, (bit % 64).cast("int")) == 1, F.lit(False))
    marked = rows.join(F.broadcast(table), F.floor(bit / (64 * _ROW)) == F.col(part), "left")
    return marked.where(test).drop(part, words), marked.where(~test).drop(part, words)
