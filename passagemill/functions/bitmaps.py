"""Bitmaps of hashes of a fixed size: they let few rows without a partner through to a join, and every row with one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_words(at: DataFrame) -> DataFrame:
    """(place, word): the set bits of a bitmap in words of 64, from the bit numbers in column ``at``."""
    return at.distinct().groupBy(F.floor(F.col("at") / 64).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word"))


def bitmap_of(rows: DataFrame, number: Column, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with those of ``number`` set (a column of 0 .. bits - 1), put together by tasks.

    What comes to the driver is one word of 64 bits for each that holds a bit: 16 bytes x bits / 64 at most.
    """
    found = set_words(rows.select(number.cast("long").alias("at"))).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["place"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return out


def has_bit(bitmap: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether each number's bit is set."""
    n = number.astype(np.uint64)
    return (bitmap[(n >> np.uint64(6)).astype(np.int64)] >> (n & np.uint64(63))) & np.uint64(1) == 1
