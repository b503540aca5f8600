"""Vector expressions on arrays of doubles. [H3 H4 A14]"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import features


def hash_counts(text: Column, dimensions: int = 32) -> Column:
    """Signed feature counts: sha256 of a feature gives its place (first 4 bytes) and sign (bit 0 of byte 5)."""

    def place(f: Column) -> Column:
        digest = F.sha2(f, 256)
        at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions
        sign = F.when(F.conv(F.substring(digest, 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
        return F.struct(at.alias("at"), sign.alias("sign"))

    # each feature is placed once: the fold's input is evaluated before its steps
    add = lambda s, p: F.transform(s, lambda x, i: F.when(i == p["at"], x + p["sign"]).otherwise(x))
    return F.aggregate(F.transform(features(text), place), F.array_repeat(F.lit(0.0), dimensions), add)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column, dimensions: int | Column | None = None) -> Column:
    """Vector of length 1; a zero vector stays. The length is worked out once, not for each component."""
    size = F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    count = F.size(a) if dimensions is None else F.lit(dimensions)
    return F.zip_with(a, F.array_repeat(size, count), lambda x, n: F.when(n == 0, x).otherwise(x / n))


def hash_embedding(text: Column, dimensions: int = 32) -> Column:
    """L2-normalised signed feature counts. [H3]"""
    return normalized(hash_counts(text, dimensions), dimensions)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for a zero vector; vectors of different length are an error. [H4]"""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension"))).otherwise(dot(a, b))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(checked / size)


_WORDS, _RUNS = re.compile("[a-z0-9_]+"), re.compile("[一-鿿]+")
_places: dict[tuple[str, int], tuple[int, int]] = {}


def _place(feature: str, dimensions: int) -> tuple[int, int]:
    """Place and sign of a feature, kept by the worker."""
    found = _places.get((feature, dimensions))
    if found is None:
        if len(_places) > 1 << 18:
            _places.clear()
        digest = hashlib.sha256(feature.encode()).digest()
        found = _places[feature, dimensions] = int.from_bytes(digest[:4], "big") % dimensions, 1 if digest[4] & 1 else -1
    return found


def hashed_texts(rows: DataFrame, key: str, text: str = "text", dimensions: int = 32) -> DataFrame:
    """(key, vector): ``hash_counts`` of each text, by batches in tasks; the faster form for many texts. [H3]"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(batch), dimensions))
            for row, t in zip(out, batch.column(text).to_pylist(), strict=True):
                low = (t or "").lower()
                found = _WORDS.findall(low)
                for run_ in _RUNS.findall(low):
                    found += [*run_, *(run_[i : i + 2] for i in range(len(run_) - 1))]
                for f in found or [low]:
                    at, sign = _place(f, dimensions)
                    row[at] += sign
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dimensions, pa.int32()), pa.array(out.reshape(-1)))], [key, "vector"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")
