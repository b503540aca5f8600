"""Operator 7: language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import lean, row_groups, text_rows
from .shared import with_id

#: Components of a vector, and letters of an n-gram.
DIMENSIONS, GRAM = 1024, 3
#: About so many labelled rows of each language are learned from (the documented bound of the sample).
ROWS_PER_LANGUAGE = 20_000
#: Languages at most: each has one prototype of DIMENSIONS numbers, and all prototypes are broadcast.
LANGUAGES = 10_000
UNKNOWN = "und"
_BLOCK = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point → its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each letter (0 is the word border), drawn from the letter's own seed."""
    return np.stack([np.random.default_rng(int(c) + 1).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1 for c in letters.tolist()])


_vectors: dict[int, np.ndarray] = {}


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Each n-gram bound from its letters: the first one permuted (rotated) twice, the second once, multiplied."""
    shift = np.uint64(21)
    parts = [(grams >> (shift * np.uint64(GRAM - 1 - k))) & np.uint64((1 << 21) - 1) for k in range(GRAM)]
    if len(_vectors) > 1 << 14:
        _vectors.clear()
    out = None
    for k, part in enumerate(parts):
        some, back = np.unique(part, return_inverse=True)
        new = [c for c in some.tolist() if c not in _vectors]
        if new:
            _vectors.update(zip(new, letter_vectors(np.array(new)), strict=True))
        table = np.roll(np.stack([_vectors[c] for c in some.tolist()]), GRAM - 1 - k, axis=1)
        out = table[back] if out is None else out * table[back]
    return out.astype(np.float32)


def _bundles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the sum of its n-gram vectors, its number of letters, and that of its distinct n-grams."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    width = np.cumsum(1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF))
    rows = np.searchsorted(width, at[:-1], "right") if len(cp) else np.zeros(len(at) - 1, np.int64)
    rows = np.append(rows, len(cp))
    letter = _letters()[cp].astype(np.uint64)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(rows))
    n_letters = np.bincount(row_of[letter > 0], minlength=len(at) - 1)
    # border before every row; runs of other characters become one border
    text = np.insert(letter, rows[:-1], 0)
    owner = np.insert(row_of, rows[:-1], np.arange(len(at) - 1))
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] > 0) | (text[:-1] > 0) | (owner[1:] != owner[:-1])
    text, owner = text[keep], owner[keep]
    out, n_grams = np.zeros((len(at) - 1, DIMENSIONS), np.float32), np.zeros(len(at) - 1, np.int64)
    if len(text) < GRAM:
        return out, n_letters, n_grams
    grams = text[:-2] << np.uint64(42) | text[1:-1] << np.uint64(21) | text[2:]
    own = (owner[:-2] == owner[2:]) & (text[1:-1] > 0)
    grams, owner = grams[own], owner[:-2][own]
    keys, back = np.unique(grams, return_inverse=True)
    for lo in range(0, len(keys), _BLOCK):
        here = (back >= lo) & (back < lo + _BLOCK)
        vectors = _gram_vectors(keys[lo : lo + _BLOCK])
        for r in range(0, len(at) - 1, 512):
            some = here & (owner >= r) & (owner < r + 512)
            n = min(512, len(at) - 1 - r)
            counts = np.bincount((owner[some] - r) * len(vectors) + back[some] - lo, minlength=n * len(vectors)).reshape(n, -1)
            out[r : r + n] += counts.astype(np.float32) @ vectors
            n_grams[r : r + n] += (counts > 0).sum(axis=1)
    return out, n_letters, n_grams


def profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, vector): the sum of the normalised text vectors of each language.

    Tasks sum their own rows, so what is shuffled is one vector for each language and batch group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, at = text_rows(batch, text_col)
            names = batch.column(lang_col).to_pylist()
            for lo, hi in row_groups(at, 1 << 19):
                vectors, _, _ = _bundles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors /= np.where(norm == 0, 1, norm)
                for name in set(names[lo:hi]):
                    mine = vectors[[n == name for n in names[lo:hi]]].sum(axis=0, dtype=np.float64)
                    total[name] = total[name] + mine if name in total else mine
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([list(range(DIMENSIONS))] * len(total), pa.list_(pa.int32())), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "place", "value"])

    parts = labelled.select(lang_col, text_col).mapInArrow(lean(run), "lang string, place array<int>, value array<double>")
    cells = parts.select("lang", F.explode(F.arrays_zip("place", "value")).alias("cell")).groupBy("lang", "cell.place").agg(F.sum("cell.value").alias("value"))
    return cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda c: c["value"]).alias("vector"))


def learn(labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from a sample of about ``rows_per_language`` rows of each, chosen by id hash, without id by the text's.

    The share to draw of each language is one row of a table that is broadcast, so that no text is shuffled; more than
    LANGUAGES of them are an error.
    """
    known = labelled.where(F.col(lang_col).isNotNull())
    share = known.groupBy(F.col(lang_col).alias("name")).agg(F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.count(F.lit(1))).alias("share"))
    listed = share.limit(LANGUAGES + 1).collect()
    if len(listed) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = F.broadcast(labelled.sparkSession.createDataFrame(listed, "name string, share double"))
    sample = known.where(F.col(text_col).isNotNull()).join(share, F.col(lang_col) == F.col("name")).where(F.pmod(F.xxhash64(id_col, F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    rows = profiles(sample, lang_col, text_col).orderBy("lang").toArrow()  # one row for each language
    return rows["lang"].to_pylist(), rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = (), named_col: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, n_letters, n_grams, *carried) for every row: the language of the nearest prototype and its cosine, at least 0;
    its letters and distinct n-grams.

    Null and empty texts and texts without a letter: ``und`` with score 0; so for every text if nothing was learned.
    ``carried`` columns are handed on and play no part; nor does ``named_col``, whose language's cosine is ``named_score``, the last column (null if
    it was not learned). Ties go to the first language in string order. Long texts are bundled whole, in blocks of n-grams.
    """
    names, prototypes = model
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((names, (prototypes / np.where(norm == 0, 1, norm)).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, unit = shared.value
        place = {name: k for k, name in enumerate(langs)}
        for batch in batches:
            data, at = text_rows(batch, 1)
            for lo, hi in row_groups(at, 1 << 19):
                vectors, letters, grams = _bundles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                size = np.linalg.norm(vectors, axis=1)
                cosine = (vectors @ unit.T) / np.where(size == 0, 1, size)[:, None] if langs else np.zeros((hi - lo, 1))
                best = cosine.argmax(axis=1)
                unknown = (letters == 0) | (not langs)
                score = np.where(unknown, 0.0, np.clip(cosine[np.arange(hi - lo), best], 0, 1)).astype(np.float64)
                pred = [UNKNOWN if u else langs[k] for u, k in zip(unknown.tolist(), best.tolist(), strict=True)]
                columns = [batch.column(0)[lo:hi], pa.array(pred, pa.string()), pa.array(score), pa.array(letters.astype(np.int64)), pa.array(grams), *(batch.column(2 + i)[lo:hi] for i in range(len(carried)))]
                if named_col:
                    own = [place.get(name) for name in batch.column(2 + len(carried))[lo:hi].to_pylist()]
                    columns.append(pa.array([None if k is None else float(np.clip(cosine[r, k], 0, 1)) for r, k in enumerate(own)], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = with_id(docs, id_col, "lang_pred string, score double, n_letters long, n_grams long")
    for c in carried:
        schema.add(c, docs.schema[c].dataType)
    if named_col:
        schema.add("named_score", "double")
    more = [F.col(named_col).cast("string").alias("named_score")] if named_col else []
    return docs.select(id_col, text_col, *carried, *more).mapInArrow(lean(run), schema)
