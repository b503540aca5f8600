"""Operator 9: toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import lean, row_groups, text_rows
from .shared import bitmap_of, discard, has_bit, materialize, with_id

#: About so many labelled rows of either class are learned from (the documented bound of the sample).
ROWS_PER_CLASS = 20_000
#: Entries of the lexicon and of the exception list at most, letters of a stem, and rows that must hold an entry.
ENTRIES, STEMS, SUPPORT = 2048, (4, 5, 6, 7), 6
#: Letters of the longest word that is a candidate; longer ones are no words. Bits of the bitmap of candidates (2 MB).
LONGEST, BITS = 40, 1 << 24
#: A term enters the lexicon if toxic rows hold it so many times as often as other rows, even after shrinking.
ODDS = 12.0
# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = "аaвbеeкkмmнhоoрpсcтtуyхxіiјjѕsԁdɡgԛqԝwһhӏlѵvɑaıiʟlɴnʀrƖlαaβbεeιiκkνvοoρpτtυuχxηnωwγyսuոnօoցgհhաw"
SUBSTITUTES = "0o1i3e4a5s7t8b9g@a$s!i|l+t"


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point → folded code point; a space for what is no letter. Accents stay: they tell words apart."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            plain = unicodedata.normalize("NFKC", ch).lower()
            out[c] = ord(plain) if len(plain) == 1 else c
    for pairs in (HOMOGLYPHS, SUBSTITUTES):
        for a, b in zip(pairs[::2], pairs[1::2], strict=True):
            out[ord(a)] = ord(b)
            if a.upper() != a and len(a.upper()) == 1:
                out[ord(a.upper())] = ord(b)
    return out


def folded_rows(data: np.ndarray, at: np.ndarray) -> list[str]:
    """Each text with look-alikes folded, one space for each other character, and a space at either end.

    Signs and digits that stand for letters are folded inside words only: a run of them between spaces is no word.
    """
    text = data.tobytes().decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = np.cumsum(1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF))
    rows = np.append(np.searchsorted(width, at[:-1], "right"), len(cp)) if len(cp) else np.zeros(len(at), np.int64)
    low = _folding()[cp]
    letter = _letter_mask()[cp]
    stand_in = ~letter & (low != 0x20)
    if stand_in.any():
        before, after = np.zeros(len(cp), bool), np.zeros(len(cp), bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        digit = (cp >= 0x30) & (cp <= 0x39)
        low = np.where(stand_in & ~((after & (before | digit | (cp == 0x40) | (cp == 0x24))) | (before & digit)), 0x20, low)
    whole = low.astype("<u4").tobytes().decode("utf-32-le")
    return [f" {whole[a:b]} " for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def _letter_mask() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def _terms(text: str) -> set[str]:
    """Candidates of a folded text: its words, and their beginnings as open stems."""
    words = {w for w in text.split() if len(w) <= LONGEST}
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _pairs(text: str, hits: set[str]) -> set[str]:
    """Two-word phrases with a word that an entry matches: whole, or by one of its stems."""
    words = [w if len(w) <= LONGEST else "" for w in text.split()]
    hot = {w for w in set(words) if f" {w} " in hits or any(f" {w[:k]}" in hits for k in STEMS)}
    return {f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if a and b and (a in hot or b in hot)} if hot else set()


class Lexicon:
    """Weights of terms, exception phrases, and the calibration of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], calibration: tuple[float, ...]) -> None:
        self.weights, self.exceptions, self.calibration = weights, exceptions, calibration
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.calibration

    def __setstate__(self, state):
        self.__init__(*state)

    def matcher(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                made.add_word(phrase, (len(phrase), 0.0))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def features(self, text: str) -> tuple[float, float, float]:
        """Weight of the matches for each hundred words, its total (log), and the number of different terms (log)."""
        automaton = self.matcher()
        words = max(1, text.count(" ") - 1)
        if not len(automaton):
            return 0.0, 0.0, 0.0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        kinds = set()
        for end, (length, weight) in automaton.iter(text):
            start = end - length + 1
            if weight:
                if weight > best.get(start, 0.0):
                    best[start] = weight
                kinds.add((length, weight))
            else:
                excused.append((start, end))
        for a, b in excused:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        total = sum(best.values())
        return total * 100 / (words + 20), float(np.log1p(total)), float(np.log1p(len(kinds) if best else 0))

    def scores(self, features: np.ndarray) -> np.ndarray:
        *w, bias = self.calibration
        return 1 / (1 + np.exp(-np.clip(features @ np.array(w) + bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression of weighted rows by Newton steps with a small ridge; the last value is the intercept."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-4])
    weight = weight * len(weight) / weight.sum()  # else the ridge would depend on the share that was drawn
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x1 + ridge, x1.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w)


def _row_counts(rows: DataFrame, make) -> DataFrame:
    """(term, n): in how many rows make(folded text) holds a term; counted in tasks, summed after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            data, at = text_rows(batch, "text")
            for lo, hi in row_groups(at, 1 << 20):
                for text in folded_rows(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                    count.update(make(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    return rows.select("text").mapInArrow(lean(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _place(term: str) -> int:
    return zlib.crc32(term.encode()) % BITS


def _of_both(rows: DataFrame, make, frequent_in: int, least: int) -> DataFrame:
    """(term, toxic, other): terms of at least ``least`` rows of one class, with their counts in both.

    The other class counts only what a bitmap of those terms lets through, and a join tells the rest apart.
    """
    own = materialize(_row_counts(rows.where(F.col("toxic") == frequent_in), make).where(F.col("n") >= least))
    asked = rows.sparkSession.sparkContext.broadcast(bitmap_of(own, F.crc32(F.col("term").cast("binary")) % BITS, BITS))

    def likely(text: str) -> list[str]:
        found = list(make(text))
        keep = has_bit(asked.value, np.array([_place(t) for t in found], np.int64))
        return [t for t, k in zip(found, keep.tolist(), strict=True) if k]

    rest = _row_counts(rows.where(F.col("toxic") == 1 - frequent_in), likely)
    both = own.join(rest.withColumnRenamed("n", "m"), "term", "left").na.fill(0, ["m"])
    return both.select("term", *(F.col("n" if frequent_in == k else "m").alias(name) for k, name in ((1, "toxic"), (0, "other"))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Lexicon:
    """A lexicon from labelled rows: terms far more frequent in toxic rows, weighted by shrunken log odds.

    About ``rows_per_class`` rows of either class are used, chosen by id hash, so their ids are few enough to broadcast;
    each stands for as many labelled rows of its class as were left out. Terms are whole words of up to LONGEST letters
    and open stems; a term is left out if a shorter entry covers it. Two-word phrases that hold an entry and occur in rows that are
    not toxic become exceptions. The score is a logistic fit on three length-normalised features. Rows without label
    or text are not used; with one class only, the score is constant 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    share = known.groupBy(F.col("toxic").alias("class")).agg(F.least(F.lit(1.0), F.lit(float(rows_per_class)) / F.count(F.lit(1))).alias("share"))
    drawn = known.join(share, known.toxic == share["class"]).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("id", "toxic", (1 / F.col("share")).alias("weight"))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("text", "toxic", "weight"))
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Lexicon({}, [], (0.0, 0.0, 0.0, -30.0))
    n1, n0 = size[1], size[0]
    odds = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("other") + 0.5) / (n0 + 1))
    strong = _of_both(rows, _terms, 1, SUPPORT).withColumn("odds", odds).where(F.col("odds") >= ODDS)
    found = strong.orderBy(F.desc(F.col("toxic") * F.log("odds")), "term").limit(ENTRIES).collect()
    weights: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r.term), r.term)):
        if not any(r.term[:k] in weights for k in range(2, len(r.term))):
            weights[r.term] = float(np.log(r.odds))
    hits = set(weights)
    phrases = _of_both(rows, lambda text: _pairs(text, hits), 0, 3).where(F.col("toxic") * n0 < F.col("other") * n1).orderBy(F.desc("other"), "term").limit(ENTRIES)
    lexicon = Lexicon(weights, [r.term for r in phrases.collect()], (0.0, 0.0, 0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_rows(batch, "text")
            for lo, hi in row_groups(at, 1 << 20):
                x = np.array([shared.value.features(t) for t in folded_rows(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), batch.column("toxic")[lo:hi], batch.column("weight")[lo:hi]], ["a", "b", "c", "toxic", "weight"])

    fit = rows.mapInArrow(lean(measure), "a double, b double, c double, toxic int, weight double").toPandas()  # within the bound of the sample
    # rows of either class count as often as they do among all labelled rows
    lexicon.calibration = _logistic(fit[["a", "b", "c"]].to_numpy(), fit["toxic"].to_numpy(float), fit["weight"].to_numpy())
    discard(rows)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs; a null or empty text has no match and gets the base score.

    Repeated rows and null ids: one result row each. Long texts are matched whole. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_rows(batch, text_col)
            for lo, hi in row_groups(at, 1 << 20):
                x = np.array([shared.value.features(t) for t in folded_rows(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])])
                p = shared.value.scores(x)
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[lo:hi], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), with_id(docs, id_col, "score double, predicted int"))
