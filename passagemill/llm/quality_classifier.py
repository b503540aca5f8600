"""Operator 4: quality scores by Bradley-Terry ranking on text features."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import row_groups, text_rows
from .shared import materialize

#: About so many labelled rows of either class are learned from, and preference pairs drawn for each (documented bounds).
ROWS_PER_CLASS, PAIRS = 20_000, 200_000
#: A row is good from this score on.
THRESHOLD = 0.7
_SIGNS = [c.encode() for c in "#*$%&|<>!?.,;:(){}[]\"'_=+/@~^-"]
_UPPER, _DIGIT = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))


def features(raw: bytes) -> list[float]:
    """Length-free features of a text: rates of signs, capitals and digits, repetition of words and lines, shape."""
    n = max(1, len(raw))
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    signs = [math.sqrt(raw.count(s) / w) for s in _SIGNS]
    upper = n - len(raw.translate(None, _UPPER))
    digits = n - len(raw.translate(None, _DIGIT))
    same = sum(map(operator.eq, words, words[1:])) / w
    lag2 = sum(map(operator.eq, words, words[2:])) / w
    kinds = len(set(words)) / w
    spread = math.log1p(len(set(words))) / math.log1p(w) if words else 1.0
    marked = sum(x[-1] in b"#*$%&|<>!" for x in words) / w
    return [
        *signs, math.sqrt(upper / n), math.sqrt(digits / n), math.sqrt(same), math.sqrt(lag2), kinds, spread, math.sqrt(marked),
        math.log1p(len(words)), min(20.0, n / w) / 10, 1 - len(set(lines)) / k, math.log1p(w / k), float(not words),
    ]


N_FEATURES = len(features(b""))


class Ranker:
    """Standardised features, weights of the Bradley-Terry scores, the chosen quantile and the spread of the scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, spread: float) -> None:
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the cut among the raw scores falls on THRESHOLD."""
        z = (self.raw(x) - self.cut) / self.spread + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features_of(rows: DataFrame, carried: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_rows(batch, "text")
            raw = data.tobytes()
            x = np.array([features(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(list(x), pa.list_(pa.float64()))], [*carried, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.select(*carried, "text").mapInArrow(run, f"{kinds}, x array<double>")


def fit_bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, rounds: int = 300) -> np.ndarray:
    """Weights w that make sigmoid(w · (good - bad)) large over drawn preference pairs: logistic loss with a ridge.

    Pairs are drawn by a fixed seed; every row of ``bad`` takes part.
    """
    rng = np.random.default_rng(7)
    n = min(pairs, max(len(good), len(bad)) * 20)
    diff = good[rng.integers(0, len(good), n)] - bad[np.resize(rng.permutation(len(bad)), n)]
    w = np.zeros(diff.shape[1])
    ridge = 1e-3
    for _ in range(min(rounds, 40)):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (p - 1) / n + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def best_quantile(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The share of all labelled rows that lies below the cut at which the fewest of them are on the wrong side."""
    order = np.argsort(raw, kind="stable")
    y, weight = y[order], weight[order]
    lost = np.concatenate([[0.0], np.cumsum(np.where(y == 1, weight, 0.0))])
    passed = np.concatenate([np.cumsum(np.where(y == 0, weight, 0.0)[::-1])[::-1], [0.0]])
    return float(np.concatenate([[0.0], np.cumsum(weight)])[np.argmin(lost + passed)] / weight.sum())


def weighted_quantile(raw: np.ndarray, weight: np.ndarray, share: float) -> float:
    """A value that ``share`` of the weight lies below: halfway between the values on either side."""
    order = np.argsort(raw, kind="stable")
    upto = np.cumsum(weight[order]) / weight.sum()
    k = int(np.searchsorted(upto, share - 1e-12, "left")) + 1 if share > 1e-12 else 0
    if k == 0 or k >= len(raw):
        return float(raw[order[0]] - 1e-9 if k == 0 else raw[order[-1]] + 1e-9)
    return float((raw[order[k - 1]] + raw[order[k]]) / 2)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> Ranker:
    """A ranker from labelled rows: about ``rows_per_class`` of either class, chosen by id hash, so their ids are few enough to broadcast.

    Every row labelled 1 is preferred to every row labelled 0; pairs of them are drawn. The cut is a quantile of the
    scores of labelled rows, each weighted by how many of them it was drawn for: the share at which they are divided
    best. Rows without label
    are not used; with one class only, every score is that class's.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    share = known.groupBy(F.col("y").alias("class")).agg(F.least(F.lit(1.0), F.lit(float(rows_per_class)) / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"))
    drawn = known.join(share, known.y == share["class"]).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("id", "y", "share")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("text", "y", "share")
    sample = materialize(_features_of(rows, ["y", "share"])).toPandas()  # within the bound of the sample
    x = np.array(sample["x"].to_list()).reshape(-1, N_FEATURES)
    y, weight = sample["y"].to_numpy(), 1 / sample["share"].to_numpy()
    if len(set(y.tolist())) < 2:
        always = bool(y[0]) if len(y) else True
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -1.0 if always else 1.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    weights = fit_bradley_terry(z[y == 1], z[y == 0])
    raw = z @ weights
    cut = weighted_quantile(raw, weight, best_quantile(raw, y, weight))
    return Ranker(mean, scale, weights, cut, max(1e-6, float(raw.std()) / 2))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; a null or empty text is scored as a text without words.

    Repeated rows and null ids: one result row each. Long texts are read whole. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_rows(batch, text_col)
            for lo, hi in row_groups(at):
                raw, cut = data[at[lo] : at[hi]].tobytes(), (at[lo : hi + 1] - at[lo]).tolist()
                p = shared.value.scores(np.array([features(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[lo:hi], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
