"""Operator 3: near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import SPACED_WORDS, gram_hashes, lean, mix, release, row_groups, text_rows, word_hashes
from .components import connected_components
from .shared import discard, materialize, split_by_bitmap

#: Words of a shingle.
WORDS = 5
#: Signature: 40 bands of 8. Two sets of similarity 0.85 share no band with probability (1 - 0.85^8)^40 = 3e-6.
BANDS, ROWS = 40, 8
#: Dimensions of the hashed universe on which both permutations act; sets near it look alike and are left to the exact check.
DIMENSIONS = 1 << 20
#: Cells of comparison hold about so many texts and shingles at most, of each of two blocks.
CELL_TEXTS, CELL_SHINGLES = 512, 1 << 21
#: Candidates of an estimated similarity this far under the threshold are let go: 4.5 standard deviations of the
#: estimate, so 3e-6 of the pairs at it.
MARGIN = 0.106


@lru_cache(maxsize=1)
def _circulant() -> np.ndarray:
    """Row p: the second permutation read from p on, for one signature; each coordinate shifts it by one."""
    order = np.random.default_rng(0x5EED).permutation(DIMENSIONS).astype(np.uint32)
    k = BANDS * ROWS
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: k - 1]]), k)


def _first_permutation(shingles: np.ndarray) -> np.ndarray:
    """Hash → place in the universe, permuted: odd factors and xor-shifts are bijections of its numbers."""
    mask = np.uint64(DIMENSIONS - 1)
    p = shingles & mask
    p = (p * np.uint64(2654435769) + np.uint64(40503)) & mask
    p ^= p >> np.uint64(11)
    p = (p * np.uint64(2246822519)) & mask
    return (p ^ (p >> np.uint64(13))).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash: the minimum over the set of the second permutation under each circular shift."""
    window, places = _circulant(), _first_permutation(shingles)
    out = np.full(BANDS * ROWS, DIMENSIONS, np.uint32)
    for lo in range(0, len(places), 2048):
        np.minimum(out, window[places[lo : lo + 2048]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys; the band's number is part of its key."""
    parts = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
    factors = mix(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)
    return mix((parts * factors).sum(axis=2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77)))


def shingle_sets(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each group of rows: its first row, and each row's sorted distinct shingle hashes."""
    data, at = text_rows(batch, column)
    for lo, hi in row_groups(at):
        words, first = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], SPACED_WORDS)
        grams = gram_hashes(words, WORDS)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                sets.append(np.unique(grams[a : b - WORDS + 1]))
            else:
                sets.append(gram_hashes(words[a:b], b - a) if b > a else words[:0])
        yield lo, sets


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one, two = mix(shingles ^ np.uint64(0x1234567)).sum(dtype=np.uint64), mix(shingles * np.uint64(3) + np.uint64(5)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, bands, signature): size, 128-bit digest, band keys and short signature of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch, "text"):
                prints = [_fingerprint(s) for s in sets]
                filled = np.array([len(s) > 0 for s in sets])
                whole = np.stack([signature(s) for s in sets if len(s)]) if filled.any() else np.empty((0, BANDS * ROWS), np.uint32)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * BANDS)]), pa.int32()), pa.array(band_keys(whole).view(np.int64).reshape(-1)))
                low = iter(short_signatures(whole))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[lo : lo + len(sets)],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        bands,
                        pa.array([next(low).tobytes() if f else None for f in filled.tolist()], pa.binary()),
                    ],
                    ["doc_id", "n", "f1", "f2", "bands", "signature"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n long, f1 long, f2 long, bands array<long>, signature binary")


def short_signatures(whole: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, four coordinates a byte: nearly as sharp an estimate in a sixteenth of the room."""
    low = (whole & np.uint32(3)).astype(np.uint8).reshape(len(whole), _BYTES, 4)
    return low[:, :, 0] | low[:, :, 1] << 2 | low[:, :, 2] << 4 | low[:, :, 3] << 6


_BYTES = BANDS * ROWS // 4
#: Equal pairs of bits by the exclusive or of two bytes.
_SAME = np.array([sum(x >> (2 * i) & 3 == 0 for i in range(4)) for x in range(256)], np.uint8)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of short signatures: a quarter of the coordinates that differ agree in two bits by chance."""
    return (_SAME[a ^ b].sum(axis=-1, dtype=np.int64) / (BANDS * ROWS) - 0.25) / 0.75


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, _BYTES)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose sizes and signatures don't rule a link out, with the size of b as n."""
    of = lambda c, x: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_signatures(batch.column(c).to_pylist()) for c in ("s0", "s1"))
            keep = _fits(np.asarray(batch.column("n0")), np.asarray(batch.column("n1")), percent) & (_alike(x, y) >= least)
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("a", "b", "n1")], ["a", "b", "n"])

    return pairs.join(of("b", 1), "b").join(of("a", 0), "a").select("a", "b", "n0", "n1", "s0", "s1").mapInArrow(lean(run), "a long, b long, n long")


def _cells(rows: DataFrame, group: str, member: str, across: bool) -> DataFrame:
    """rows(group, member, n, ...) with a ``cell`` each: of small groups many share one, a large one is cut into blocks.

    ``across``: every pair of blocks is a cell, so each member goes to as many cells as its group has blocks, and any
    two members meet; otherwise to one.
    """
    size = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    size = size.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.greatest(F.col("texts") / CELL_TEXTS, F.col("shingles") / CELL_SHINGLES))).cast("int"))
    total = rows.agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("s")).first()
    shared = max(1, int(max(total.t / CELL_TEXTS, (total.s or 0) / CELL_SHINGLES)))
    none = F.lit(-1).cast("long")
    cell = lambda g, i, j: F.struct(g.cast("long").alias("group"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    block = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: cell(F.col(group), F.least(k, block), F.greatest(k, block))) if across else F.array(cell(F.col(group), block, block))
    small = F.array(cell(none, F.pmod(F.xxhash64(group), F.lit(shared)), none))
    placed = rows.join(size.select("_group", "blocks"), F.col(group) == F.col("_group"))
    return placed.withColumn("cells", F.when(F.col("blocks") == 1, small).otherwise(own)).withColumn("block", block).drop("_group")


def _with_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(node, places array) with ``set``, the sorted shingle hashes of the class.

    A class is read from one of its documents: only texts that a bitmap of the wanted ids lets through are moved. A
    task gives a class once, so ids and texts that repeat without end don't add up.
    """
    asked = materialize(wanted.join(classes.select("node", "doc_id", "f1", "f2"), "node"))
    likely, _ = split_by_bitmap(docs, "doc_id", asked, "doc_id")
    texts = likely.join(asked, "doc_id")
    carried = ["node", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            prints = list(zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), strict=True))
            nodes = batch.column("node").to_pylist()
            for lo, sets in shingle_sets(batch, "text"):
                keep = []
                for i, s in enumerate(sets):
                    if nodes[lo + i] not in given and _fingerprint(s) == prints[lo + i]:
                        given.add(nodes[lo + i])
                        keep.append(i)
                if keep:
                    rows = pa.array([lo + i for i in keep])
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in carried] + [pa.array([sets[i].tobytes() for i in keep], pa.binary())], [*carried, "set"])

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in carried)
    return texts.select(*carried, "f1", "f2", "text").mapInArrow(lean(run), f"{kinds}, set binary")


def _star_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The links among pairs(a, b, n), verified on the full sets: a's set goes to each cell that holds some of its b."""
    placed = materialize(_cells(pairs, "a", "b", across=False).select("a", "b", F.col("cells")[0].alias("cell")))
    places = placed.select(F.col("b").alias("node"), "a", "cell").unionByName(placed.select(F.col("a").alias("node"), "a", "cell").distinct())
    wanted = places.groupBy("node").agg(F.collect_list(F.struct("a", "cell")).alias("places"))
    filled = _with_sets(docs, classes, wanted).select("node", "set", F.explode("places").alias("p")).select("node", "set", "p.a", "p.cell")

    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates(["a", "node"])
        sets = [np.frombuffer(s, np.uint64) for s in cell["set"]]
        heads = {a: i for i, (a, node) in enumerate(zip(cell["a"], cell["node"], strict=True)) if a == node}
        found = [(a, b) for i, (a, b) in enumerate(zip(cell["a"], cell["node"], strict=True)) if a != b and _linked(sets[heads[a]], sets[i], percent)]
        release()
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return filled.groupBy("cell").applyInPandas(verify, "a long, b long")


def _groups(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of each key's rows."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]]))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield order[lo:hi]


def _suspects(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(suspicion, node, component): members of a bucket that may be linked with one of another component in it.

    members(key, node, component, n). Signatures alone are compared, within cells; equal lists of nodes, as several
    bands give them, get the same number.
    """
    placed = _cells(members, "key", "node", across=True).select("key", "node", "component", "n", "block", F.explode("cells").alias("cell"))
    rows = placed.join(classes.select("node", "signature"), "node")
    least = percent / 100 - MARGIN

    def screen(cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        keys, node, component, n = (cell[c].to_numpy(np.int64) for c in ("key", "node", "component", "n"))
        low = _signatures(cell["signature"])
        for at in _groups(keys):
            seen = np.zeros(len(at), bool)
            for i in range(len(at) - 1):
                rest = at[i + 1 :]
                maybe = np.flatnonzero((component[rest] != component[at[i]]) & _fits(n[rest], n[at[i]], percent))
                maybe = maybe[_alike(low[rest[maybe]], low[at[i]]) >= least]
                seen[i] |= len(maybe) > 0
                seen[maybe + i + 1] = True
            if seen.any():
                some = at[seen]
                name = int(mix(np.sort(node[some]).view(np.uint64) + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64))
                out.append(pd.DataFrame({"suspicion": name, "node": node[some], "component": component[some], "n": n[some]}))
        release()
        return pd.concat(out) if out else pd.DataFrame({"suspicion": [], "node": [], "component": [], "n": []}, dtype=np.int64)

    return rows.groupBy("cell").applyInPandas(screen, "suspicion long, node long, component long, n long").distinct()


def _suspect_links(docs: DataFrame, classes: DataFrame, suspects: DataFrame, percent: int) -> DataFrame:
    """(a, b): components linked by some of the suspects, verified on the full sets; a forest for each suspicion."""
    total = suspects.agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("s")).first()
    cells = max(1, int(max(total.t / CELL_TEXTS, total.s / CELL_SHINGLES)))
    wanted = suspects.groupBy("node").agg(F.collect_list(F.struct("suspicion", "component")).alias("places"))
    filled = _with_sets(docs, classes, wanted).select("node", "set", F.explode("places").alias("p"))
    filled = filled.select("node", "set", "p.suspicion", "p.component", F.pmod(F.xxhash64("p.suspicion"), F.lit(cells)).alias("cell"))
    least = percent / 100 - MARGIN

    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        found = []
        cell = cell.drop_duplicates(["suspicion", "node"]).reset_index(drop=True)
        component = cell["component"].to_numpy(np.int64)
        for at in _groups(cell["suspicion"].to_numpy(np.int64)):
            sets = [np.frombuffer(s, np.uint64) for s in cell["set"].iloc[at]]
            found += _forest(sets, component[at], percent, least)
        release()
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return filled.groupBy("cell").applyInPandas(verify, "a long, b long")


def _forest(sets: list[np.ndarray], component: np.ndarray, percent: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different components, as pairs of these; the likeliest first."""
    low, n = short_signatures(np.stack([signature(s) for s in sets])), np.array([len(s) for s in sets])
    first, second, like = [], [], []
    for i in range(len(sets) - 1):
        maybe = i + 1 + np.flatnonzero((component[i + 1 :] != component[i]) & _fits(n[i + 1 :], n[i], percent))
        value = _alike(low[maybe], low[i])
        keep = value >= least
        first.append(np.full(int(keep.sum()), i))
        second.append(maybe[keep])
        like.append(value[keep])
    root = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = []
    if first:
        first, second = np.concatenate(first), np.concatenate(second)
        order = np.argsort(-np.concatenate(like), kind="stable")
        for i, j in zip(first[order].tolist(), second[order].tolist(), strict=True):
            x, y = top(int(component[i])), top(int(component[j]))
            if x != y and _linked(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                found.append((int(component[i]), int(component[j])))
    return found


def _of_one_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that hold rows of the same id, which are one document."""
    print_ = F.struct("f1", "f2")
    several = known.groupBy("doc_id").agg(F.min(print_).alias("x"), F.max(print_).alias("y")).where("x <> y").select("doc_id")
    node = known.join(several, "doc_id").select("doc_id", "f1", "f2").distinct().join(classes.select("node", "f1", "f2"), ["f1", "f2"])
    heads = node.groupBy("doc_id").agg(F.min("node").alias("a"))
    return node.join(heads, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    1. One sketch per row: set size, digest, 40 band keys, signature (written once to the shared folder). Rows of
       equal sets are one class, named by one of its rows, so exact copies never meet in a bucket.
    2. Every class is compared with the first one of each of its buckets: by signature, then exactly. A group of near
       copies of one text is joined up by that, with work in proportion to its size.
    3. What is left are buckets that hold several components. Signatures of those are compared across components, in
       cells of bounded size; only classes with a likely partner go on.
    4. Those are verified exactly, the likeliest pair first, until their components are joined or all are refused.

    The quadratic part is step 3 on buckets of texts that share much but are not linked; no set moves for it.

    Null and empty texts and texts without words: empty set, linked with nothing, kept. Fewer than five words: the
    whole sequence is the one shingle. Rows of one id are one document: each is returned with its own size, and what
    is linked with one of them is linked with all. Rows without id get no component and are kept. Columns of docs
    besides the two named are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialize(_sketches(docs).withColumn("row", F.monotonically_increasing_id()))
    known = sketch.where("n > 0 and doc_id is not null")
    # equal digests have equal bands and signatures, so whichever row's meet first will do
    same = [F.first(c).alias(c) for c in ("n", "bands", "signature")]
    classes = materialize(known.groupBy("f1", "f2").agg(F.min(F.struct("row", "doc_id")).alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"), *same).select("f1", "f2", F.col("rep.row").alias("node"), "rep.doc_id", "least_id", "rows", "n", "bands", "signature"))
    docs = docs.where("doc_id is not null")
    bands = classes.select("node", F.explode("bands").alias("key"))
    heads = bands.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialize(bands.join(heads, "key").select("key", "node", "head", "size"))
    stars = buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    likely = materialize(_likely(stars, classes, percent))
    joined = connected_components(_star_links(docs, classes, likely, percent).unionByName(_of_one_id(known, classes)))
    component: Column = F.coalesce("component", "node").alias("component")
    # two members have been compared already
    members = buckets.where("size > 2").join(joined, "node", "left").select("key", "node", component)
    mixed = members.groupBy(F.col("key").alias("mixed")).agg((F.min("component") < F.max("component")).alias("several")).where("several").select("mixed")
    members = materialize(members.join(mixed, F.col("key") == F.col("mixed"), "left_semi").join(classes.select("node", "n"), "node"))
    suspects = materialize(_suspects(members, classes, percent))
    if suspects.limit(1).count():
        later = materialize(_suspect_links(docs, classes, suspects, percent))
        merged = connected_components(later).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        alone = later.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
        every = joined.unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
        joined = materialize(every.join(merged, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component")))
    discard(buckets, likely, members, suspects)
    linked = joined.join(classes.select("node", "least_id"), "node")
    ids = linked.groupBy("component").agg(F.min("least_id").alias("found"))
    linked = linked.join(ids, "component").select("node", "found")
    named = classes.select("node", "f1", "f2", "least_id", "rows").join(linked, "node", "left").where("rows > 1 or found is not null").select("f1", "f2", F.coalesce("found", "least_id").alias("found"))
    every = sketch.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2")
    placed = every.where("n_shingles > 0").join(named, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    empty = every.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
