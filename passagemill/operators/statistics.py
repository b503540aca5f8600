"""Resampling, rater agreement and regression gates over evaluation tables. [D17 D18 S1-S8]"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.draws import hashed_slots
from passagemill.sources.scratch import materialize


def pairs_of(long: DataFrame, reference: str) -> DataFrame:
    """(config, metric, example_id, ref, value): rows of each config beside those of the reference. [C10 S3]

    long(config, example_id, metric, value). An unknown reference is an error.
    """
    known = long.where("value is not null")
    base = known.where(F.col("config") == reference).select("example_id", "metric", F.col("value").alias("ref"))
    if base.isEmpty():
        raise ValueError(f"no rows of the reference {reference!r}")
    return known.where(F.col("config") != reference).join(base, ["example_id", "metric"]).select("config", "metric", "example_id", "ref", "value")


def _draw(seed: int, iteration: Column, slot: Column, n: Column) -> Column:
    """A place in 0..n-1 by hash, the same in any engine: first 8 hex digits of an md5."""
    text = F.concat_ws("-", F.lit(str(seed)), iteration.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def _slots(rows: DataFrame, iterations: int, *keys: str) -> DataFrame:
    """rows(keys, n) with a row for each iteration ``it`` and each ``slot`` of 0 .. n - 1; no row lists more than a block."""
    block = 1 << 12
    each = rows.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).repartition(*keys, "it")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block) * block, F.lit(block).cast("long"))).alias("_first")
    return each.select("*", first).select("*", F.explode(F.sequence(F.col("_first"), F.least(F.col("n"), F.col("_first") + block) - 1)).alias("slot")).drop("_first")


#: Differences are added as whole numbers of this, so that their order can't change a sum.
_UNIT = 1e12


def paired_bootstrap(pairs: DataFrame, iterations: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """(config, metric, n, delta, low, high, step_pp, verdict): percentile interval of the mean difference. [S1 S2 S3]

    pairs(config, metric, example_id, ref, value). Examples of a (config, metric) get places in example order. Draws
    are rows of (n, iteration, slot), made once for each number of examples, and lead to differences by an equi-join
    on the place; sums combine in tasks. No row holds all examples.
    """
    own = Window.partitionBy("config", "metric")
    d = pairs.select("config", "metric", F.round((F.col("value") - F.col("ref")) * _UNIT).cast("long").alias("d"), (F.row_number().over(own.orderBy("example_id")) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(own).alias("n"))
    drawn = _slots(d.select("n").distinct(), iterations, "n").select("n", "it", _draw(seed, F.col("it"), F.col("slot"), F.col("n")).alias("place"))
    sums = drawn.join(d, ["n", "place"]).groupBy("config", "metric", "n", "it").agg((F.sum("d") / _UNIT).alias("total"))
    means = sums.groupBy("config", "metric", "n").agg(F.array_sort(F.collect_list(F.round(F.col("total") / F.col("n"), 9))).alias("m"))  # one value for each iteration
    deltas = d.groupBy("config", "metric").agg((F.sum("d") / _UNIT / F.count(F.lit(1))).alias("delta"))
    return _interval(means.join(deltas, ["config", "metric"]), iterations, confidence)


#: Distinct differences that a task draws for, about, and iterations that it draws at once.
CELLS, ITERATIONS = 1 << 12, 1 << 8


def draws_of_block(sizes: np.ndarray, block: int, iterations: int, seed: int) -> np.ndarray:
    """How many of the n = sum(sizes) draws of each iteration fall into one block.

    Draws are split between halves of the blocks by a binomial law, down to the block. A split has its own seed, so
    every block sees the same one, and the draws of all blocks add up to n without any of them knowing the others'.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high, n = 0, len(sizes), np.full(iterations, upto[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (upto[middle] - upto[low]) / max(1, upto[high] - upto[low])
        left = np.random.default_rng([seed, low, high]).binomial(n, share)
        n, low, high = (left, low, middle) if block < middle else (n - left, middle, high)
    return n


def cell_bootstrap(pairs: DataFrame, iterations: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """As ``paired_bootstrap``, at a cost that follows the distinct differences instead of iterations x examples. [S1 S2 S3]

    Equal differences of a (config, metric) are one cell with a count, summed in tasks; drawing n examples with
    replacement is drawing the cells' numbers from one multinomial law, which is exact. Cells are dealt into blocks of
    about CELLS; a block gets its share of the draws by ``draws_of_block`` and draws its cells by itself, with the seed
    of its place, so that metrics with equal cells see equal draws. Sums of blocks meet for each iteration. The draws
    are numpy's and not those of ``paired_bootstrap``.
    """
    d = F.round((F.col("value") - F.col("ref")) * _UNIT).cast("long").alias("d")
    cells = materialize(pairs.select("config", "metric", d).groupBy("config", "metric", "d").agg(F.count(F.lit(1)).alias("n")))
    series = cells.groupBy("config", "metric").agg(F.ceil(F.count(F.lit(1)) / CELLS).cast("long").alias("blocks"))
    dealt = cells.join(F.broadcast(series), ["config", "metric"]).withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))  # a row for each config and metric
    sizes = dealt.groupBy("config", "metric", "blocks", "block").agg(F.sum("n").alias("size"))
    listed = sizes.groupBy("config", "metric").agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("sizes"))  # a number for each block of CELLS
    full = dealt.join(listed, ["config", "metric"])

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        config, metric, block = key
        cells = cells.sort_values("d")
        where = {int(x["block"]): int(x["size"]) for x in cells["sizes"].iloc[0]}
        n = draws_of_block(np.array([where.get(b, 0) for b in range(int(cells["blocks"].iloc[0]))]), int(block), iterations, seed)
        share, values = cells["n"].to_numpy() / cells["n"].sum(), cells["d"].to_numpy(np.float64)
        rng, total = np.random.default_rng([seed, int(block)]), np.empty(iterations)
        for low in range(0, iterations, ITERATIONS):
            total[low : low + ITERATIONS] = rng.multinomial(n[low : low + ITERATIONS], share) @ values
        return pd.DataFrame({"config": config, "metric": metric, "it": np.arange(iterations), "part": np.rint(total)})

    parts = full.groupBy("config", "metric", "block").applyInPandas(run, "config string, metric string, it int, part double")
    known = cells.groupBy("config", "metric").agg(F.sum("n").alias("n"), (F.sum(F.col("d").cast("decimal(38,0)") * F.col("n")).cast("double") / _UNIT).alias("total"))
    sums = parts.groupBy("config", "metric", "it").agg((F.sum(F.col("part").cast("decimal(38,0)")).cast("double") / _UNIT).alias("sum")).join(F.broadcast(known), ["config", "metric"])
    means = sums.groupBy("config", "metric", "n", "total").agg(F.array_sort(F.collect_list(F.round(F.col("sum") / F.col("n"), 9))).alias("m"))  # one value for each iteration
    return _interval(means.withColumn("delta", F.col("total") / F.col("n")), iterations, confidence)


def _interval(means: DataFrame, iterations: int, confidence: float) -> DataFrame:
    """(config, metric, n, delta, low, high, step_pp, verdict) of means(config, metric, n, delta, m), m in order."""
    tail = (1 - confidence) / 2
    pick = lambda i: F.round(F.get(F.col("m"), F.lit(i)), 6)
    out = means.select("config", "metric", "n", F.round("delta", 6).alias("delta"), pick(max(0, int(tail * iterations))).alias("low"), pick(min(iterations - 1, int((1 - tail) * iterations))).alias("high"), F.round(100 / F.col("n"), 6).alias("step_pp"))
    return out.withColumn("verdict", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("inconclusive"))


def agreement(rows: DataFrame, group: tuple[str, ...] = ("metric",), threshold: float = 0.5) -> DataFrame:
    """Confusion counts, rates and Cohen's kappa of two raters over the rows both scored. [D17 S6 B15]

    rows(group, judge, label): null means not scored, which is counted apart and is not a zero.
    """
    both = F.col("judge").isNotNull() & F.col("label").isNotNull()
    j, x = F.col("judge") >= threshold, F.col("label") >= threshold
    n = lambda c: F.count_if(both & c)
    d = rows.groupBy(*group).agg(
        F.count_if(both).alias("n"), F.count_if(F.col("judge").isNull()).alias("unscored"), F.count_if(F.col("judge").isNotNull() & F.col("label").isNull()).alias("unlabelled"),
        n(j & x).alias("tp"), n(j & ~x).alias("fp"), n(~j & x).alias("fn"), n(~j & ~x).alias("tn"),
        F.round(F.avg(F.when(both, F.abs(F.col("judge") - F.col("label")))), 6).alias("mean_absolute_difference"),
    )
    share = lambda *c: F.when(F.col("n") > 0, sum(F.col(k) for k in c) / F.col("n")).otherwise(0.0)
    d = d.withColumn("_o", share("tp", "tn")).withColumn("_j", share("tp", "fp")).withColumn("_l", share("tp", "fn"))
    d = d.withColumn("_e", F.col("_j") * F.col("_l") + (1 - F.col("_j")) * (1 - F.col("_l")))
    d = d.withColumn("kappa", F.when((F.col("n") > 0) & (F.col("_e") < 1), F.round((F.col("_o") - F.col("_e")) / F.when(F.col("_e") < 1, 1 - F.col("_e")), 6)))
    size = F.abs("kappa")
    band = F.when(F.col("kappa").isNull(), "undefined").when(size < 0.2, "slight").when(size < 0.4, "fair").when(size < 0.6, "moderate").when(size < 0.8, "substantial").otherwise("almost perfect")
    return d.withColumn("band", band).withColumn("agreement", F.round("_o", 6)).withColumn("judge_rate", F.round("_j", 6)).withColumn("label_rate", F.round("_l", 6)).drop("_o", "_j", "_l", "_e")


#: Slots and iterations that are drawn at once, and draws of a task, about.
SLOTS, AT_ONCE, DRAWS = 1 << 14, 1 << 4, 1 << 23


def _drawn_cells(counts: DataFrame, group: str, iterations: int, seed: int) -> DataFrame:
    """(group, it, n, x, y, z) of counts(group, a, b, c, n): of n draws of each iteration how many are below a, a + b and a + b + c.

    A draw is that of ``_draw``. The work is dealt by (iterations, slots), a known number of draws to a task, as its rows
    are too few for Spark to see it; groups of the same iterations and slots meet in a task and share the hashes. A row
    that comes out is a part of an iteration.
    """
    listed = counts.select(group, "n", *(sum((F.col(k) for k in cells), F.lit(0)).cast("long").alias(name) for name, cells in (("x", "a"), ("y", "ab"), ("z", "abc"))))
    draws = listed.agg(F.sum(F.col("n").cast("double"))).first()[0] or 0
    steps = lambda last, step: F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")))
    work = listed.withColumn("it", steps(F.lit(iterations - 1).cast("long"), AT_ONCE)).withColumn("slot", steps(F.col("n") - 1, SLOTS))
    dealt = work.repartition(int(draws * iterations // DRAWS) + 1, "it", "slot").sortWithinPartitions("it", "slot", F.desc("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = None, np.empty((0, 0), np.uint32)
        for whole in batches:
            for low in range(0, whole.num_rows, 1 << 8):
                batch, out = whole.slice(low, 1 << 8), []
                for k, (n, x, y, z, it, slot) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 7)), strict=True)):
                    its, size = range(it, min(it + AT_ONCE, iterations)), min(SLOTS, n - slot)
                    if held != (it, slot) or hashes.shape[1] < size:
                        held, hashes = (it, slot), hashed_slots(seed, its, slot, slot + size)
                    for i, h in zip(its, hashes, strict=True):
                        h = h[:size]
                        place = h - h // np.uint32(n) * np.uint32(n) if n < 1 << 32 else h
                        out.append((k, i, n, *(int(np.count_nonzero(place < upto)) for upto in (x, y, z))))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], [group, "it", "n", "x", "y", "z"])

    schema = T.StructType([T.StructField(group, counts.schema[group].dataType), *(T.StructField(c, T.LongType()) for c in ("it", "n", "x", "y", "z"))])
    return dealt.mapInArrow(run, schema).groupBy(group, "it", "n").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z"))


def kappa_interval(rows: DataFrame, group: str = "metric", threshold: float = 0.5, iterations: int = 2000, seed: int = 42, confidence: float = 0.95, least_rows: int = 3, least_draws: int = 50) -> DataFrame:
    """(group, low, high): percentile interval of kappa by resampling the rows both raters scored. [S4]

    A resample needs only the four confusion counts, so a drawn place becomes one of four cells: rows in a fixed
    order of cells, place below its running count. No row leaves the aggregate. The cost is that of iterations x rows
    hashes.
    """
    j, x = F.col("judge") >= threshold, F.col("label") >= threshold
    d = rows.where("judge is not null and label is not null").groupBy(group).agg(F.count_if(j & x).alias("a"), F.count_if(j & ~x).alias("b"), F.count_if(~j & x).alias("c"), F.count(F.lit(1)).alias("n"))
    each = _drawn_cells(materialize(d.where(F.col("n") >= least_rows)), group, iterations, seed)
    jp, lp = F.col("y") / F.col("n"), (F.col("x") + F.col("z") - F.col("y")) / F.col("n")
    seen, by_chance = (F.col("x") + F.col("n") - F.col("z")) / F.col("n"), jp * lp + (1 - jp) * (1 - lp)
    kappa = F.when(by_chance < 1, F.round((seen - by_chance) / F.when(by_chance < 1, 1 - by_chance), 9))
    out = each.select(group, kappa.alias("k")).where("k is not null").groupBy(group).agg(F.array_sort(F.collect_list("k")).alias("k")).withColumn("m", F.size("k")).where(F.col("m") >= least_draws)
    tail = (1 - confidence) / 2
    low = F.greatest(F.lit(0), F.floor(F.lit(tail) * F.col("m")).cast("int") - 1)
    high = F.least(F.col("m") - 1, F.floor(F.lit(1 - tail) * F.col("m")).cast("int"))
    return out.select(group, F.round(F.get("k", low), 6).alias("low"), F.round(F.get("k", high), 6).alias("high"))


def disagreements(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows on which the raters differ, with the direction. [S5]"""
    j, x = F.col("judge") >= threshold, F.col("label") >= threshold
    return rows.where("judge is not null and label is not null").where(j != x).withColumn("direction", F.when(j, "judge too generous").otherwise("judge too harsh"))


def regression_gate(current: DataFrame, baseline: DataFrame, tolerance: float = 0.0, skipped: tuple[str, ...] = ("latency",)) -> DataFrame:
    """(config, metric, value, baseline, delta, outcome): missing, regression, improvement, equal, new. [S7 G3 C11]

    current, baseline (config, metric, value). Metrics whose name starts with a skipped word are not judged.
    """
    judged = lambda d: d.where(~F.col("metric").rlike("^(" + "|".join(skipped) + ")"))
    a = judged(current).select("config", "metric", "value")
    b = judged(baseline).select("config", "metric", F.col("value").alias("baseline"))
    both = a.join(b, ["config", "metric"], "full_outer").withColumn("delta", F.round(F.col("value") - F.col("baseline"), 6))
    outcome = F.when(F.col("baseline").isNull(), "new").when(F.col("value").isNull(), "missing").when(F.col("delta") < -tolerance, "regression").when(F.col("delta") > tolerance, "improvement").otherwise("equal")
    return both.select("config", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "delta", outcome.alias("outcome"))


def same_identity(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(field, current, baseline) of the identity fields that differ; empty if both runs are comparable. [S7]"""
    both = current.select("field", F.col("value").alias("current")).join(baseline.select("field", F.col("value").alias("baseline")), "field", "full_outer")
    return both.where(~F.col("current").eqNullSafe(F.col("baseline")))


def calibration_plan(rows: DataFrame, sentences: list[str], sample: int, seed: int = 42) -> DataFrame:
    """Seeded sample of perturbable rows, each with a planted sentence in turn. [B12 E9 H19 S8]

    rows(row_id, answer, expected_answer, evidence_count, should_refuse). The sample size is the feature.
    """
    from pyspark.sql import Window

    from passagemill.functions.text import with_planted

    fit = rows.where((F.coalesce(F.trim("expected_answer"), F.lit("")) != "") & (F.trim(F.coalesce("answer", F.lit(""))) != "") & (F.col("evidence_count") > 0) & ~F.col("should_refuse"))
    keyed = fit.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("row_id").cast("string"))))
    drawn = keyed.orderBy("_h", "row_id").limit(sample)
    planted = drawn.withColumn("_i", F.row_number().over(Window.orderBy("_h", "row_id")) - 1)  # after the limit: `sample` rows
    told = F.array(*map(F.lit, sentences))
    return planted.withColumn("planted", F.get(told, F.col("_i") % len(sentences))).withColumn("perturbed", with_planted(F.col("answer"), F.col("planted"))).drop("_h", "_i")


def calibration_summary(scores: DataFrame, group: tuple[str, ...] = (), flag_below: float = 0.5) -> DataFrame:
    """(group, n, flagged, partial, full, collapsed, means): how a judge rated planted answers. [D18 S8]

    scores(group, faithfulness, correctness, completeness): of the perturbed answers.
    """
    f = F.col("faithfulness")
    return scores.groupBy(*group).agg(
        F.count(f).alias("n"), F.count_if(f < flag_below).alias("flagged"), F.count_if((f >= flag_below) & (f < 1)).alias("partial"), F.count_if(f >= 1).alias("full"),
        F.count_if((f == 0) & (F.col("correctness") == 0) & (F.col("completeness") == 0)).alias("collapsed"),
        F.round(F.avg(f), 4).alias("mean_faithfulness"), F.round(F.avg("correctness"), 4).alias("mean_correctness"), F.round(F.avg("completeness"), 4).alias("mean_completeness"),
    )
