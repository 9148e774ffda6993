"""Statistics of surfaces against records."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fernwerk.operators.graph import connected_components
from fernwerk.operators.spatial import within
from fernwerk.storage import materialise


def exact_percentile(df: DataFrame, value: str, p: float, hold: int = 50_000) -> float | None:
    """The percentile with linear interpolation, as a number for later filters to push down; None without values.

    An approximate quantile brackets the place and the bracket is narrowed by counts until at most ``hold``
    distinct values are left, so no task ever holds the distinct values of the column.
    """
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = x.count()
    if not n:
        return None
    place = p * (n - 1)
    low, high = math.floor(place), math.ceil(place)
    lo, hi = -math.inf, math.inf  # open below, closed above
    while True:
        part = x.where((F.col("v") > lo) & (F.col("v") <= hi)) if lo > -math.inf or hi < math.inf else x
        if part.select("v").distinct().limit(hold + 1).count() <= hold:
            break
        below = x.where(F.col("v") <= lo).count() if lo > -math.inf else 0
        size = part.count()
        a, b = max(0.0, (low - below - 1) / size - 0.001), min(1.0, (high - below + 1) / size + 0.001)
        q = part.agg(F.percentile_approx("v", [a, b], 10_000)).first()[0]
        new_lo, new_hi = math.nextafter(q[0], -math.inf) if a > 0 else lo, q[1] if b < 1 else hi
        if (new_lo, new_hi) == (lo, hi):
            break
        under, upto = x.where(F.col("v") <= new_lo).count() if new_lo > -math.inf else 0, x.where(F.col("v") <= new_hi).count() if new_hi < math.inf else n
        lo, hi = new_lo if under <= low else lo, new_hi if upto > high else hi
    below = x.where(F.col("v") <= lo).count() if lo > -math.inf else 0
    found: dict[int, float] = {}
    for v, c in part.groupBy("v").count().orderBy("v").toLocalIterator():
        for k in (low, high):
            if below <= k < below + c:
                found[k] = v
        below += c
        if below > high:
            break
    return found[low] + (found[high] - found[low]) * (place - low)


def auc(samples: DataFrame, value: str, positive: str, by: list[str] | None = None, rejected: str | None = None) -> DataFrame:
    """Area under the curve: (pairs in order + half the ties) / pairs, for each group; missing without both kinds.

    Equal values are one row before the running count, which is within a group, or within a range of values and then
    over ranges. Rejected samples rank below all others.
    """
    by = by or []
    key = ([F.col(rejected).cast("int").alias("_r")] if rejected else [F.lit(0).alias("_r")]) + [F.when(~F.coalesce(F.col(rejected), F.lit(False)), F.col(value)).alias("_v") if rejected else F.col(value).alias("_v")]
    t = samples.groupBy(*by, *key).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_n"))
    order = [F.desc("_r"), F.asc("_v")]
    if by:
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        t = t.withColumn("_b", before)
    else:
        t = running_total(t, order, "_n", "_b")
    agg = t.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return agg.select(*by, F.try_divide(F.col("_u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"), "n_pos", "n_neg")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before, in order: per range of the order, then over the ranges, of which there are few."""
    parts = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_range").agg(F.sum(value).alias("_t"))
    offset = totals.withColumn("_o", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(offset.select("_range", "_o")), "_range").withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col("_o")).drop("_range", "_o")


def percentile_rank(values: DataFrame, value: str, reference: DataFrame, ref: str) -> DataFrame:
    """Each value with the share of the reference strictly below it: both are counted by value and walked in order once."""
    total = reference.agg(F.count(F.lit(1)).alias("_all"))
    both = reference.select(F.col(ref).alias("_v"), F.lit(1).alias("_n")).unionByName(values.select(F.col(value).alias("_v"), F.lit(0).alias("_n"))).groupBy("_v").agg(F.sum("_n").alias("_n"))
    below = running_total(both, [F.asc("_v")], "_n", "_b").select("_v", "_b")
    return values.join(below, F.col(value).eqNullSafe(F.col("_v"))).join(F.broadcast(total), how="cross").withColumn("percentile", F.try_divide(F.col("_b").cast("double"), F.col("_all"))).drop("_v", "_b", "_all")


def record_clusters(records: DataFrame, radius: float, id_col: str = "id") -> DataFrame:
    """Single-linkage clusters of records, named by their least id, as ``cluster``. Records at one place are joined once."""
    spots = materialise(records.groupBy("x", "y").agg(F.min(id_col).alias("spot")), "spots")
    other = spots.select(F.col("spot").alias("spot2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = within(spots, other, radius, ("x", "y"), ("x2", "y2")).where("spot < spot2")
    comp = connected_components(pairs, "spot", "spot2")
    named = spots.join(comp, spots["spot"] == comp["node"], "left").select("x", "y", F.coalesce("component", "spot").alias("cluster"))
    return records.join(named, ["x", "y"])


MODULUS = 2_147_483_647


def draw(replicate: Column, item: Column, seed: int = 20240802) -> Column:
    """A number of 0 .. 2^31 - 2 for each replicate and item: two steps of a multiplicative congruence, which any engine can repeat."""
    x = ((replicate * 7919 + item * 104_729 + seed) % MODULUS * 48_271) % MODULUS
    return (x * 69_621) % MODULUS


def _drawn(n: int, positive: int, replicates: np.ndarray, seed: int) -> np.ndarray:
    """How often each of n clusters is drawn, one column a replicate: the numbers of `draw`."""
    x = ((replicates[:, None] * 7919 + (np.arange(n) * 2 + positive) * 104_729 + seed) % MODULUS * 48_271) % MODULUS
    at = (x * 69_621) % MODULUS % n + np.arange(len(replicates))[:, None] * n
    return np.bincount(at.ravel(), minlength=n * len(replicates)).reshape(-1, n).T


def _boot_range(replicates: int, seed: int, fixed_negatives: bool) -> Callable:
    """Of one range of values: for each replicate twice the pairs in order (a tie is half a pair), and the rows of each kind."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = np.where(pdf["missing"].to_numpy(bool), 0, np.unique(pdf["value"].to_numpy(float), return_inverse=True)[1] + 1)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        up, i, times = (pdf[c].to_numpy()[order].astype(np.int64) for c in ("positive", "i", "times"))
        n = {k: int(pdf.loc[pdf["positive"] == bool(k), "n"].max()) for k in set(up.tolist())}
        out = []
        step = max(1, 2_000_000 // max(len(pdf), *n.values()))
        for r in range(0, replicates, step):
            own = np.arange(r, min(r + step, replicates), dtype=np.int64)
            sums = []
            for k in (1, 0):
                w = np.zeros((len(pdf), len(own)), np.int64)
                if k in n:
                    mine = up == k
                    w[mine] = times[mine, None] * (1 if fixed_negatives and not k else _drawn(n[k], k, own, seed)[i[mine]])
                sums.append(np.add.reduceat(w, first, axis=0))
            p, q = sums
            out.append(pd.DataFrame({"surface": pdf["surface"].iloc[0], "range": pdf["range"].iloc[0], "replicate": own, "u2": (p * (2 * (np.cumsum(q, axis=0) - q) + q)).sum(axis=0), "p": p.sum(axis=0), "q": q.sum(axis=0)}))
        return pd.concat(out)

    return run


def bootstrap_auc(samples: DataFrame, replicates: int, seed: int = 20240802, fixed_negatives: bool = False) -> DataFrame:
    """(surface, replicate, auc) from samples (surface, positive, cluster, value): each replicate draws as many clusters as there are,
    with replacement, the same ones for all surfaces.

    Samples are not multiplied by replicates: a range of values holds all replicates as a matrix, and ranges are added up in order."""
    clusters = samples.select("positive", "cluster").distinct()
    ranked = clusters.withColumn("i", F.row_number().over(Window.partitionBy("positive").orderBy("cluster")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("positive")))
    value = F.col("value").cast("double")
    rows = samples.join(ranked, ["positive", "cluster"]).groupBy("surface", "positive", "i", "n", value.alias("value")).agg(F.count(F.lit(1)).alias("times"))
    parts = materialise(rows.repartitionByRange("surface", "value").withColumn("range", F.spark_partition_id()), "boot")
    kind = samples.schema["surface"].dataType.simpleString()
    found = parts.withColumn("missing", F.col("value").isNull()).groupBy("surface", "range").applyInPandas(_boot_range(replicates, seed, fixed_negatives), f"surface {kind}, range int, replicate long, u2 long, p long, q long")
    below = F.coalesce(F.sum("q").over(Window.partitionBy("surface", "replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = found.withColumn("b", below).groupBy("surface", "replicate").agg((F.sum(F.col("u2") + 2 * F.col("p") * F.col("b")) / 2).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq")).where("np + nq > 0")
    return u.select("surface", "replicate", F.try_divide("u", (F.col("np") * F.col("nq")).cast("double")).alias("auc"))


def interval(replicates: DataFrame, by: list[str], value: str = "auc", level: float = 0.95) -> DataFrame:
    """Percentile interval over the replicates that have a value."""
    tail = (1 - level) / 2
    return replicates.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("x"), F.count(F.lit(1)).alias("replicates")).select(*by, F.col("x")[0].alias("low"), F.col("x")[1].alias("high"), "replicates")


def permutation_p(units: DataFrame, replicates: int, seed: int = 20240802) -> DataFrame:
    """One-sided p of units (unit, positive, value): (replicates with at least the observed AUC + 1) / (replicates + 1)."""
    spark = units.sparkSession
    observed = auc(units, "value", "positive").select(F.col("auc").alias("observed"))
    k = units.agg(F.count_if("positive").alias("k"))
    ids = units.withColumn("i", F.row_number().over(Window.orderBy("unit")) - 1)  # units are clusters: few
    rows = ids.join(F.broadcast(spark.range(replicates).select(F.col("id").alias("replicate"))), how="cross").withColumn("h", draw(F.col("replicate"), F.col("i"), seed))
    place = F.row_number().over(Window.partitionBy("replicate").orderBy("h", "i"))
    shuffled = rows.withColumn("place", place).join(F.broadcast(k), how="cross").withColumn("up", F.col("place") <= F.col("k"))
    hits = auc(shuffled, "value", "up", ["replicate"]).join(F.broadcast(observed), how="cross").agg(F.count_if(F.col("auc") >= F.col("observed") - 1e-12).alias("hits"), F.max("observed").alias("observed"))
    return hits.select("observed", "hits", ((F.col("hits") + 1) / F.lit(replicates + 1.0)).alias("p"))


def random_cells(cells: DataFrame, n: int, seed: int = 20240802) -> DataFrame:
    """At most n cells without replacement, the same at every run: the first by a hash of row, column and seed."""
    return cells.orderBy(draw(F.col("row").cast("long"), F.col("col").cast("long"), seed), "row", "col").limit(n)


MIN_TARGET_CLUSTERS, MIN_CONTRAST_CLUSTERS = 10, 5


def sample_guard(samples: DataFrame) -> DataFrame:
    """One row: whether there are clusters enough to judge the target at all, and to compare it with the contrast."""
    n = lambda c: F.count_distinct(F.when(c, F.col("cluster")))
    return samples.agg((n(F.col("positive")) >= MIN_TARGET_CLUSTERS).alias("enough_target"), (n(~F.col("positive")) >= MIN_CONTRAST_CLUSTERS).alias("enough_contrast"))


def enough(samples: DataFrame) -> tuple[bool, bool]:
    return tuple(sample_guard(samples).first())


def group_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, low, high) of the known values of each group."""
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def validation_report(samples: DataFrame, replicates: int = 2000, seed: int = 20240802) -> DataFrame:
    """(surface, auc, low, high, text): each surface's AUC with its cluster-bootstrap interval, and a line of the report.

    samples: surface, positive, cluster, value. Too few clusters are an error rather than an interval that spans everything.
    """
    target, _ = enough(samples)
    if not target:
        raise ValueError(f"fewer than {MIN_TARGET_CLUSTERS} target clusters")
    point = auc(samples, "value", "positive", ["surface"])
    both = point.join(interval(bootstrap_auc(samples, replicates, seed), ["surface"]), "surface")
    text = F.format_string("%-12s AUC %.2f [%.2f, %.2f]", "surface", "auc", "low", "high")
    return both.select("surface", "auc", "low", "high", text.alias("text"))
