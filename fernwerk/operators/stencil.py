"""Neighbourhood operators on a grid of cells (row, col, value): row 0 is north.

Separable filters take two window passes, one along rows and one along columns; each shuffles once. Frames run over the
coordinate, so a cell that is not there does not shift them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def along_row() -> WindowSpec:
    return Window.partitionBy("row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy("col").orderBy("row")


def _shift(value: str, k: int, w: WindowSpec) -> Column:
    """The value k cells further on; beyond the edge the edge's own value."""
    there = F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    if abs(k) == 1:
        return F.coalesce(there, F.col(value))
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(there, (F.last if k > 0 else F.first)(value).over(full))


def lower_envelope(x: np.ndarray, g: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of ``at`` the parabola (x - place)^2 + g^2 that is lowest there, as an index; of equals the least (row, x).

    One pass over the parabolas, sorted by x, and one over the places, sorted too (Felzenszwalb and Huttenlocher).
    """
    h = g * g
    hull, edge = [0], [-math.inf]
    xs, hs = x.tolist(), h.tolist()
    for i in range(1, len(xs)):
        while True:
            j = hull[-1]
            cut = ((hs[i] + xs[i] * xs[i]) - (hs[j] + xs[j] * xs[j])) / (2 * (xs[i] - xs[j]))
            if cut < edge[-1] and len(hull) > 1:
                hull.pop()
                edge.pop()
            else:
                break
        hull.append(i)
        edge.append(cut)
    hull, edge = np.array(hull), np.array(edge)
    k = np.searchsorted(edge, at, side="right") - 1
    best = hull[k]
    d = (x[best] - at) ** 2 + h[best]
    for step in (-1, 1):  # at a border both, or more, are as low: the least place counts
        j, todo = k.copy(), np.arange(len(at))
        while len(todo):
            j[todo] += step
            todo = todo[(j[todo] >= 0) & (j[todo] < len(hull))]
            other = hull[j[todo]]
            tie = (x[other] - at[todo]) ** 2 + h[other] == d[todo]
            todo, other = todo[tie], other[tie]
            first = (row[other] < row[best[todo]]) | ((row[other] == row[best[todo]]) & (x[other] < x[best[todo]]))
            best[todo[first]] = other[first]
    return best


def _row_pass(value: str | None) -> Callable:
    """Of each row of cells, sorted by column: the distance squared to the nearest source, and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def line(t: pa.Table) -> pa.RecordBatch:
            col = t["col"].to_numpy().astype(np.int64)
            # the nearest source of a column may be above or below
            parts = [(t[f"{side}_row"].to_numpy(zero_copy_only=False).astype(float), t[f"{side}_value"] if value else None) for side in ("up", "down")]
            own = t["row"].to_numpy().astype(float)
            xs = np.concatenate([col, col])
            rows = np.concatenate([p[0] for p in parts])
            ok = np.flatnonzero(~np.isnan(rows))
            d = np.full(len(col), np.nan)
            pick = np.zeros(len(col), np.int64)
            if len(ok):
                away = np.abs(rows - np.concatenate([own, own]))
                order = ok[np.lexsort((rows[ok], away[ok], xs[ok]))]
                one = order[np.append(True, xs[order][1:] != xs[order][:-1])]
                best = one[lower_envelope(xs[one].astype(float), away[one], rows[one], col.astype(float))]
                d, pick = (xs[best] - col) ** 2 + away[best] ** 2, best
            columns = [t["row"].combine_chunks(), t["col"].combine_chunks(), pa.array(d, pa.float64(), from_pandas=True)]
            if value:
                both = pa.concat_arrays([p[1].combine_chunks() for p in parts])
                columns.append(both.take(pa.array(pick, mask=np.isnan(d))))
            return pa.RecordBatch.from_arrays(columns, ["row", "col", "_d", *(["_v"] if value else [])])

        for b in batches:
            if not b.num_rows:
                continue
            row = b.column("row").to_numpy()
            cuts = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[-1].column("row")[0] != b.column("row")[lo]:
                    yield line(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield line(pa.Table.from_batches(held))

    return run


def nearest_source(cells: DataFrame, source: Column, value: str | None = None) -> DataFrame:
    """(row, col, _d, _v) of each cell: distance squared, in cells, to the nearest source cell, and that cell's ``value``; missing if
    there is no source. Exact, and linear in the cells whatever the distance.

    The column pass finds the nearest source above and below; the row pass takes the lower envelope of their parabolas. A row of
    cells is held by a task at a time. Ties: the least row, then the least column.
    Both windows of the column pass grow from their first row: one that shrinks towards its last is gone through anew for each cell.
    """
    here = F.when(source, F.struct(F.col("row").alias("row"), *([F.col(value).alias("value")] if value else [])))
    up = F.last(here, ignorenulls=True).over(along_col().rowsBetween(Window.unboundedPreceding, 0))
    upwards = Window.partitionBy("col").orderBy(F.desc("row"))
    down = F.last(here, ignorenulls=True).over(upwards.rowsBetween(Window.unboundedPreceding, 0))
    grid = cells.select("row", "col", up.alias("_up"), down.alias("_down"))
    sides = [F.col(f"_{side}.{x}").alias(f"{side}_{x}") for side in ("up", "down") for x in (("row", "value") if value else ("row",))]
    kind = f", _v {cells.schema[value].dataType.simpleString()}" if value else ""
    rows = grid.select(F.col("row").cast("int"), F.col("col").cast("int"), *sides)
    return rows.repartition("row").sortWithinPartitions("row", "col").mapInArrow(_row_pass(value), "row int, col int, _d double" + kind)


def fill_nearest(cells: DataFrame, value: str = "z") -> DataFrame:
    """Missing values from the nearest cell that has one; of equals the one with the least row, then column. Without any they stay.

    Of a column the nearest above or below counts, so a cell as far as one of the same column may be passed over only for a
    lesser row.
    """
    near = nearest_source(cells, F.col(value).isNotNull(), value).select("row", "col", F.col("_v"))
    return cells.join(near, ["row", "col"], "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


def gaussian_weights(sigma: float) -> list[float]:
    """The normalised discrete kernel, cut at four sigma; from the centre outwards."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(r + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def gaussian(cells: DataFrame, sigma: float, value: str = "z") -> DataFrame:
    """Smoothing of a full grid; the edge is repeated outwards."""
    weights = gaussian_weights(sigma)
    for w in (along_row(), along_col()):
        total = F.col(value) * F.lit(weights[0])
        for k, x in enumerate(weights[1:], 1):
            total = total + (_shift(value, k, w) + _shift(value, -k, w)) * F.lit(x)
        cells = cells.withColumn(value, total)
    return cells


def slope_aspect(cells: DataFrame, resolution: float, sigma: float = 0.0, value: str = "z") -> DataFrame:
    """Horn's gradient of a full grid: slope and aspect in degrees added, holes stay missing. Level ground faces 180."""
    grid = fill_nearest(cells.withColumn("_hole", F.col(value).isNull()), value)
    if sigma > 0:
        grid = gaussian(grid, sigma, value)
    west, east = _shift(value, -1, along_row()), _shift(value, 1, along_row())
    grid = grid.withColumn("_e", east - west).withColumn("_s", west + 2 * F.col(value) + east)
    ge = (_shift("_e", -1, along_col()) + 2 * F.col("_e") + _shift("_e", 1, along_col())) / F.lit(8.0 * resolution)
    gn = (_shift("_s", -1, along_col()) - _shift("_s", 1, along_col())) / F.lit(8.0 * resolution)
    grid = grid.withColumn("_ge", ge).withColumn("_gn", gn)
    slope = F.degrees(F.atan(F.hypot("_ge", "_gn")))
    aspect = F.when((F.col("_ge") == 0) & (F.col("_gn") == 0), 180.0).otherwise(F.pmod(F.degrees(F.atan2(-F.col("_ge"), -F.col("_gn"))), F.lit(360.0)))
    known = ~F.col("_hole")
    out = grid.select("row", "col", F.when(known, slope).alias("slope"), F.when(known, aspect).alias("aspect"))
    return cells.join(out, ["row", "col"])


def topographic_position(cells: DataFrame, resolution: float, radius: float, value: str = "z") -> DataFrame:
    """Height above the mean of the known cells in an odd square window, cut at the edges; a hole stays missing."""
    half = max(int(round(2 * radius / resolution)) | 1, 3) // 2
    row, col = along_row().rangeBetween(-half, half), along_col().rangeBetween(-half, half)
    grid = cells.withColumn("_s", F.sum(value).over(row)).withColumn("_n", F.count(value).over(row))
    mean = F.sum("_s").over(col) / F.sum("_n").over(col)
    return grid.withColumn("tpi", F.col(value) - mean).drop("_s", "_n")


def distance_to(cells: DataFrame, resolution: float, mask: str = "water") -> DataFrame:
    """Exact Euclidean distance of each cell to the nearest cell of the mask, as ``distance``; missing if there is none."""
    near = nearest_source(cells, F.coalesce(F.col(mask), F.lit(False)))
    return cells.join(near, ["row", "col"], "left").withColumn("distance", F.sqrt("_d") * F.lit(float(resolution))).drop("_d")


def warp(cells: DataFrame, target: DataFrame, value: str, resampling: str = "bilinear") -> DataFrame:
    """(row, col, value) of the cells of another grid. target: row, col and the place of each cell's centre in the source, as fractional
    ``u`` (columns) and ``v`` (rows), in which the source's cell centres are whole numbers.

    "nearest" takes the source cell that the centre lies in. "bilinear" weighs the known ones of the four around it by their
    nearness; without any known one the cell is missing. Either is an equi-join of one or four rows a cell.
    """
    src = cells.where(F.col(value).isNotNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_z"))
    own = target.select("row", "col", "u", "v")
    if resampling == "nearest":
        at = own.withColumn("_r", F.floor(F.col("v") + 0.5).cast("int")).withColumn("_c", F.floor(F.col("u") + 0.5).cast("int"))
        return at.join(src, ["_r", "_c"], "left").select("row", "col", F.col("_z").alias(value))
    if resampling != "bilinear":
        raise ValueError(f"unknown resampling {resampling!r}")
    four = F.array(*(F.struct((F.floor("v") + a).cast("int").alias("_r"), (F.floor("u") + b).cast("int").alias("_c")) for a in (0, 1) for b in (0, 1)))
    near = own.withColumn("_s", F.explode(four)).select("row", "col", "u", "v", "_s._r", "_s._c")
    weight = (1 - F.abs(F.col("u") - F.col("_c"))) * (1 - F.abs(F.col("v") - F.col("_r")))
    found = near.join(src, ["_r", "_c"]).withColumn("_w", weight).where("_w > 0").groupBy("row", "col").agg((F.sum(F.col("_z") * F.col("_w")) / F.sum("_w")).alias(value))
    return target.select("row", "col").join(found, ["row", "col"], "left")


def proximity(seeds: DataFrame, cells: DataFrame, sigma: float) -> DataFrame:
    """Spread of sparse seeds (row, col, weight) over the cells by the discrete Gaussian kernel, zero beyond four sigma.

    Only seeds are spread: rows made are seeds times the kernel's area, added up before the shuffle.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) - 1
    kernel = F.array(*(F.lit(weights[abs(i)]) for i in range(-r, r + 1)))
    total = seeds.groupBy("row", "col").agg(F.sum("weight").alias("weight"))
    rows = total.select("row", "col", "weight", F.posexplode(kernel).alias("i", "wr")).select((F.col("row") + F.col("i") - r).alias("row"), "col", (F.col("weight") * F.col("wr")).alias("weight"))
    rows = rows.groupBy("row", "col").agg(F.sum("weight").alias("weight"))
    both = rows.select("row", "col", "weight", F.posexplode(kernel).alias("i", "wc")).select("row", (F.col("col") + F.col("i") - r).alias("col"), (F.col("weight") * F.col("wc")).alias("s"))
    return cells.join(both.groupBy("row", "col").agg(F.sum("s").alias("spread")), ["row", "col"], "left").withColumn("spread", F.coalesce("spread", F.lit(0.0)))


def local_maxima(cells: DataFrame, distance: int, value: str = "score") -> DataFrame:
    """Cells that hold the largest value within a Chebyshev distance; ties all count."""
    grid = cells.withColumn("_m", F.max(value).over(along_row().rangeBetween(-distance, distance)))
    grid = grid.withColumn("_m", F.max("_m").over(along_col().rangeBetween(-distance, distance)))
    return grid.where(F.col(value) == F.col("_m")).drop("_m")


def block_stats(pixels: DataFrame, value: str, factor: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of the known pixels of each cell of factor x factor pixels; one pass."""
    row, col = (F.floor(F.col(x) / factor).cast("int").alias(y) for x, y in (("frow", "row"), ("fcol", "col")))
    out = pixels.groupBy(*keys, row, col).agg(F.avg(value).alias("mean"), F.avg(F.col(value) * F.col(value)).alias("_sq"), F.count(value).alias("known"))
    return out.withColumn("std", F.when(F.col("known") > 0, F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0))))).drop("_sq")
