"""From a score surface to ranked sites."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fernwerk.functions.curves import aspect_score, trapezoid, weighted_mean
from fernwerk.operators.graph import connected_components
from fernwerk.operators.spatial import within
from fernwerk.operators.stats import exact_percentile
from fernwerk.storage import materialise

#: Rows and columns of the tiles in which patches are labelled before they are joined.
TILE = 512


def rejected(score: Column, *required: Column) -> Column:
    """The score, missing where a required layer is; access and observations are never required."""
    ok = F.lit(True)
    for c in required:
        ok = ok & c.isNotNull()
    return F.when(ok, score)


def cut(cells: DataFrame, selection: str = "percentile", percentile: float = 99.0, min_score: float = 0.45, score: str = "score") -> DataFrame:
    """Cells at or above the percentile of scored cells and the least score; with selection "absolute", at or above the least score."""
    at = exact_percentile(cells, score, percentile / 100) if selection == "percentile" else None
    return cells.where(F.col(score) >= max(min_score, at if at is not None else min_score))


def local_patches(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Of each cell the index of the first cell, by row and column, of its eight-connected patch among these cells."""
    row, col = row.astype(np.int64), col.astype(np.int64)
    width = int(col.max() - col.min()) + 3  # a column is free at either edge, so that no neighbour is in another row
    cell, first, back = np.unique((row - row.min()) * width + col - col.min() + 1, return_index=True, return_inverse=True)
    a, b = [], []
    for step in (1, width - 1, width, width + 1):
        at = np.minimum(np.searchsorted(cell, cell + step), len(cell) - 1)
        hit = np.flatnonzero(cell[at] == cell + step)
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(cell))
    while True:  # patches that touch hang on the lesser; then each cell on the end of its chain
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return first[label][back]


def _label(t: pa.Table) -> pa.Table:
    if t["row"].null_count or t["col"].null_count:  # no place, no patch: such rows are a group of their own
        return t.append_column("label", pa.nulls(len(t), pa.int64()))
    row, col = (t[x].to_numpy().astype(np.int64) for x in ("row", "col"))
    at = local_patches(row, col)
    return t.append_column("label", pa.array(row[at] * (1 << 31) + col[at], pa.int64()))


def patches(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells with the least cell id (row * 2^31 + col) of their eight-connected patch, as ``label``.

    Each tile of the grid is labelled by itself, in one task; only cells at the rims of tiles are joined, and only the labels that meet
    there are contracted."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + ", label bigint"
    tr, tc = (F.floor(F.col(x) / tile).cast("long") for x in ("row", "col"))
    own = materialise(cells.groupBy(tr.alias("_tr"), tc.alias("_tc")).applyInArrow(_label, kinds), "patches")
    rim = own.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "label").where(" or ".join(f"pmod({x}, {tile}) in (0, {tile - 1})" for x in ("row", "col")))
    half = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    next_ = rim.select("label", half.alias("s"), "row", "col").select(F.col("label").alias("a"), (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    edges = next_.join(rim.withColumnRenamed("label", "b"), ["row", "col"]).where("a <> b").select("a", "b").distinct()
    comp = connected_components(edges)
    return own.join(comp, own["label"] == comp["node"], "left").withColumn("label", F.coalesce("component", "label")).drop("node", "component")


def summary(cells: DataFrame, cell_ha: float, score: str = "score") -> DataFrame:
    """Each patch: cells, area, mean score, and its best cell (of equals the northernmost, then westernmost)."""
    peak = F.max_by(F.struct("row", "col", F.col(score).alias("score")), F.struct(score, -F.col("row"), -F.col("col")))
    out = cells.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.coalesce(score, F.lit(0.0))).alias("mean_score"), peak.alias("p"))
    return out.select("label", "cells", (F.col("cells") * F.lit(cell_ha)).alias("area_ha"), "mean_score", F.col("p.row").alias("row"), F.col("p.col").alias("col"), F.col("p.score").alias("score"))


def flood(row: np.ndarray, col: np.ndarray, score: np.ndarray, spacing: int) -> np.ndarray:
    """Number of the peak of each cell of one patch. Peaks are taken from the top down, no two within ``spacing`` (Chebyshev); cells are
    flooded from them over edges (four neighbours), higher cells first. With fewer than two peaks all cells are 0.

    Neighbours are found in the sorted cells and peaks in squares of the spacing, so a patch of any size takes arrays of its length."""
    row, col = row.astype(np.int64), col.astype(np.int64)
    r, c = row - row.min(), col - col.min()
    width = int(c.max()) + 3  # a column is free at either edge, so that no neighbour is in another row
    cell = r * width + c + 1
    by_cell = np.argsort(cell, kind="stable")
    sorted_cells = cell[by_cell]

    def neighbour(dr: int, dc: int) -> np.ndarray:
        """The index of the cell there, -1 for none."""
        want = cell + dr * width + dc
        at = np.minimum(np.searchsorted(sorted_cells, want), len(cell) - 1)
        return np.where(sorted_cells[at] == want, by_cell[at], -1)

    top = np.ones(len(cell), bool)
    edges = []
    for dr, dc in ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)):
        j = neighbour(dr, dc)
        top &= (j < 0) | ~(score[j] > score)
        if not (dr and dc):
            edges.append(j)
    candidates = np.flatnonzero(top)
    peaks: list[int] = []
    square: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i in candidates[np.lexsort((col[candidates], row[candidates], -score[candidates]))].tolist():
        y, x = int(r[i]), int(c[i])
        a, b = y // (spacing + 1), x // (spacing + 1)
        if all(max(abs(y - p), abs(x - q)) > spacing for da in (-1, 0, 1) for db in (-1, 0, 1) for p, q in square.get((a + da, b + db), ())):
            peaks.append(i)
            square.setdefault((a, b), []).append((y, x))
    label = np.zeros(len(row), np.int64)
    if len(peaks) < 2:
        return label
    label[:] = -1
    owner = np.full(len(row), -1, np.int64)
    owner[peaks] = np.arange(len(peaks))
    heap = [(-score[p], k, p) for k, p in enumerate(peaks)]
    heapq.heapify(heap)
    tick = len(peaks)
    while heap:
        _, _, i = heapq.heappop(heap)
        label[i] = owner[i]
        for edge in edges:
            j = int(edge[i])
            if j >= 0 and owner[j] < 0:
                owner[j] = label[i]
                heapq.heappush(heap, (-score[j], tick, j))
                tick += 1
    for i in np.flatnonzero(label < 0):  # parts that only touch at corners, without a peak
        d = np.maximum(np.abs(row[peaks] - row[i]), np.abs(col[peaks] - col[i]))
        label[i] = int(d.argmin())
    return label


def split_oversized(cells: DataFrame, max_cells: int, spacing: int) -> DataFrame:
    """Patches of more than ``max_cells`` cells cut at their local maxima, as column ``part`` (0 for patches that stay whole).

    A patch is split in one task, whatever its size: the order of the flood is one of all its cells."""
    size = cells.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    sized = cells.join(size, "label")
    small = sized.where(F.col("_n") <= max_cells).drop("_n").withColumn("part", F.lit(0).cast("long"))
    large = sized.where(F.col("_n") > max_cells).drop("_n")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(part=flood(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["score"].to_numpy(), spacing))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in large.schema.fields) + ", part long"
    return small.unionByName(large.groupBy("label").applyInPandas(one, schema))


def ranked(sites: DataFrame, limit: int) -> DataFrame:
    """The best sites by rounded score, mean score and area; remaining ties by row and column."""
    order = [F.desc("score"), F.desc("mean_score"), F.desc("area_ha"), F.asc("row"), F.asc("col")]
    rounded = sites.withColumn("score", F.bround("score", 4)).withColumn("mean_score", F.bround("mean_score", 4)).withColumn("area_ha", F.bround("area_ha", 2))
    best = rounded.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearby_counts(sites: DataFrame, records: DataFrame, radius: float, key: str) -> DataFrame:
    """(key, nearby, nearby_exact): records (x, y, weight) no further from each site (sx, sy) than the radius, and those of full weight."""
    near = within(records.select("x", "y", "weight"), sites.select(key, "sx", "sy"), radius, ("x", "y"), ("sx", "sy")).groupBy(key).agg(F.count(F.lit(1)).alias("nearby"), F.count_if(F.col("weight") >= 1).alias("nearby_exact"))
    return sites.select(key).join(near, key, "left").fillna(0, ["nearby", "nearby_exact"])


def visible(sites: DataFrame, min_score: float = 0.0, max_drive: float = 90.0, max_hike: float = 6.0, elevation: tuple[float, float] = (0, 9000), hide_flagged: bool = False, hide_cut: bool = False) -> DataFrame:
    """The map's filters: missing drive, hike or height pass; recent cuts are those of under 45 years."""
    ok = (F.col("score") >= min_score) & F.coalesce(F.col("drive_minutes") <= max_drive, F.lit(True)) & F.coalesce(F.col("hike_km") <= max_hike, F.lit(True)) & F.coalesce(F.col("elevation_m").between(*elevation), F.lit(True))
    if hide_flagged:
        ok = ok & ~F.col("land_flagged")
    if hide_cut:
        ok = ok & ~(F.col("on_cutblock") & F.coalesce(F.col("years_since_logging") < 45, F.lit(False)))
    return sites.where(ok)


def candidate_surfaces(cells: DataFrame, habitat: str, extras: list[str], weights: dict[str, float], terrain: dict) -> DataFrame:
    """(row, col, surface, value) of every surface that is worth testing against records; a missing value is a rejected cell.

    cells: row, col, z, slope, aspect and score_terrain, score_<habitat>, score_<extra>. Surfaces: habitat (terrain, the habitat
    layer and the optional ones, blended by their weights where all are known; neither access nor sightings), terrain, its
    fits of elevation, slope and aspect, the habitat layer and each optional layer. One pass, one row a cell and surface.
    """
    parts = {k: F.col(f"score_{k}") for k in ("terrain", habitat, *extras)}
    e, s, a = terrain["elevation_m"], terrain["slope_deg"], terrain["aspect"]
    surfaces = {
        "habitat": rejected(weighted_mean(parts, {k: weights[k] for k in parts}), *parts.values()),
        "terrain": parts["terrain"],
        "elevation": trapezoid(F.col("z"), e.get("hard_min"), e["optimal_min"], e["optimal_max"], e.get("hard_max")),
        "slope": trapezoid(F.col("slope"), None, s["optimal_min"], s["optimal_max"], s["hard_max"]),
        "aspect": aspect_score(F.col("aspect"), F.col("slope"), a["optimal_bearing_deg"], a["tolerance_deg"], a["flat_slope_deg"]),
    } | {k: parts[k] for k in (habitat, *extras)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("surface"), v.cast("double").alias("value")) for k, v in surfaces.items())))
    return cells.select("row", "col", each.alias("s")).select("row", "col", "s.surface", "s.value")
