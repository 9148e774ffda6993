"""Road networks and least-cost surfaces."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fernwerk.functions.curves import num
from fernwerk.operators.graph import connected_components
from fernwerk.operators.spatial import within
from fernwerk.storage import materialise

# Fixed values.
SPEEDS = {"highway": 90.0, "arterial": 60.0, "collector": 50.0, "local": 40.0, "resource": 30.0, "unknown": 30.0}
NOT_DRIVABLE_CLASSES = ("trail", "pedestrian", "runway", "water", "ferry", "boat")
NOT_DRIVABLE_SURFACES = ("decommissioned", "overgrown")
JUNCTION_M = 2.0
#: Edges that one task may hold for a heap search; larger networks are relaxed by joins.
HEAP_EDGES = 1_000_000
#: Rows and columns of one tile of a cost surface, and the cells in the box of a block of tiles that one task settles.
TILE = 512
BLOCK_CELLS = 1_000_000
#: Pointers that a task follows at once.
CHUNK_POINTERS = 1_000_000


class NoNetworkError(ValueError):
    """There is no road to start from."""


def drivable(roads: DataFrame) -> DataFrame:
    """Roads without the classes and surfaces that cars cannot use; a missing one counts as unknown."""
    cls, surface = (F.coalesce(F.lower(c), F.lit("unknown")) for c in ("class", "surface"))
    return roads.where(~cls.isin(*NOT_DRIVABLE_CLASSES) & ~surface.isin(*NOT_DRIVABLE_SURFACES)).withColumn("class", cls)


def tenure_roads(roads: DataFrame) -> DataFrame:
    """Active roads, or of unknown status, as resource roads."""
    return roads.where(F.coalesce(F.upper("status"), F.lit("ACTIVE")) == "ACTIVE").withColumn("class", F.lit("resource"))


def drive_minutes(length_m: Column, cls: Column, speeds: dict[str, float] = SPEEDS) -> Column:
    speed = num(speeds.get("unknown", 30.0))
    for k, v in speeds.items():
        speed = F.when(cls == k, num(v)).otherwise(speed)
    return F.greatest(length_m / num(1000) / speed * num(60), num(1e-6))


def endpoints(roads: DataFrame) -> DataFrame:
    """(point, x, y): points 2 * segment and 2 * segment + 1."""
    ends = F.array(F.struct((F.col("segment_id") * 2).alias("point"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct((F.col("segment_id") * 2 + 1).alias("point"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    return roads.select(F.explode(ends).alias("e")).select("e.*")


def junctions(points: DataFrame, tolerance: float = JUNCTION_M) -> DataFrame:
    """(point, node): ends no further apart than the tolerance, and chains of them, are one node, named by its least point.

    Ends at one place are one row. Places of one square of 0.7 tolerances hang on its least; only those of different squares are
    compared. So pairs grow with the places, not with the square of the ends that meet at one. An end without a place is its own node.
    """
    known = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))  # neither missing, infinite nor NaN
    square = [F.floor(F.col(c) / num(0.7 * tolerance)).alias(f"s{c}") for c in "xy"]
    places = materialise(points.where(known).groupBy("x", "y").agg(F.min("point").alias("place")).select("*", *square), "places")
    hung = places.join(places.groupBy("sx", "sy").agg(F.min("place").alias("place2")), ["sx", "sy"]).where("place <> place2").select("place", "place2")
    other = places.select(*(F.col(c).alias(f"{c}2") for c in places.columns))
    near = within(places, other, tolerance, ("x", "y"), ("x2", "y2")).where("place < place2 and (sx <> sx2 or sy <> sy2)").select("place", "place2")
    comp = connected_components(hung.unionByName(near), "place", "place2")
    named = places.join(comp, places["place"] == comp["node"], "left").select("x", "y", F.coalesce("component", "place").alias("node"))
    return points.join(named, ["x", "y"], "left").select("point", F.coalesce("node", "point").alias("node"))


def network(roads: DataFrame, speeds: dict[str, float] = SPEEDS, tolerance: float = JUNCTION_M) -> DataFrame:
    """Undirected edges (a, b, minutes) between junctions: the quickest of parallel segments, no loops."""
    nodes = materialise(junctions(endpoints(roads), tolerance), "junctions")
    seg = roads.select("segment_id", drive_minutes(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.coalesce("class", F.lit("unknown")), speeds).alias("minutes"))
    start = nodes.where("point % 2 = 0").select(F.expr("point div 2").alias("segment_id"), F.col("node").alias("n0"))
    end = nodes.where("point % 2 = 1").select(F.expr("point div 2").alias("segment_id"), F.col("node").alias("n1"))
    both = seg.join(start, "segment_id").join(end, "segment_id").where("n0 <> n1")
    return both.groupBy(F.least("n0", "n1").alias("a"), F.greatest("n0", "n1").alias("b")).agg(F.min("minutes").alias("minutes"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes; of equals the one with the least name."""
    comp = materialise(connected_components(edges), "components")
    best = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return comp.join(F.broadcast(best), "component", "left_semi").select("node")


def _heap(pdf: pd.DataFrame) -> pd.DataFrame:
    start = pdf.loc[pdf["b"].isna(), "a"].astype("int64").tolist()
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in pdf.loc[pdf["b"].notna(), ["a", "b", "minutes"]].itertuples(index=False):
        near.setdefault(int(a), []).append((int(b), w))
        near.setdefault(int(b), []).append((int(a), w))
    best: dict[int, float] = {}
    heap = [(0.0, s) for s in start]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in near.get(u, ()):
            if v not in best:
                heapq.heappush(heap, (d + w, v))
    return pd.DataFrame({"node": list(best), "minutes": list(best.values())}).astype({"node": "int64", "minutes": "float64"})


def contracted(edges: DataFrame, keep: int, max_rounds: int = 40) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b, minutes) without the inner nodes of chains, and what was taken out by round: (node, a, b, to_a, to_b).

    A node with two neighbours that is the least, by a hash, of those next to it is replaced by one edge; the quickest of parallel
    edges stays. Each round takes out a share of every chain, so rounds grow with the logarithm of the longest.
    """
    out: list[DataFrame] = []
    for i in range(max_rounds):
        both = edges.select("a", "b", "minutes").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "minutes"))
        lot = lambda c: F.xxhash64(F.col(c), F.lit(i))
        inner = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("b", "minutes")).alias("x"), F.max(F.struct("b", "minutes")).alias("y"))
        inner = inner.where((F.col("n") == 2) & (F.col("node") != keep)).select("node", F.col("x.b").alias("a"), F.col("y.b").alias("b"), F.col("x.minutes").alias("to_a"), F.col("y.minutes").alias("to_b"))
        inner = materialise(inner.withColumn("lot", lot("node")), "inner")
        side = inner.select("node", F.explode(F.array("a", "b")).alias("at"), "lot").join(inner.select(F.col("node").alias("at"), F.col("lot").alias("other")), "at")
        gone = materialise(inner.join(side.where("other < lot").select("node").distinct(), "node", "left_anti").drop("lot"), "gone")
        if gone.isEmpty():
            break
        out.append(gone)
        names = gone.select("node")
        left = edges.join(names.select(F.col("node").alias("a")), "a", "left_anti").join(names.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b", "minutes")
        short = gone.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("to_a") + F.col("to_b")).alias("minutes"))
        edges = materialise(left.unionByName(short).groupBy("a", "b").agg(F.min("minutes").alias("minutes")), "contracted")
    return edges, out


def shortest_times(edges: DataFrame, source: int, heap_edges: int = HEAP_EDGES) -> DataFrame:
    """(node, minutes) of the nodes that can be reached. A network of at most ``heap_edges`` edges is searched with a heap in one
    task. Of a larger one the chains are contracted, and what is left is relaxed in buckets of time: a bucket is relaxed until it
    rests, then each of its nodes is final. Contracted nodes get their times from the ends of their chains, in reverse."""
    spark = edges.sparkSession
    origin = spark.createDataFrame([(source,)], "a long")
    small = lambda e: e.limit(heap_edges + 1).count() <= heap_edges
    taken: list[DataFrame] = []
    if not small(edges):
        edges, taken = contracted(edges.select("a", "b", "minutes"), source)
    if small(edges):
        rows = edges.select("a", "b", "minutes").unionByName(origin.select("a", F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("minutes")))
        known = rows.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda pdf: _heap(pdf), "node long, minutes double")
    else:
        known = _buckets(edges, origin)
    for gone in reversed(taken):
        known = materialise(known, "times")
        ends = gone.select("node", F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("to_a").alias("d")), F.struct(F.col("b").alias("at"), F.col("to_b").alias("d")))).alias("e")).select("node", "e.at", "e.d")
        own = ends.join(known.withColumnRenamed("node", "at"), "at").groupBy("node").agg(F.min(F.col("minutes") + F.col("d")).alias("minutes"))
        known = known.unionByName(own)
    return known


def _buckets(edges: DataFrame, origin: DataFrame) -> DataFrame:
    """Delta-stepping: buckets are as wide as four mean edges. Only nodes whose time is new are joined with their edges."""
    both = materialise(edges.select("a", "b", "minutes").union(edges.select("b", "a", "minutes")), "edges")
    width = 4 * both.agg(F.avg("minutes")).first()[0]
    # of all nodes met so far: the time, whether it is new since the node was last relaxed, and whether it is final
    open_ = materialise(origin.select(F.col("a").alias("node"), F.lit(0.0).alias("minutes"), F.lit(True).alias("new")), "open")
    final = None
    while True:
        low = open_.where("new").agg(F.min("minutes")).first()[0]
        if low is None:
            break
        top = low + width
        while True:
            now = open_.where("new").where(F.col("minutes") < top)
            if now.isEmpty():
                break
            step = now.join(both, now["node"] == both["a"]).groupBy(F.col("b").alias("node")).agg(F.min(now["minutes"] + both["minutes"]).alias("minutes"))
            if final is not None:
                step = step.join(final.select("node"), "node", "left_anti")
            merged = open_.withColumn("new", F.col("new") & (F.col("minutes") >= top)).unionByName(step.withColumn("new", F.lit(True)))
            best = merged.groupBy("node").agg(F.min(F.struct("minutes", "new")).alias("x"))  # of equal times the old one: false before true
            open_ = materialise(best.select("node", "x.minutes", "x.new"), "open")
        done = open_.where(F.col("minutes") < top).select("node", "minutes")
        final = materialise(done if final is None else final.unionByName(done), "final")
        open_ = materialise(open_.where(F.col("minutes") >= top), "open")
    return final if final is not None else open_.select("node", "minutes")


def segment_times(roads: DataFrame, nodes: DataFrame, times: DataFrame) -> DataFrame:
    """(segment_id, minutes): of the ends that can be reached, the quicker."""
    at = nodes.join(times, "node").select(F.expr("point div 2").alias("segment_id"), "minutes")
    return at.groupBy("segment_id").agg(F.min("minutes").alias("minutes")).join(roads.select("segment_id"), "segment_id")


_STEPS = [(dr, dc, math.hypot(dr, dc)) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


_LABEL = "minutes double, root long, metres double"


def _settle(cost: np.ndarray, minutes: np.ndarray, root: np.ndarray, metres: np.ndarray, seeds: list[tuple[float, int, float, int]], resolution: float) -> None:
    """Dijkstra over one tile (a full rectangle of costs, NaN where there is no cell) from seeds (minutes, root, metres, place): labels, in
    that order, are improved in place. A seed that is no better than what is there is dropped."""
    rows, cols = cost.shape
    flat, m_, r_, k_ = (x.ravel() for x in (cost, minutes, root, metres))
    c = flat.tolist()
    m, r, k = m_.tolist(), r_.tolist(), k_.tolist()
    steps = [(dr, dc, dr * cols + dc, d * resolution) for dr, dc, d in _STEPS]
    heap = []
    for label in seeds:
        if label[:3] < (m[label[3]], r[label[3]], k[label[3]]):
            m[label[3]], r[label[3]], k[label[3]] = label[:3]
            heap.append(label)
    heapq.heapify(heap)
    while heap:
        a, b, l, at = heapq.heappop(heap)
        if (a, b, l) > (m[at], r[at], k[at]):
            continue
        y, x = divmod(at, cols)
        here = c[at]
        for dr, dc, off, step in steps:
            if 0 <= y + dr < rows and 0 <= x + dc < cols:
                n = at + off
                there = c[n]
                if there == there:
                    label = (a + (here + there) / 2 * step, b, l + step)
                    if label < (m[n], r[n], k[n]):
                        m[n], r[n], k[n] = label
                        heapq.heappush(heap, (*label, n))
    m_[:], r_[:], k_[:] = m, r, k


def _read(text: bytes, kind: str, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(text, kind).reshape(shape).copy()


_TILES = "tr long, tc long, row0 int, col0 int, rows int, cols int, cost binary, minutes binary, root binary, metres binary"
_RIM = f"tr long, tc long, row int, col int, cost double, {_LABEL}"
_NO_ROOT = (1 << 63) - 1


def block_shape(box: tuple[int, int, int, int], tile: int, most: int) -> tuple[int, int]:
    """Rows and columns of a block: whole tiles, as square as the grid (its least and greatest row, then column) allows, with at most
    ``most`` cells of the grid's box, or one tile."""
    tiles = [box[i + 1] // tile - box[i] // tile + 1 for i in (0, 2)]
    cells = lambda n, i: min(n * tile, box[i + 1] - box[i] + 1)
    side = max(math.isqrt(most) // tile, 1)
    down = min(tiles[0], side)
    across = min(tiles[1], max(most // (cells(down, 0) * tile), 1))
    down = min(tiles[0], max(most // (cells(across, 2) * tile), 1))
    return down * tile, across * tile


def _first_tiles(high: int, wide: int) -> Callable:
    """The cells of a block as arrays, sources labelled, nothing settled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(pdf["row"].min()), int(pdf["col"].min())
        shape = int(pdf["row"].max()) - row0 + 1, int(pdf["col"].max()) - col0 + 1
        at = pdf["row"].to_numpy() - row0, pdf["col"].to_numpy() - col0
        cost = np.full(shape, np.nan)
        cost[at] = pdf["cost"].to_numpy(float)
        minutes, root, metres = np.full(shape, np.inf), np.full(shape, _NO_ROOT, np.int64), np.full(shape, np.inf)
        own = pdf[pdf["source"].astype("boolean").fillna(False)]
        place = own["row"].to_numpy() - row0, own["col"].to_numpy() - col0
        minutes[place], metres[place] = 0.0, 0.0
        root[place] = own["row"].to_numpy().astype(np.int64) * (1 << 31) + own["col"].to_numpy()
        return pd.DataFrame({"tr": [row0 // high], "tc": [col0 // wide], "row0": [row0], "col0": [col0], "rows": [shape[0]], "cols": [shape[1]], "cost": [cost.tobytes()], "minutes": [minutes.tobytes()], "root": [root.tobytes()], "metres": [metres.tobytes()]})

    return run


def _round(high: int, wide: int, box: tuple[int, int, int, int], resolution: float, first: bool) -> Callable:
    """A block and the labels that came over its rim -> the block settled, and the labels of its rim that changed, for the blocks next to
    it. The grid's own edge is no rim."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=_OUT_NAMES)
        t = left.iloc[0]
        shape = int(t["rows"]), int(t["cols"])
        cost, minutes, metres = (_read(t[x], "<f8", shape) for x in ("cost", "minutes", "metres"))
        root = _read(t["root"], "<i8", shape)
        before = minutes.copy(), root.copy(), metres.copy()
        seeds = []
        if first:
            y, x = np.nonzero(np.isfinite(minutes))
            seeds = [(0.0, int(root[i, j]), 0.0, int(i) * shape[1] + int(j)) for i, j in zip(y, x)]
            minutes[y, x], metres[y, x] = np.inf, np.inf
            root[y, x] = _NO_ROOT
            before = minutes.copy(), root.copy(), metres.copy()
        else:
            for r, c, k, m, b, l in right[["row", "col", "cost", "minutes", "root", "metres"]].itertuples(index=False):
                for dr, dc, d in _STEPS:
                    i, j = r + dr - int(t["row0"]), c + dc - int(t["col0"])
                    if 0 <= i < shape[0] and 0 <= j < shape[1] and cost[i, j] == cost[i, j]:
                        step = d * resolution
                        seeds.append((m + (k + cost[i, j]) / 2 * step, int(b), l + step, i * shape[1] + j))
        if seeds:
            _settle(cost, minutes, root, metres, seeds, resolution)
        changed = (minutes != before[0]) | (root != before[1]) | (metres != before[2])
        y, x = np.nonzero(changed)
        out = [{"tr": t["tr"], "tc": t["tc"], "row0": t["row0"], "col0": t["col0"], "rows": t["rows"], "cols": t["cols"], "t_cost": t["cost"], "t_minutes": minutes.tobytes(), "t_root": root.tobytes(), "t_metres": metres.tobytes()}]
        row, col = y + int(t["row0"]), x + int(t["col0"])
        news: dict[tuple[int, int], list[int]] = {}
        edge = ((row % high == 0) & (row > box[0])) | ((row % high == high - 1) & (row < box[1])) | ((col % wide == 0) & (col > box[2])) | ((col % wide == wide - 1) & (col < box[3]))
        for i in np.flatnonzero(edge):
            mine = row[i] // high, col[i] // wide
            for other in {((row[i] + dr) // high, (col[i] + dc) // wide) for dr, dc, _ in _STEPS} - {mine}:
                news.setdefault((int(other[0]), int(other[1])), []).append(int(i))
        for (a, b), at in news.items():
            out += [{"tr": a, "tc": b, "row": int(row[i]), "col": int(col[i]), "cost": cost[y[i], x[i]], "minutes": minutes[y[i], x[i]], "root": int(root[y[i], x[i]]), "metres": metres[y[i], x[i]]} for i in at]
        frame = pd.DataFrame(out, columns=_OUT_NAMES)
        return frame.astype({n: "Int32" for n in ("row0", "col0", "rows", "cols", "row", "col")} | {"root": "Int64", "tr": "int64", "tc": "int64"})

    return run


_OUT = "tr long, tc long, row0 int, col0 int, rows int, cols int, t_cost binary, t_minutes binary, t_root binary, t_metres binary, row int, col int, cost double, minutes double, root long, metres double"
_OUT_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for t in pdf.itertuples(index=False):
            shape = t.rows, t.cols
            cost, minutes, metres = (np.frombuffer(x, "<f8").reshape(shape) for x in (t.cost, t.minutes, t.metres))
            root = np.frombuffer(t.root, "<i8").reshape(shape)
            for i in range(0, shape[0], 64):
                y, x = np.nonzero(~np.isnan(cost[i : i + 64]))
                m, r, k = (v[i : i + 64][y, x] for v in (minutes, root, metres))
                known = np.isfinite(m)
                none = lambda v: pd.array(np.where(known, v, 0), dtype="Int64" if v.dtype == np.int64 else "Float64")
                frame = pd.DataFrame({"row": (y + i + t.row0).astype(np.int32), "col": (x + t.col0).astype(np.int32), "minutes": none(m), "root": none(r), "metres": none(k)})
                frame.loc[~known, ["minutes", "root", "metres"]] = pd.NA
                yield frame


def least_cost(cells: DataFrame, resolution: float, tile: int = TILE, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Minutes of the cheapest way from any source to each cell, the source it starts from (``root``) and its length in metres.

    cells: row, col, cost (minutes a metre, not negative; a missing one is no way through), source (boolean). Eight neighbours; a step
    costs the mean of its two cells times its length. Ties go to the lesser root, then the shorter way. Tiles side by side make a block
    of at most ``block_cells`` cells, however small the tiles. Each block is settled by itself and hands the labels of its rim that
    changed to the blocks next to it; only blocks with such news are settled again. A label only changes to a lesser one, of finitely
    many ways, so the rounds end, with the first that has no news: they are blocks across, not tiles or cells across. Unreached cells
    are missing.
    """
    box = tuple(cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first())
    high, wide = (tile, tile) if None in box else block_shape(box, tile, block_cells)
    tr, tc = (F.floor(F.col(x) / n).cast("long") for x, n in (("row", high), ("col", wide)))
    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("cost").cast("double").alias("cost"), "source", tr.alias("tr"), tc.alias("tc"))
    tiles = materialise(rows.groupBy("tr", "tc").applyInPandas(_first_tiles(high, wide), _TILES), "tiles")
    none = cells.sparkSession.createDataFrame([], _RIM)
    news, first = none, True
    while True:
        out = materialise(tiles.groupBy("tr", "tc").cogroup(news.groupBy("tr", "tc")).applyInPandas(_round(high, wide, box, resolution, first), _OUT), "round")
        settled = out.where("rows is not null").select("tr", "tc", "row0", "col0", "rows", "cols", *(F.col(f"t_{x}").alias(x) for x in ("cost", "minutes", "root", "metres")))
        news = out.where("rows is null").select("tr", "tc", "row", "col", "cost", "minutes", "root", "metres")
        whole = settled if first else settled.unionByName(held)
        first = False
        todo = materialise(news.select("tr", "tc").distinct(), "todo")
        if todo.isEmpty():
            break
        held = materialise(whole.join(todo, ["tr", "tc"], "left_anti"), "held")
        tiles = materialise(whole.join(todo, ["tr", "tc"], "left_semi"), "tiles")
    state = whole.mapInPandas(_cells_of, "row int, col int, " + _LABEL)
    return state.select("row", "col", "minutes", F.expr("cast(root div 2147483648 as int)").alias("root_row"), F.expr("cast(root % 2147483648 as int)").alias("root_col"), "metres")


def _follow(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pointers (cell, root, metres, open), in chunks of at most ``most``: each is led as far as the cells of its chunk go.
    ``open``: what it points to now lies in another chunk. Chains are doubled within the chunk."""

    def chunk(t: pa.Table) -> pa.RecordBatch:
        cell, root = t["cell"].to_numpy(), t["root"].to_numpy()
        metres = t["metres"].to_numpy(zero_copy_only=False).astype(float)
        known = ~t["metres"].is_null().to_numpy(zero_copy_only=False)
        is_open = t["open"].to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        at = np.minimum(np.searchsorted(cell[order], root), len(cell) - 1)
        to = order[at]
        own = np.arange(len(cell))
        inner = is_open & (cell[to] == root)
        next_ = np.where(inner, to, own)
        sum_, ok = np.where(inner, metres, 0.0), known | ~inner
        for _ in range(len(cell).bit_length() + 1):
            on = next_[next_]
            if (on == next_).all():
                break
            sum_, ok, next_ = sum_ + sum_[next_], ok & ok[next_], on
        else:
            raise ValueError("predecessors go in a circle")
        if (inner & inner[next_]).any():
            raise ValueError("predecessors go in a circle")
        sum_, ok = sum_ + metres[next_], ok & known[next_]
        columns = [pa.array(cell), pa.array(root[next_]), pa.array(sum_, pa.float64(), mask=~ok), pa.array(is_open[next_])]
        return pa.RecordBatch.from_arrays(columns, ["cell", "root", "metres", "open"])

    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, most - n)
            b = b.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == most:
                yield chunk(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield chunk(pa.Table.from_batches(held))


def pointer_roots(pred: DataFrame, max_rounds: int = 32, chunk: int = CHUNK_POINTERS) -> DataFrame:
    """(cell, root, metres) from (cell, pred, metres): predecessors followed to the end; a cell without one is its own root, and cells
    whose chain ends in a cell that is not there are left out.

    Cells in order are cut into chunks, in which each chain is followed by itself. Only the cells in which chains of other chunks go
    on are followed from chunk to chunk: in one task if they fit in a chunk, else by doubling. All cells are shuffled and written once.
    """
    schema = f"cell {pred.schema['cell'].dataType.simpleString()}, root {pred.schema['cell'].dataType.simpleString()}, metres double, open boolean"
    first = pred.select("cell", F.coalesce("pred", "cell").cast(pred.schema["cell"].dataType).alias("root"), F.when(F.col("pred").isNull(), 0.0).otherwise(F.col("metres")).cast("double").alias("metres"), F.col("pred").isNotNull().alias("open"))
    follow = lambda b: _follow(b, chunk)
    near = materialise(first.repartitionByRange("cell").sortWithinPartitions("cell").mapInArrow(follow, schema), "pointers")
    entered = near.where("open").select(F.col("root").alias("cell")).distinct()
    state = materialise(near.join(entered, "cell", "left_semi"), "entered")
    if state.limit(chunk + 1).count() <= chunk:
        state = materialise(state.coalesce(1).mapInArrow(follow, schema), "entered")
    else:
        for _ in range(max_rounds):
            on = state.select(F.col("cell").alias("at"), F.col("root").alias("next"), F.col("metres").alias("more"), F.col("open").alias("still"))
            todo = state.where("open").join(on, F.col("root") == F.col("at")).select("cell", F.col("next").alias("root"), (F.col("metres") + F.col("more")).alias("metres"), F.col("still").alias("open"))
            state = materialise(state.where("not open").unionByName(todo), "entered")
            if state.where("open").isEmpty():
                break
        else:
            raise ValueError("predecessors go in a circle")
    ends = state.where("not open").select(F.col("cell").alias("at"), F.col("root").alias("end"), F.col("metres").alias("more"))
    far = near.where("open").join(ends, F.col("root") == F.col("at")).select("cell", F.col("end").alias("root"), (F.col("metres") + F.col("more")).alias("metres"))
    return near.where("not open").select("cell", "root", "metres").unionByName(far)


def nearest_node(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """The node nearest to a place; of equals the one with the least name."""
    d = F.hypot(F.col("x") - num(x), F.col("y") - num(y))
    return nodes.agg(F.min_by("node", F.struct(d.alias("d"), "node")).alias("node"), F.min(d).alias("metres"))
