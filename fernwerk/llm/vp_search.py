"""Nearest neighbours by cosine with vantage-point trees per shard.

Vectors are dealt to cells of pivots (a bounded sample), large cells to several shards. A query first searches its own
cell; the distance of its k-th neighbour so far then rules out cells, and nodes of their trees, by the triangle
inequality on unit vectors. ``factor`` relaxes the pruning: lower bounds are multiplied by it; at 1 the search is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernwerk.storage import materialise

#: Vectors of one tree, and queries that one copy of it answers; they stream past it in batches.
SHARD_ROWS = 20_000
QUERY_ROWS = 50_000
#: Pivots grow with the root of the vectors, up to this many bytes of them, which are broadcast.
PIVOT_BYTES = 32 << 20
#: Up to so many pivots are chosen far from each other, more are taken as they come by hash.
FAR_PIVOTS = 512
LEAF = 128
_EPS = 1e-6


def matrix(col: pa.Array) -> np.ndarray:
    lists = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, in double precision."""
    return (x * y).sum(1) / (norms(x) * norms(y))


class Best:
    """The k best (score, id) of each query, in order."""

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.bound = bound.copy()  # distance beyond which nothing is wanted

    def add(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        rows, at = np.unique(q, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        score = np.concatenate([self.score[rows].ravel(), s])
        idn = np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((idn, -score, owner))
        first = np.searchsorted(owner[order], np.arange(len(rows)))
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[rows], self.id[rows] = score[take].reshape(-1, self.k), idn[take].reshape(-1, self.k)
        worst = self.score[rows, -1]
        d = np.where(np.isfinite(worst), np.sqrt(np.maximum(0, 2 - 2 * np.maximum(worst, -1))), np.inf)
        self.bound[rows] = np.minimum(self.bound[rows], d)


class VPTree:
    """A vantage-point tree of unit vectors; a batch of queries walks it together."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.unit = x / norms(x)[:, None]
        self.root = self._build(np.argsort(ids, kind="stable"))

    def _build(self, at: np.ndarray) -> tuple:
        if len(at) <= LEAF:
            return (at,)
        v = self.unit[at[0]]
        v = self.unit[at[np.argmin(self.unit[at] @ v)]]  # a far vector makes the better vantage point
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[at] @ v)))
        mu = float(np.median(d))
        near = d <= mu
        if near.all():
            if d.max() - d.min() < _EPS:  # copies, or all at one distance
                half = len(at) // 2
                return v, mu, mu, mu, mu, self._build(at[:half]), self._build(at[half:]), float(d.min())
            near = d < mu
        a, b = d[near], d[~near]
        return v, mu, float(a.max()), float(b.min()), float(b.max()), self._build(at[near]), self._build(at[~near]), float(a.min())

    def search(self, qid: np.ndarray, q: np.ndarray, best: Best, factor: float) -> None:
        unit = q / norms(q)[:, None]

        def walk(node: tuple, act: np.ndarray) -> None:
            if not len(act):
                return
            if len(node) == 1:
                at = node[0]
                s = unit[act] @ self.unit[at].T
                limit = 1 - best.bound[act] ** 2 / 2
                i, j = np.nonzero((s >= limit[:, None] - 1e-9) & (qid[act][:, None] != self.ids[at][None, :]))
                if len(i):
                    best.add(act[i], self.ids[at[j]], scores(q[act[i]], self.x[at[j]]))
                return
            v, mu, in_max, out_min, out_max, inside, outside, in_min = node
            d = np.sqrt(np.maximum(0, 2 - 2 * (unit[act] @ v)))

            def may(lo: float, hi: float, which: np.ndarray) -> np.ndarray:
                gap = np.maximum(0, np.maximum(lo - d[which], d[which] - hi))
                return which[(gap - _EPS) * factor <= best.bound[act[which]]]

            first = d <= mu
            walk(inside, act[may(in_min, in_max, np.flatnonzero(first))])
            walk(outside, act[may(out_min, out_max, np.flatnonzero(~first))])
            walk(outside, act[may(out_min, out_max, np.flatnonzero(first))])
            walk(inside, act[may(in_min, in_max, np.flatnonzero(~first))])

        walk(self.root, np.arange(len(q)))


def _assign(pivots: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("size").to_numpy()
            cell, far = np.full(len(size), -1, np.int64), np.zeros(len(size))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                if int(n) in p:
                    x = matrix(b.column("v").take(pa.array(rows)))
                    s = (x / norms(x)[:, None]) @ p[int(n)].T
                    cell[rows] = s.argmax(1)
                    far[rows] = np.sqrt(np.maximum(0, 2 - 2 * s.max(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return run


def _reach(pivots: object, radius: object, factor: float) -> Callable:
    """Queries -> the cells other than their own that may hold something nearer than their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            out_row, out_cell = [], []
            size, own, bound = (b.column(x).to_numpy() for x in ("size", "cell", "bound"))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                cells = sorted(c for m, c in radius.value if m == n)
                r = np.array([radius.value[int(n), c] for c in cells])
                if int(n) in p:
                    x = matrix(b.column("v").take(pa.array(rows)))
                    real = np.array([c for c in cells if c >= 0], np.int64)
                    d = np.sqrt(np.maximum(0, 2 - 2 * ((x / norms(x)[:, None]) @ p[int(n)][real].T)))
                    gap = np.maximum(0, d - r[[i for i, c in enumerate(cells) if c >= 0]])
                    i, j = np.nonzero((gap - _EPS) * factor <= bound[rows][:, None])
                    out_row.append(rows[i])
                    out_cell.append(real[j])
            row = np.concatenate(out_row) if out_row else np.zeros(0, np.int64)
            cell = np.concatenate(out_cell) if out_cell else np.zeros(0, np.int64)
            keep = own[row] != cell
            row, cell = row[keep], cell[keep]
            t = b.take(pa.array(row))
            yield t.set_column(t.schema.get_field_index("cell"), "cell", pa.array(cell))

    return run


def _search(k: int, factor: float) -> Callable:
    """Rows sorted by key, vectors before queries -> neighbours. One tree is held at a time and built once; queries stream past it."""
    kinds = {"qid": pa.int64(), "id": pa.int64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hold, tree = None, [], None
        for b in batches:
            key, asks = b.column("key").to_numpy(), b.column("bound").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if key[lo] != now:
                    now, hold, tree = key[lo], [], None
                if not asks[lo]:
                    hold.append(part)
                    continue
                if tree is None:
                    if not hold:
                        continue
                    t = pa.Table.from_batches(hold)
                    tree, hold = VPTree(t["id"].to_numpy(), matrix(t["v"])), []
                qid = part.column("id").to_numpy()
                best = Best(len(qid), k, part.column("bound").to_numpy())
                tree.search(qid, matrix(part.column("v")), best, factor)
                row, _ = np.nonzero(np.isfinite(best.score))
                ok = np.isfinite(best.score)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((qid[row], best.id[ok], best.score[ok]), kinds.values())], list(kinds))

    return run


def _pivots(fit: pa.Table, count: int) -> dict[int, np.ndarray]:
    """Unit vectors for each length of vectors."""
    out: dict[int, np.ndarray] = {}
    size = fit["size"].to_numpy()
    for n in np.unique(size):
        x = matrix(fit["v"].take(pa.array(np.flatnonzero(size == n))))
        x = x / norms(x)[:, None]
        most = min(count, max(1, PIVOT_BYTES // (8 * int(n))))
        if most > FAR_PIVOTS:
            out[int(n)] = x[:most]
            continue
        chosen = [0]
        far = np.full(len(x), np.inf)
        while len(chosen) < min(most, len(x)):
            far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[chosen[-1]]))))
            if far.max() < 1e-9:
                break
            chosen.append(int(far.argmax()))
        out[int(n)] = x[chosen]
    return out


def nearest(vectors: DataFrame, queries: str, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, max_pivots: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows of each row that meets the SQL condition ``queries`` over ``id``.

    Nearness is the largest cosine in double precision; ties go to the smaller id. Vectors that are null, zero, or hold a null or
    a non-finite component take no part, nor do rows with a null id; vectors of different lengths are no neighbours. A query with fewer
    candidates returns all. Ids name vectors: of rows repeated with one id the least vector counts.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(good).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    total = rows.count()
    count = max(1, int(min(total / 1000, 4 * total**0.5)))
    count = min(count, max_pivots) if max_pivots else count
    # a bounded sample: four times the pivots, of which there are at most PIVOT_BYTES
    share = spark.sparkContext.broadcast(_pivots(rows.orderBy(F.xxhash64("id")).limit(min(count, PIVOT_BYTES // 64) * (4 if count <= FAR_PIVOTS else 1)).toArrow(), count) if total else {})
    placed = materialise(rows.mapInArrow(_assign(share), "id long, v array<double>, size int, cell long, far double"), "vectors")
    # one row a cell: as many as pivots
    cells = placed.groupBy("size", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("members"), F.count_if(F.expr(f"({queries})")).alias("asked")).collect()
    radius = spark.sparkContext.broadcast({(r["size"], r["cell"]): r["far"] for r in cells})

    def visit(asked: DataFrame, number: dict) -> DataFrame:
        """Shards of a cell meet its queries. Of more than ``query_rows`` queries each so many have a copy of the shard of their own."""
        plan = [(r["size"], r["cell"], max(1, -(-r["members"] // shard_rows)), max(1, -(-number.get((r["size"], r["cell"]), 0) // query_rows))) for r in cells if number.get((r["size"], r["cell"]), 0)]
        p = F.broadcast(spark.createDataFrame(plan, "size int, cell long, shards long, blocks long"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = placed.join(p, ["size", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), "shards")).withColumn("block", every("blocks"))
        ask = asked.join(p, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("shard", every("shards"))
        key = F.xxhash64("size", "cell", "shard", "block").alias("key")
        both = own.select(key, "id", "v", F.lit(None).cast("double").alias("bound")).unionByName(ask.select(key, "id", "v", "bound"))
        return both.repartition("key").sortWithinPartitions("key", F.col("bound").isNotNull()).mapInArrow(_search(k, factor), "qid long, id long, score double")

    def top(found: DataFrame) -> DataFrame:
        return found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))

    asked = placed.where(queries).select("id", "v", "size", "cell", F.lit(float("inf")).alias("bound"))
    first = materialise(top(visit(asked, {(r["size"], r["cell"]): r["asked"] for r in cells})), "near")
    bound = F.when(F.size("best") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * F.element_at("best", k)["s"]))).otherwise(F.lit(float("inf")))
    again = asked.drop("bound").join(first.select(F.col("qid").alias("id"), bound.alias("bound")), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    reach = materialise(again.select("id", "v", "size", "cell", "bound").mapInArrow(_reach(share, radius, factor), "id long, v array<double>, size int, cell long, bound double"), "reach")
    number = {(r["size"], r["cell"]): r["count"] for r in reach.groupBy("size", "cell").count().collect()}
    both = first.select("qid", F.explode("best").alias("x")).select("qid", F.col("x.id").alias("id"), (-F.col("x.s")).alias("score")).unionByName(visit(reach, number))
    return top(both).select("qid", F.posexplode("best").alias("pos", "x")).select(F.col("qid").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))
