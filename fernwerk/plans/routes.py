"""Queries of roads, least-cost ways, patches, sites and record clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernwerk.functions import curves as C
from fernwerk.operators import network as N, sites as Z, spatial as S, stats as A
from fernwerk.plans import views as V
from fernwerk.plans.credits import SQL_SPEED, r6
from fernwerk.plans.views import oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *names)
        return f

    return add


SQL_POINTS = "pts AS (SELECT segment_id * 2 AS point, x0 AS x, y0 AS y FROM v_roads UNION ALL SELECT segment_id * 2 + 1, x1, y1 FROM v_roads)"
SQL_PAIRS = "pairs AS (SELECT a.point AS a, b.point AS b FROM pts a JOIN pts b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2 AND a.point <> b.point)"
SQL_NODES = f"""{SQL_POINTS}, {SQL_PAIRS}, reach(point, to_) AS (SELECT point, point FROM pts UNION SELECT r.point, p.b FROM reach r JOIN pairs p ON p.a = r.to_),
nodes AS (SELECT point, min(to_) AS node FROM reach GROUP BY 1)"""
SQL_EDGES = f"""{SQL_NODES}, seg AS (SELECT segment_id, greatest(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 1000 / CASE class WHEN 'highway' THEN 90 WHEN 'arterial' THEN 60 WHEN 'collector' THEN 50 WHEN 'local' THEN 40 ELSE 30 END * 60, 1e-6) AS minutes FROM v_roads),
edges AS (SELECT least(a.node, b.node) AS a, greatest(a.node, b.node) AS b, min(minutes) AS minutes FROM seg JOIN nodes a ON a.point = segment_id * 2 JOIN nodes b ON b.point = segment_id * 2 + 1 WHERE a.node <> b.node GROUP BY 1, 2)"""
SQL_TIMES = f"""{SQL_EDGES}, both_ AS (SELECT a, b, minutes FROM edges UNION ALL SELECT b, a, minutes FROM edges),
times(node, minutes) USING KEY (node) AS (SELECT (SELECT min(a) FROM edges), 0.0::DOUBLE UNION
  SELECT e.b, min(t.minutes + e.minutes) FROM times t JOIN both_ e ON e.a = t.node LEFT JOIN recurring.times o ON o.node = e.b GROUP BY e.b HAVING min(t.minutes + e.minutes) < coalesce(min(o.minutes), 1e300))"""


@query(f"WITH {SQL_POINTS}, {SQL_PAIRS} SELECT a, b FROM pairs WHERE a < b", "roads")
def j08_junction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = N.endpoints(V.roads(spark, sf_dir))
    other = pts.select(F.col("point").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return S.within(pts, other, 2.0, ("x", "y"), ("x2", "y2")).where("point < b").select(F.col("point").alias("a"), "b")


@query(f"WITH RECURSIVE {SQL_NODES} SELECT point, node FROM nodes", "roads")
def g01_junction_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.junctions(N.endpoints(V.roads(spark, sf_dir)))


@query(f"WITH RECURSIVE {SQL_EDGES} SELECT a, b, round(minutes, 6) AS minutes FROM edges", "roads")
def a11_min_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.network(V.roads(spark, sf_dir)).select("a", "b", r6(F.col("minutes")).alias("minutes"))


@query(f"""WITH RECURSIVE {SQL_EDGES}, both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), go(n, to_) AS (SELECT a, a FROM both_ UNION SELECT g.n, e.b FROM go g JOIN both_ e ON e.a = g.to_),
  comp AS (SELECT n AS node, min(to_) AS component FROM go GROUP BY 1), best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
  SELECT node FROM comp WHERE component = (SELECT component FROM best)""", "roads")
def g02_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.largest_component(N.network(V.roads(spark, sf_dir)))


def _times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from fernwerk.storage import materialise

    edges = materialise(N.network(V.roads(spark, sf_dir)), "network")
    source = edges.agg(F.min("a")).first()[0]
    return edges, N.shortest_times(edges, source)


@query(f"WITH RECURSIVE {SQL_TIMES} SELECT node, round(minutes, 6) + 0.0::DOUBLE AS minutes FROM times", "roads")
def g03_drive_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir)[1].select("node", r6(F.col("minutes")).alias("minutes"))


@query(f"""WITH RECURSIVE {SQL_TIMES} SELECT segment_id, round(min(minutes), 6) + 0.0::DOUBLE AS minutes FROM v_roads JOIN nodes ON point // 2 = segment_id JOIN times ON times.node = nodes.node GROUP BY 1""", "roads")
def g04_segment_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = V.roads(spark, sf_dir)
    out = N.segment_times(roads, N.junctions(N.endpoints(roads)), _times(spark, sf_dir)[1])
    return out.select("segment_id", r6(F.col("minutes")).alias("minutes"))


@query("""WITH g AS (SELECT segment_id % 60 AS minutes, (x0 + 37.3::DOUBLE) / 100 AS ax, (12000 - y0 - 41.7::DOUBLE) / 100 AS ay, (x1 + 37.3::DOUBLE) / 100 AS bx, (12000 - y1 - 41.7::DOUBLE) / 100 AS by_ FROM v_roads),
  c AS (SELECT *, r.i AS r, q.i AS c FROM g JOIN range(120) r(i) ON r.i BETWEEN floor(least(ay, by_)) AND floor(greatest(ay, by_)) JOIN range(150) q(i) ON q.i BETWEEN floor(least(ax, bx)) AND floor(greatest(ax, bx))),
  t AS (SELECT *, CASE WHEN bx = ax THEN 0 ELSE least((c - ax) / (bx - ax), (c + 1 - ax) / (bx - ax)) END AS tx0, CASE WHEN bx = ax THEN 1 ELSE greatest((c - ax) / (bx - ax), (c + 1 - ax) / (bx - ax)) END AS tx1,
    CASE WHEN by_ = ay THEN 0 ELSE least((r - ay) / (by_ - ay), (r + 1 - ay) / (by_ - ay)) END AS ty0, CASE WHEN by_ = ay THEN 1 ELSE greatest((r - ay) / (by_ - ay), (r + 1 - ay) / (by_ - ay)) END AS ty1 FROM c)
  SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, min(minutes) AS minutes FROM t WHERE greatest(tx0, ty0, 0) <= least(tx1, ty1, 1) GROUP BY 1, 2""", "roads")
def j07_quickest_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several roads through a cell, the one that is reached first."""
    from fernwerk.plans.layers import GRID

    shift = {c: F.col(c) + d for c, d in (("x0", 37.3), ("x1", 37.3), ("y0", 41.7), ("y1", 41.7))}
    roads = V.roads(spark, sf_dir).select((F.col("segment_id") % 60).alias("minutes"), *(v.alias(k) for k, v in shift.items()))
    return S.line_cells(roads, GRID).groupBy("row", "col").agg(F.min("minutes").alias("minutes"))


@query(f"""WITH RECURSIVE {SQL_EDGES}, both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), go(n, to_) AS (SELECT a, a FROM both_ UNION SELECT g.n, e.b FROM go g JOIN both_ e ON e.a = g.to_),
  comp AS (SELECT n AS node, min(to_) AS component FROM go GROUP BY 1), best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
  xy AS (SELECT node, min(x) AS x, min(y) AS y FROM pts JOIN nodes USING (point) WHERE node IN (SELECT node FROM comp WHERE component = (SELECT component FROM best)) GROUP BY 1)
  SELECT node, round(sqrt((x - 3210) ** 2 + (y - 4777) ** 2), 6) AS metres FROM xy ORDER BY 2, 1 LIMIT 1""", "roads")
def j12_nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nodes of the largest component, the one nearest to the origin."""
    roads = V.roads(spark, sf_dir)
    pts = N.endpoints(roads)
    xy = pts.join(N.junctions(pts), "point").groupBy("node").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return N.nearest_node(xy.join(N.largest_component(N.network(roads)), "node"), 3210, 4777).select("node", r6(F.col("metres")).alias("metres"))


def cost_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the terrain with three sources."""
    cost = C.cost_per_metre(F.col("slope"), F.col("col") % 5 == 0, F.lit(False))
    source = (F.col("row") == 3) & F.col("col").isin(7, 41) | (F.col("row") == 2) & (F.col("col") == 20)
    return V.terrain(spark, sf_dir).select("row", "col", cost.alias("cost"), source.alias("source"))


SQL_COST = f"""cost AS (SELECT row, col, CASE WHEN slope IS NULL OR slope > 45 THEN 1e4 ELSE 60 / (least(greatest({SQL_SPEED}, 0.05), 8) * 1000) * CASE WHEN col % 5 = 0 THEN 1 ELSE 1.6 END END AS cost FROM v_terrain),
step AS (SELECT a.row AS r0, a.col AS c0, b.row AS r1, b.col AS c1, (a.cost + b.cost) / 2 * 30 * CASE WHEN a.row <> b.row AND a.col <> b.col THEN sqrt(2) ELSE 1 END AS w FROM cost a JOIN cost b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)),
walk(row, col, minutes) USING KEY (row, col) AS (SELECT row, col, 0.0::DOUBLE FROM cost WHERE row = 3 AND col IN (7, 41) OR row = 2 AND col = 20 UNION
  SELECT s.r1, s.c1, min(t.minutes + s.w) FROM walk t JOIN step s ON s.r0 = t.row AND s.c0 = t.col LEFT JOIN recurring.walk o ON o.row = s.r1 AND o.col = s.c1 GROUP BY 1, 2 HAVING min(t.minutes + s.w) < coalesce(min(o.minutes), 1e300) - 1e-12)"""


@query(f"WITH RECURSIVE {SQL_COST} SELECT row, col, round(minutes, 5) + 0.0::DOUBLE AS minutes FROM walk", "terrain")
def g05_least_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.least_cost(cost_cells(spark, sf_dir), 30.0).where("minutes is not null")
    return out.select("row", "col", (F.round("minutes", 5) + F.lit(0.0)).alias("minutes"))


@query()
def g06_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres along the cheapest way, and the source where it starts."""
    out = N.least_cost(cost_cells(spark, sf_dir), 30.0, tile=16).where("minutes is not null")
    return out.select("row", "col", "root_row", "root_col", r6(F.col("metres")).alias("metres"))


@query()
def j16_root_drive_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell with the drive time of the source that its way starts from."""
    cells = cost_cells(spark, sf_dir)
    drive = cells.where("source").select(F.col("row").alias("root_row"), F.col("col").alias("root_col"), (F.col("row") * 10.0 + F.col("col")).alias("drive_minutes"))
    return N.least_cost(cells, 30.0).join(F.broadcast(drive), ["root_row", "root_col"], "left").select("row", "col", "drive_minutes")


@query("SELECT o_orderkey AS cell, o_orderkey % 7 AS root, (o_orderkey // 7) * 1.5::DOUBLE AS metres FROM orders")
def j17_pointer_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of predecessors, seven steps of 1.5 metres apart, followed to their roots."""
    k = F.col("o_orderkey")
    pred = V.read(spark, sf_dir, "orders").select(k.alias("cell"), F.when(k >= 7, k - 7).alias("pred"), F.lit(1.5).alias("metres"))
    return N.pointer_roots(pred)


SQL_GOOD = "good AS (SELECT row, col, score FROM v_wide WHERE score >= (SELECT quantile_cont(score, 0.8) FROM v_wide))"
SQL_PATCH = f"""{SQL_GOOD}, adj AS (SELECT a.row * 2147483648 + a.col AS a, b.row * 2147483648 + b.col AS b FROM good a JOIN good b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
lab(cell, label) USING KEY (cell) AS (SELECT row * 2147483648 + col, row * 2147483648 + col FROM good UNION
  SELECT e.b, min(l.label) FROM lab l JOIN adj e ON e.a = l.cell LEFT JOIN recurring.lab o ON o.cell = e.b GROUP BY e.b HAVING min(l.label) < min(o.label)),
patch AS (SELECT row, col, score, label FROM good JOIN lab ON cell = row * 2147483648 + col)"""


def good_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.patches(Z.cut(V.wide(spark, sf_dir), percentile=80.0, min_score=0.1))


@query(f"WITH {SQL_GOOD} SELECT row, col, round(score, 6) AS score FROM good", "wide")
def f14_percentile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.cut(V.wide(spark, sf_dir), percentile=80.0, min_score=0.1).select("row", "col", r6(F.col("score")).alias("score"))


@query("SELECT round(quantile_cont(score, 0.99), 9) AS p99, round(quantile_cont(score, 0.02), 9) AS p02, round(quantile_cont(score, 0.5), 9) AS p50 FROM v_wide", "wide")
def a12_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [A.exact_percentile(V.wide(spark, sf_dir), "score", p, hold=2000) for p in (0.99, 0.02, 0.5)]
    return spark.createDataFrame([tuple(round(x, 9) for x in at)], "p99 double, p02 double, p50 double")


@query(f"WITH RECURSIVE {SQL_PATCH} SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, label FROM patch", "wide")
def g07_patch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good_patches(spark, sf_dir).select("row", "col", "label")


SQL_SUMMARY = "SELECT label, count(*) AS cells, count(*) * 0.09::DOUBLE AS area_ha, avg(score) AS mean_score, arg_max(row, score * 1e12 - row * 1000 - col) AS row, arg_max(col, score * 1e12 - row * 1000 - col) AS col, max(score) AS score FROM patch GROUP BY 1"


@query(f"WITH RECURSIVE {SQL_PATCH} SELECT label, cells, round(area_ha, 6) AS area_ha, round(mean_score, 6) AS mean_score, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(score, 6) AS score FROM ({SQL_SUMMARY})", "wide")
def a06_patch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Z.summary(good_patches(spark, sf_dir), 0.09)
    return s.select("label", "cells", r6(F.col("area_ha")).alias("area_ha"), r6(F.col("mean_score")).alias("mean_score"), "row", "col", r6(F.col("score")).alias("score"))


@query(f"WITH RECURSIVE {SQL_PATCH} SELECT label, count(*) AS cells FROM patch GROUP BY 1 HAVING count(*) >= 6", "wide")
def f15_patch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.summary(good_patches(spark, sf_dir), 0.09).where("cells >= 6").select("label", "cells")


@query()
def g08_split_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of more than 30 cells cut at maxima at least four cells apart."""
    return Z.split_oversized(good_patches(spark, sf_dir).select("row", "col", "score", "label"), 30, 3)


SQL_SITES = f"""WITH RECURSIVE {SQL_PATCH}, sites AS (SELECT round_even(score, 4) AS score, round_even(mean_score, 4) AS mean_score, round_even(area_ha, 2) AS area_ha, row, col FROM ({SQL_SUMMARY}) WHERE cells >= 2),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, mean_score DESC, area_ha DESC, row, col) AS INT) AS rank, * FROM sites QUALIFY rank <= 40)"""


def ranked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.ranked(Z.summary(good_patches(spark, sf_dir), 0.09).where("cells >= 2"), 40)


@query(SQL_SITES + " SELECT rank, round(score, 4) AS score, round(mean_score, 3) AS mean_score, area_ha, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM ranked", "wide")
def o01_ranked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_sites(spark, sf_dir).select("rank", F.round("score", 4).alias("score"), F.round("mean_score", 3).alias("mean_score"), "area_ha", "row", "col")


@query(SQL_SITES + """, obs AS (SELECT x, y, taxon FROM v_observations WHERE NOT coalesce(obscured, false))
  SELECT rank, count(o.x) AS nearby, count_if(coalesce(o.taxon = 'Arnica latifolia' OR o.taxon LIKE 'Arnica latifolia %', false)) AS nearby_exact FROM ranked r
  LEFT JOIN obs o ON sqrt((o.x - r.col * 100 - 50) ** 2 + (o.y - r.row * 100 - 50) ** 2) <= 900 GROUP BY 1""", "wide", "observations")
def j10_site_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records within 900 m of each site, all and exact; sites without records have zeros."""
    from fernwerk.functions.labels import is_target

    sites = ranked_sites(spark, sf_dir).select("rank", (F.col("col") * 100.0 + 50).alias("sx"), (F.col("row") * 100.0 + 50).alias("sy"))
    obs = V.observations(spark, sf_dir).where("not coalesce(obscured, false)").select("x", "y", is_target(F.col("taxon"), "Arnica latifolia").alias("exact"))
    return Z.nearby_counts(sites, obs.withColumn("weight", F.when(F.col("exact"), 1.0).otherwise(0.0)), 900.0, "rank")


@query("""SELECT stream_id, count(o.x) AS nearby, coalesce(sum(CASE WHEN weight >= 1 THEN 1 ELSE 0 END), 0)::BIGINT AS nearby_exact FROM v_streams s LEFT JOIN (SELECT x, y, CASE WHEN taxon IS NULL OR taxon = '' THEN 0.5 WHEN taxon = 'Arnica cordifolia' THEN 0.2 WHEN taxon = 'Arnica latifolia' OR taxon LIKE 'Arnica latifolia %' THEN 1 ELSE 0.5 END AS weight FROM v_observations) o
  ON sqrt((o.x - s.col * 300) ** 2 + (o.y - s.row * 300) ** 2) <= 450 GROUP BY 1""", "streams", "observations")
def a09_nearby_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records within 450 m of each place, all, and those of full weight."""
    from fernwerk.functions.labels import record_weight

    at = V.streams(spark, sf_dir).select("stream_id", (F.col("col") * 300.0).alias("sx"), (F.col("row") * 300.0).alias("sy"))
    obs = V.observations(spark, sf_dir).select("x", "y", record_weight(F.col("taxon"), "Arnica latifolia", ["Arnica cordifolia"]).alias("weight"))
    return Z.nearby_counts(at, obs, 450.0, "stream_id")


SQL_RECORDS = "rec AS (SELECT id, x, y FROM v_observations WHERE accuracy_m <= 100 AND NOT coalesce(obscured, false)), spot AS (SELECT x, y, min(id) AS spot FROM rec GROUP BY 1, 2), near AS (SELECT a.spot AS a, b.spot AS b FROM spot a JOIN spot b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 120)"


@query(f"""WITH RECURSIVE {SQL_RECORDS}, lab(spot, label) USING KEY (spot) AS (SELECT spot, spot FROM spot UNION SELECT n.b, min(l.label) FROM lab l JOIN near n ON n.a = l.spot LEFT JOIN recurring.lab o ON o.spot = n.b GROUP BY n.b HAVING min(l.label) < min(o.label))
  SELECT rec.id, label AS cluster FROM rec JOIN spot USING (x, y) JOIN lab USING (spot)""", "observations")
def g09_record_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = V.observations(spark, sf_dir).where("accuracy_m <= 100 and not coalesce(obscured, false)").select("id", "x", "y")
    return A.record_clusters(rec, 120.0).select("id", "cluster")


@query(f"WITH {SQL_RECORDS} SELECT a, b FROM near WHERE a < b", "observations")
def j09_record_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = V.observations(spark, sf_dir).where("accuracy_m <= 100 and not coalesce(obscured, false)")
    a = rec.groupBy("x", "y").agg(F.min("id").alias("a"))
    b = a.select(F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return S.within(a, b, 120.0, ("x", "y"), ("x2", "y2")).where("a < b").select("a", "b")
