"""Queries of the layers: predicates, spatial joins, overlaps and stencils."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fernwerk.functions import curves as C, labels as L
from fernwerk.operators import spatial as S, stencil as T
from fernwerk.plans import views as V
from fernwerk.plans.credits import r6
from fernwerk.plans.views import oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GRID = S.Grid(0.0, 12_000.0, 100.0, 120, 150)


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *names)
        return f

    return add


@query("""SELECT coalesce(taxon, '') AS taxon, floor(min(x) / 30) * 30 AS left_, ceil(max(y) / 30) * 30 AS top, CAST(round((ceil(max(y) / 30) * 30 - floor(min(y) / 30) * 30) / 30) AS INT) AS rows, CAST(round((ceil(max(x) / 30) * 30 - floor(min(x) / 30) * 30) / 30) AS INT) AS cols
  FROM (SELECT taxon, x + 7.5::DOUBLE AS x, y - 3.25::DOUBLE AS y FROM v_observations) GROUP BY 1""", "observations")
def p01_snap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid around the records of each taxon: bounds moved outward to whole cells."""
    obs = V.observations(spark, sf_dir).select(F.coalesce("taxon", F.lit("")).alias("taxon"), (F.col("x") + 7.5).alias("x"), (F.col("y") - 3.25).alias("y"))
    box = obs.groupBy("taxon").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return box.select("taxon", *S.snapped(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 30.0))


@query("SELECT row, col, (col + 0.5::DOUBLE) * 100 AS x, 12000 - (row + 0.5::DOUBLE) * 100 AS y FROM v_wide", "wide")
def p02_cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.wide(spark, sf_dir).select("row", "col", GRID.x(F.col("col")).alias("x"), GRID.y(F.col("row")).alias("y"))


SQL_CELL = "SELECT id, CAST(trunc((12000 - y) / 100) AS INT) AS row, CAST(trunc(x / 100) AS INT) AS col FROM (SELECT id, x - 60 AS x, y + 45 AS y FROM v_observations) WHERE trunc((12000 - y) / 100) BETWEEN 0 AND 119 AND trunc(x / 100) BETWEEN 0 AND 149"


@query(SQL_CELL, "observations")
def p03_point_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir).select("id", (F.col("x") - 60).alias("x"), (F.col("y") + 45).alias("y"))
    return GRID.cell_of(obs).select("id", "row", "col")


@query("""SELECT poly_id, CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col FROM v_tenure, range(120) r(i), range(150) c(i)
  WHERE c.i * 100 + 50 BETWEEN col0 * 100 + 20 AND col1 * 100 + 170 AND 11950 - r.i * 100 BETWEEN 11900 - row1 * 100 + 20 AND 12000 - row0 * 100 + 30""", "tenure")
def p05_polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their centre in polygons that cover a bit more than rectangles of cells."""
    x0, x1 = F.col("col0") * 100.0 + 20, F.col("col1") * 100.0 + 170
    y0, y1 = 11_900.0 - F.col("row1") * 100 + 20, 12_000.0 - F.col("row0") * 100 + 30
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    polys = V.tenure(spark, sf_dir).select("poly_id", F.array(ring).alias("rings"))
    return S.polygon_cells(polys, GRID).select("poly_id", "row", "col")


SQL_TARGET = "dst AS (SELECT row, col, (row + 0.5::DOUBLE) * 0.8::DOUBLE - 0.5 AS v, (col + 0.5::DOUBLE) * 1.25::DOUBLE - 0.5 AS u FROM v_smooth WHERE col * 1.25::DOUBLE <= 49)"


def target_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of another grid, each with the place of its centre in the grid of the terrain."""
    own = V.smooth(spark, sf_dir).where(F.col("col") * 1.25 <= 49).select("row", "col")
    return own.withColumn("v", (F.col("row") + 0.5) * 0.8 - 0.5).withColumn("u", (F.col("col") + 0.5) * 1.25 - 0.5)


@query(f"""WITH {SQL_TARGET}, four AS (SELECT d.row, d.col, s.z, (1 - abs(u - s.col)) * (1 - abs(v - s.row)) AS w FROM dst d JOIN v_terrain s
  ON s.row BETWEEN floor(v) AND floor(v) + 1 AND s.col BETWEEN floor(u) AND floor(u) + 1)
  SELECT d.row, d.col, f.z FROM dst d LEFT JOIN (SELECT row, col, round(sum(z * w) / sum(w), 6) + 0.0::DOUBLE AS z FROM four WHERE z IS NOT NULL AND w > 0 GROUP BY 1, 2) f ON f.row = d.row AND f.col = d.col""", "terrain", "smooth")
def p06_bilinear_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another grid's cells from the four cells around their centres."""
    return T.warp(V.terrain(spark, sf_dir), target_cells(spark, sf_dir), "z").select("row", "col", r6(F.col("z")).alias("z"))


@query(f"""WITH {SQL_TARGET} SELECT d.row, d.col, s.slope FROM dst d LEFT JOIN v_terrain s ON s.row = floor(v + 0.5) AND s.col = floor(u + 0.5)""", "terrain", "smooth")
def p06_nearest_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.warp(V.terrain(spark, sf_dir), target_cells(spark, sf_dir), "slope", "nearest")


@query("""SELECT segment_id, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS metres, round(greatest(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 1000
  / CASE class WHEN 'highway' THEN 90 WHEN 'arterial' THEN 60 WHEN 'collector' THEN 50 WHEN 'local' THEN 40 ELSE 30 END * 60, 1e-6), 6) AS minutes FROM v_roads""", "roads")
def p08_segment_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernwerk.operators.network import drive_minutes

    line = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1"))))
    roads = V.roads(spark, sf_dir).withColumn("m", S.length(line))
    return roads.select("segment_id", r6(F.col("m")).alias("metres"), r6(drive_minutes(F.col("m"), F.coalesce("class", F.lit("unknown")))).alias("minutes"))


@query("""SELECT line_id, CAST(part AS INT) AS part, CAST(i AS INT) AS place, (line_id + i) * 1.0::DOUBLE AS x0, part * 10.0::DOUBLE AS y0, (line_id + i + 1) * 1.0::DOUBLE AS x1, part * 10.0::DOUBLE AS y1 FROM (SELECT s_suppkey AS line_id, unnest(range(CAST(s_suppkey % 3 AS BIGINT))) AS part, s_suppkey % 4 AS n FROM supplier), LATERAL (SELECT unnest(range(n - 1)) AS i)""")
def p07_line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the parts of multi-lines; parts of fewer than two points are no lines."""
    k = F.col("s_suppkey")
    part = lambda j: F.transform(F.slice(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), F.lit(1), (k % 4).cast("int")), lambda i: F.struct((k + i).cast("double").alias("x"), (j * 10).cast("double").alias("y")))
    parts = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (k % 3).cast("int")), part)
    return S.segments(V.read(spark, sf_dir, "supplier").select(k.alias("line_id"), parts.alias("parts")), "parts").select("line_id", "part", "place", "x0", "y0", "x1", "y1")


@query("SELECT k, r * r / 10000 AS cell_ha, CAST(greatest(round_even(0.5 / (r * r / 10000), 0), 1) AS INT) AS min_cells, CAST(floor(250 / (r * r / 10000)) AS INT) AS max_cells, CAST(greatest(round_even(600 / r, 0), 1) AS INT) AS spacing FROM (SELECT s_suppkey AS k, 7.0::DOUBLE + s_suppkey % 90 AS r FROM supplier)")
def p10_site_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most cells of a site and the spacing of peaks, by the size of a cell."""
    rows = V.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (7.0 + F.col("s_suppkey") % 90).alias("r"))
    return rows.select("k", *S.site_limits(F.col("r"), 0.5, 250, 600))


SQL_KRUEGER = """e AS (SELECT 1 / 298.257222101::DOUBLE AS f, 6378137.0::DOUBLE AS axis), n AS (SELECT *, f / (2 - f) AS n, sqrt(f * (2 - f)) AS ecc FROM e),
  k AS (SELECT *, axis / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64 + n ** 6 / 256) * 0.9996::DOUBLE AS scale,
    [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 - 127 * n ** 5 / 288 + 7891 * n ** 6 / 37800, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 + 281 * n ** 5 / 630 - 1983433 * n ** 6 / 1935360,
     61 * n ** 3 / 240 - 103 * n ** 4 / 140 + 15061 * n ** 5 / 26880 + 167603 * n ** 6 / 181440, 49561 * n ** 4 / 161280 - 179 * n ** 5 / 168 + 6601661 * n ** 6 / 7257600] AS al FROM n),
  o AS (SELECT id, radians(48.9::DOUBLE + y / 10000) AS phi, radians(-118.5::DOUBLE + x / 10000 + 117) AS lam FROM v_observations),
  c AS (SELECT id, lam, al, scale, sinh(atanh(sin(phi)) - ecc * atanh(ecc * sin(phi))) AS t FROM o, k), p AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) ** 2)) AS eta FROM c)"""


@query(f"""WITH {SQL_KRUEGER} SELECT id, round(500000 + scale * (eta + al[1] * cos(2 * xi) * sinh(2 * eta) + al[2] * cos(4 * xi) * sinh(4 * eta) + al[3] * cos(6 * xi) * sinh(6 * eta) + al[4] * cos(8 * xi) * sinh(8 * eta)), 3) AS x,
  round(scale * (xi + al[1] * sin(2 * xi) * cosh(2 * eta) + al[2] * sin(4 * xi) * cosh(4 * eta) + al[3] * sin(6 * xi) * cosh(6 * eta) + al[4] * sin(8 * xi) * cosh(8 * eta)), 3) AS y, true AS returns FROM p""", "observations")
def p04_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in UTM zone 11, to the millimetre; the way back moves none by a millionth of a second of arc."""
    obs = V.observations(spark, sf_dir).select("id", (-118.5 + F.col("x") / 10_000).alias("lon"), (48.9 + F.col("y") / 10_000).alias("lat"))
    x, y = S.to_utm(F.col("lon"), F.col("lat"), 11)
    back = obs.select("id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = S.from_utm(F.col("x"), F.col("y"), 11)
    stays = (F.abs(lon - F.col("lon")) < 3e-10) & (F.abs(lat - F.col("lat")) < 3e-10)
    return back.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), stays.alias("returns"))


#: An equal-area cone by the eccentricity and authalic latitudes.
SQL_ALBERS = """a0 AS (SELECT 6378137.0::DOUBLE AS axis, 1 / 298.257222101::DOUBLE AS f), a1 AS (SELECT *, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS ecc, radians(50.0::DOUBLE) AS p1, radians(58.5::DOUBLE) AS p2, radians(45.0::DOUBLE) AS p0 FROM a0),
  a2 AS (SELECT *, cos(p1) ** 2 / (1 - e2 * sin(p1) ** 2) AS m1, cos(p2) ** 2 / (1 - e2 * sin(p2) ** 2) AS m2, (1 - e2) * (sin(p1) / (1 - e2 * sin(p1) ** 2) + atanh(ecc * sin(p1)) / ecc) AS q1,
    (1 - e2) * (sin(p2) / (1 - e2 * sin(p2) ** 2) + atanh(ecc * sin(p2)) / ecc) AS q2, (1 - e2) * (sin(p0) / (1 - e2 * sin(p0) ** 2) + atanh(ecc * sin(p0)) / ecc) AS q0 FROM a1),
  a3 AS (SELECT *, (m1 - m2) / (q2 - q1) AS n FROM a2), a4 AS (SELECT *, m1 + n * q1 AS c FROM a3),
  ob AS (SELECT id, -118.5::DOUBLE + x / 10000 AS lon, radians(48.9::DOUBLE + y / 10000) AS phi FROM v_observations),
  ab AS (SELECT id, 1000000 + axis / n * sqrt(c - n * (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) ** 2) + atanh(ecc * sin(phi)) / ecc)) * sin(n * radians(lon + 126)) AS x,
    axis / n * sqrt(c - n * q0) - axis / n * sqrt(c - n * (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) ** 2) + atanh(ecc * sin(phi)) / ecc)) * cos(n * radians(lon + 126)) AS y FROM ob, a4)"""


def albers(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    x, y = S.to_albers(-118.5 + F.col("x") / 10_000, 48.9 + F.col("y") / 10_000)
    return obs.select("id", x.alias("x"), y.alias("y"))


@query(f"WITH {SQL_ALBERS} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM ab", "observations")
def p04_albers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albers(spark, sf_dir).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT row, col, z, coalesce(z BETWEEN 1300 AND 2500, false) AS ok_elevation, coalesce(slope <= 35, false) AS ok_slope FROM v_terrain", "terrain")
def f02_hard_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    return V.terrain(spark, sf_dir).select("row", "col", "z", F.coalesce(F.col("z").between(1300, 2500), no).alias("ok_elevation"), F.coalesce(F.col("slope") <= 35, no).alias("ok_slope"))


@query("SELECT count(*) AS cells, count(CASE WHEN z IS NOT NULL AND ndvi IS NOT NULL THEN 1 END) AS kept FROM v_terrain", "terrain")
def f04_layer_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernwerk.operators.sites import rejected

    t = V.terrain(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("cells"), F.count(rejected(F.lit(1.0), F.col("z"), F.col("ndvi"))).alias("kept"))


@query("""SELECT segment_id, coalesce(lower(class), 'unknown') AS class FROM v_roads WHERE coalesce(lower(class), 'unknown') NOT IN ('trail', 'pedestrian', 'runway', 'water', 'ferry', 'boat')
  AND coalesce(lower(surface), 'unknown') NOT IN ('decommissioned', 'overgrown')""", "roads")
def f06_drivable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernwerk.operators.network import drivable

    return drivable(V.roads(spark, sf_dir)).select("segment_id", "class")


@query("SELECT segment_id, 'resource' AS class FROM v_roads WHERE coalesce(upper(status), 'ACTIVE') = 'ACTIVE'", "roads")
def f07_tenure_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernwerk.operators.network import tenure_roads

    return tenure_roads(V.roads(spark, sf_dir)).select("segment_id", "class")


@query("SELECT poly_id FROM v_tenure WHERE layer = 'private'", "tenure")
def f08_private_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tenure(spark, sf_dir).where("layer = 'private'").select("poly_id")


def usable(obs: DataFrame, limit: float) -> DataFrame:
    """Records that are not obscured and not known to be worse than the limit."""
    return obs.where(~F.coalesce("obscured", F.lit(False)) & F.coalesce(F.col("accuracy_m") <= limit, F.lit(True)))


@query("SELECT id, taxon FROM v_observations WHERE NOT coalesce(obscured, false) AND (accuracy_m IS NULL OR accuracy_m <= 60)", "observations")
def f09_usable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(V.observations(spark, sf_dir), 60).select("id", "taxon")


@query("SELECT id, taxon FROM v_observations WHERE NOT coalesce(obscured, false) AND accuracy_m <= 100", "observations")
def f10_validation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observations(spark, sf_dir).where(~F.coalesce("obscured", F.lit(False)) & (F.col("accuracy_m") <= 100)).select("id", "taxon")


@query("SELECT id FROM v_observations WHERE x > y AND x + y < 14000 AND y > 1000", "observations")
def f11_records_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a triangle of lines on which no record lies."""
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1000, 1000), (13_000, 1000), (7000, 7000))))
    obs = V.observations(spark, sf_dir).where("y <> 1000 and x <> y and x + y <> 14000")
    return obs.where(S.inside(F.col("x"), F.col("y"), F.array(ring))).select("id")


@query("SELECT id, taxon, coalesce(taxon = 'Arnica latifolia' OR taxon LIKE 'Arnica latifolia %', false) AS target, coalesce(taxon = 'Arnica' OR taxon LIKE 'Arnica %', false) AS genus FROM v_observations", "observations")
def f12_target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observations(spark, sf_dir).select("id", "taxon", L.is_target(F.col("taxon"), "Arnica latifolia").alias("target"), L.is_target(F.col("taxon"), "Arnica").alias("genus"))


@query("SELECT row, col, CASE WHEN water_m * 2 <= 1440 THEN water_m * 2 END AS hike_minutes, water_m / 10 AS hike_km FROM v_terrain", "terrain")
def f13_hike_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("water_m") * 2
    return V.terrain(spark, sf_dir).select("row", "col", F.when(m <= 24 * 60, m).alias("hike_minutes"), (F.col("water_m") / 10).alias("hike_km"))


def water_mask(order: Column, code: Column, min_order: int, features: tuple[str, ...]) -> Column:
    """Whether a cell is water of the chosen kinds; streams count from an order of at least 1 on."""
    codes = {"lakes": 1, "rivers": 2, "wetlands": 3}  # fixed values
    unknown = set(features) - {*codes, "streams"}
    if unknown:
        raise ValueError(f"unknown water features: {sorted(unknown)}")
    out = F.coalesce(code.isin(*[codes[f] for f in features if f in codes]), F.lit(False))
    return out | F.coalesce(order >= max(min_order, 1), F.lit(False)) if "streams" in features else out


@query("SELECT stream_id, coalesce(stream_order >= 3, false) OR poly_code IN (1, 3) AS water FROM v_streams", "streams")
def f17_water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.streams(spark, sf_dir).select("stream_id", water_mask(F.col("stream_order"), F.col("poly_code"), 3, ("streams", "lakes", "wetlands")).alias("water"))


@query("SELECT scene, frow // 3 AS row, fcol // 3 AS col, avg((scl IN (4, 5, 7))::INT) > 0.5 AS clear FROM v_pixels GROUP BY 1, 2, 3", "pixels")
def f18_scene_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.avg(F.col("scl").isin(4, 5, 7).cast("double")) > 0.5
    return V.pixels(spark, sf_dir).groupBy("scene", F.expr("cast(frow div 3 as int)").alias("row"), F.expr("cast(fcol div 3 as int)").alias("col")).agg(keep.alias("clear"))


@query("""SELECT t.row, t.col, b.n AS blocks, (s.stream_order IS NOT NULL) AS stream FROM v_terrain t
  LEFT JOIN (SELECT r AS row, c AS col, count(*) AS n FROM (SELECT unnest(range(row0, row1 + 1)) AS r, col0, col1 FROM v_blocks), LATERAL (SELECT unnest(range(col0, col1 + 1)) AS c) GROUP BY 1, 2) b ON b.row = t.row AND b.col = t.col
  LEFT JOIN (SELECT row, col, max(stream_order) AS stream_order FROM v_streams GROUP BY 1, 2) s ON s.row = t.row AND s.col = t.col""", "terrain", "blocks", "streams")
def j01_aligned_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of one grid joined on row and column."""
    b = S.rectangle_cells(V.blocks(spark, sf_dir)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("blocks"))
    s = V.streams(spark, sf_dir).groupBy("row", "col").agg(F.max("stream_order").alias("o"))
    t = V.terrain(spark, sf_dir).select("row", "col")
    return t.join(b, ["row", "col"], "left").join(s, ["row", "col"], "left").select("row", "col", "blocks", F.col("o").isNotNull().alias("stream"))


SQL_BOX = "(SELECT *, r AS row, c AS col FROM (SELECT *, unnest(range({v}.row0, {v}.row1 + 1)) AS r FROM {v}), LATERAL (SELECT unnest(range(col0, col1 + 1)) AS c))"


SQL_TRIANGLE = "tri AS (SELECT poly_id, col0 * 100.0::DOUBLE + 13 AS ax, 12000 - row0 * 100.0::DOUBLE - 11 AS ay, col1 * 100.0::DOUBLE + 371 AS bx, 12000 - row0 * 100.0::DOUBLE - 67 AS by_, col0 * 100.0::DOUBLE + 153 AS cx, 11900 - row1 * 100.0::DOUBLE - 217 AS cy FROM v_tenure)"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle of each tenure polygon, whose sides pass through no centre or corner of a cell."""
    c0, c1, r0, r1 = (F.col(c) * 100.0 for c in ("col0", "col1", "row0", "row1"))
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((c0 + 13, 12_000 - r0 - 11), (c1 + 371, 12_000 - r0 - 67), (c0 + 153, 11_900 - r1 - 217))))
    return V.tenure(spark, sf_dir).select("poly_id", F.array(ring).alias("rings"))


@query(f"""WITH {SQL_TRIANGLE}, c AS (SELECT row, col, col * 100.0::DOUBLE + 50 AS x, 11950 - row * 100.0::DOUBLE AS y FROM v_terrain),
  s AS (SELECT c.row, c.col, poly_id, (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) AS u, (cx - bx) * (y - by_) - (cy - by_) * (x - bx) AS v, (ax - cx) * (y - cy) - (ay - cy) * (x - cx) AS w FROM c JOIN tri ON x BETWEEN ax AND bx AND y BETWEEN cy AND ay)
  SELECT c.row, c.col, coalesce(min(poly_id), -1) AS poly_id FROM c LEFT JOIN s ON s.row = c.row AND s.col = c.col AND (u > 0 AND v > 0 AND w > 0 OR u < 0 AND v < 0 AND w < 0) GROUP BY 1, 2""", "terrain", "tenure")
def j02_polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell with the least polygon that its centre lies in, -1 for none."""
    grid = S.Grid(0.0, 12_000.0, 100.0, 1 << 20, 50)
    p = S.polygon_cells(triangles(spark, sf_dir), grid).groupBy("row", "col").agg(F.min("poly_id").alias("poly_id"))
    return V.terrain(spark, sf_dir).select("row", "col").join(p, ["row", "col"], "left").select("row", "col", F.coalesce("poly_id", F.lit(-1).cast("long")).alias("poly_id"))


@query("SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, min(greatest(2025 - harvest_year, 0)) AS age FROM " + SQL_BOX.format(v="v_blocks") + " GROUP BY 1, 2", "blocks")
def j03_youngest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years since logging as of 2025; of overlapping blocks the youngest."""
    age = F.greatest(F.lit(2025) - F.col("harvest_year"), F.lit(0))
    return S.rectangle_cells(V.blocks(spark, sf_dir)).groupBy("row", "col").agg(F.min(age).alias("age"))


@query("SELECT row, col, max(least(greatest(coalesce(stream_order, 1), 1), 254)) AS stream_order FROM v_streams GROUP BY 1, 2", "streams")
def j04_stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.least(F.greatest(F.coalesce("stream_order", F.lit(1)), F.lit(1)), F.lit(254))
    return V.streams(spark, sf_dir).groupBy("row", "col").agg(F.max(order).alias("stream_order"))


@query("SELECT row, col, max(poly_code) AS poly_code FROM v_streams WHERE poly_code > 0 GROUP BY 1, 2", "streams")
def j05_water_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lakes 1, rivers 2, wetlands 3: later ones lie on top."""
    return V.streams(spark, sf_dir).where("poly_code > 0").groupBy("row", "col").agg(F.max("poly_code").alias("poly_code"))


def tenure_order() -> tuple[Column, Column]:
    """Class of a tenure polygon (layer, designation), and the order in which polygons are written over each other."""
    layer = F.col("layer")
    cls = F.when(layer == "woodlot", 1).when(layer == "private", 2).when(layer == "conservancy", 5).when(layer == "national", 7).otherwise(L.tenure_of(F.col("designation")))
    step = F.when(layer == "woodlot", 0).when(layer == "private", 1).when(layer == "park", 2).when(layer == "conservancy", 3).otherwise(4)
    return cls, F.struct(step, F.when(layer == "park", F.coalesce("designation", F.lit(""))).otherwise(""), cls)


def tenure_cells(polygons: DataFrame) -> DataFrame:
    """Tenure class of each covered cell, in order of writing: woodlots, private land, parks by designation, conservancies, national parks."""
    cls, order = tenure_order()
    return S.rectangle_cells(polygons).groupBy("row", "col").agg(F.max_by(cls, order).alias("class"))


@query("""WITH p AS (SELECT row, col, CASE layer WHEN 'woodlot' THEN 1 WHEN 'private' THEN 2 WHEN 'conservancy' THEN 5 WHEN 'national' THEN 7 ELSE
    CASE WHEN upper(coalesce(designation, '')) LIKE '%ECOLOGICAL RESERVE%' THEN 6 WHEN upper(coalesce(designation, '')) LIKE '%CONSERVANCY%' THEN 5 WHEN upper(coalesce(designation, '')) LIKE '%RECREATION AREA%' THEN 3 ELSE 4 END END AS class,
    CASE layer WHEN 'woodlot' THEN 0 WHEN 'private' THEN 1 WHEN 'park' THEN 2 WHEN 'conservancy' THEN 3 ELSE 4 END AS step,
    CASE layer WHEN 'park' THEN coalesce(designation, '') ELSE '' END AS name FROM """ + SQL_BOX.format(v="v_tenure") + """),
  top AS (SELECT row, col, class FROM p QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY step DESC, name DESC, class DESC) = 1)
  SELECT t.row, t.col, coalesce(class, 0) AS class, (['crown_land', 'woodlot', 'private', 'recreation_area', 'provincial_park', 'conservancy', 'ecological_reserve', 'national_park'])[coalesce(class, 0) + 1] AS status
  FROM v_terrain t LEFT JOIN top ON top.row = t.row AND top.col = t.col""", "terrain", "tenure")
def j06_tenure_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tenure_cells(V.tenure(spark, sf_dir))
    cls = F.coalesce("class", F.lit(0))
    return V.terrain(spark, sf_dir).select("row", "col").join(own, ["row", "col"], "left").select("row", "col", cls.alias("class"), F.element_at(L.literal_map(L.TENURE_CLASSES), cls).alias("status"))


@query("""WITH p AS (SELECT row, col, layer FROM """ + SQL_BOX.format(v="v_tenure") + """) SELECT t.row, t.col FROM v_terrain t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.row = t.row AND p.col = t.col AND layer = 'national')""", "terrain", "tenure")
def f05_tenure_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.rectangle_cells(V.tenure(spark, sf_dir).where("layer = 'national'")).select("row", "col")
    return V.terrain(spark, sf_dir).select("row", "col").join(p, ["row", "col"], "left_anti")


@query("""WITH p AS (SELECT row, col, layer FROM """ + SQL_BOX.format(v="v_tenure") + """) SELECT t.row, t.col FROM v_terrain t WHERE EXISTS (SELECT 1 FROM p WHERE p.row = t.row AND p.col = t.col)""", "terrain", "tenure")
def j19_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.rectangle_cells(V.tenure(spark, sf_dir)).select("row", "col")
    return V.terrain(spark, sf_dir).select("row", "col").join(p, ["row", "col"], "left_semi")


SQL_NDVI = "CASE WHEN scl IN (4, 5, 7) AND abs((nir - red) / nullif(nir + red - 2000, 0)) <= 1 THEN (nir - red) / nullif(nir + red - 2000, 0) END"


def ndvi_mask(nir: Column, red: Column) -> Column:
    """Greenness of pixels of the kept scene classes (vegetation, bare ground, unclassified)."""
    return F.when(F.col("scl").isin(4, 5, 7), C.normalised_difference(nir, red))


def ndvi_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nir, red = ((F.col(b) - 1000) / 10000 for b in ("nir", "red"))
    return V.pixels(spark, sf_dir).withColumn("ndvi", ndvi_mask(nir, red))


@query(f"""SELECT scene, CAST(frow // 3 AS INT) AS row, CAST(fcol // 3 AS INT) AS col, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(stddev_pop(x), 5) + 0.0::DOUBLE AS std, count(x) AS known
  FROM (SELECT *, {SQL_NDVI} AS x FROM v_pixels) GROUP BY 1, 2, 3""", "pixels")
def a01_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.block_stats(ndvi_pixels(spark, sf_dir), "ndvi", 3, ("scene",))
    return out.select("scene", "row", "col", r6(F.col("mean")).alias("mean"), (F.round("std", 5) + 0.0).alias("std"), "known")


@query(f"""SELECT row, col, round(median(m), 6) + 0.0::DOUBLE AS ndvi FROM (SELECT scene, CAST(frow // 3 AS INT) AS row, CAST(fcol // 3 AS INT) AS col, avg({SQL_NDVI}) AS m FROM v_pixels GROUP BY 1, 2, 3) GROUP BY 1, 2""", "pixels")
def a02_median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.block_stats(ndvi_pixels(spark, sf_dir), "ndvi", 3, ("scene",))
    return cells.groupBy("row", "col").agg(r6(F.median("mean")).alias("ndvi"))


@query("""SELECT CAST(trunc((12000 - y) / 100) AS INT) AS row, CAST(trunc(x / 100) AS INT) AS col, round(sum(CASE WHEN taxon IS NULL OR taxon = '' THEN 0.5 WHEN taxon = 'Arnica cordifolia' THEN 0.2
  WHEN taxon = 'Arnica latifolia' OR taxon LIKE 'Arnica latifolia %' THEN 1 ELSE 0.5 END::DOUBLE), 6) AS weight FROM v_observations
  WHERE trunc((12000 - y) / 100) BETWEEN 0 AND 119 AND trunc(x / 100) BETWEEN 0 AND 149 GROUP BY 1, 2""", "observations")
def a10_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir).withColumn("weight", L.record_weight(F.col("taxon"), "Arnica latifolia", ["Arnica cordifolia"]))
    return GRID.cell_of(obs).groupBy("row", "col").agg(r6(F.sum("weight")).alias("weight"))


@query("SELECT coalesce(taxon, 'none') AS taxon, count(*) AS records FROM v_observations GROUP BY 1 ORDER BY records DESC, taxon LIMIT 6", "observations")
def a08_taxon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observations(spark, sf_dir).groupBy(F.coalesce("taxon", F.lit("none")).alias("taxon")).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "taxon").limit(6)


SQL_KERNEL = """k AS (SELECT i, w / sum(w) OVER () AS w FROM (SELECT range - 8 AS i, exp(-0.5 * ((range - 8) / 2.0::DOUBLE) ** 2) AS w FROM range(17)))"""


@query(f"""WITH {SQL_KERNEL}, s AS (SELECT row, col, sum(stream_order) AS weight FROM v_streams WHERE stream_order IS NOT NULL GROUP BY 1, 2),
  d AS (SELECT s.row + a.i AS row, s.col + b.i AS col, sum(weight * a.w * b.w) AS spread FROM s, k a, k b GROUP BY 1, 2)
  SELECT t.row, t.col, round(coalesce(spread, 0), 6) + 0.0::DOUBLE AS spread FROM v_terrain t LEFT JOIN d ON d.row = t.row AND d.col = t.col""", "streams", "terrain")
def w05_proximity_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = V.streams(spark, sf_dir).where("stream_order is not null").select("row", "col", F.col("stream_order").cast("double").alias("weight"))
    return T.proximity(seeds, V.terrain(spark, sf_dir).select("row", "col"), 2.0).select("row", "col", r6(F.col("spread")).alias("spread"))


@query(f"""WITH {SQL_KERNEL}, s AS (SELECT row, col, sum(stream_order) AS weight FROM v_streams WHERE stream_order IS NOT NULL GROUP BY 1, 2)
  SELECT CAST(s.row + a.i AS INT) AS row, CAST(s.col + b.i AS INT) AS col, round(sum(weight * a.w * b.w), 6) AS spread FROM s, k a, k b WHERE s.row + a.i BETWEEN 0 AND 39 AND s.col + b.i BETWEEN 0 AND 24 GROUP BY 1, 2""", "streams")
def j11_proximity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that a seed reaches: a range join of cells and seeds by exploded seeds."""
    seeds = V.streams(spark, sf_dir).where("stream_order is not null").select("row", "col", F.col("stream_order").cast("double").alias("weight"))
    cells = S.Grid(0, 0, 1, 40, 25).cells(spark).select("row", "col")
    near = T.proximity(seeds, cells, 2.0)
    return near.where("spread > 0").select("row", "col", r6(F.col("spread")).alias("spread"))


SQL_FILLED = """hole AS (SELECT row, col FROM v_smooth WHERE z IS NULL), g AS (SELECT row, col, z, z IS NULL AS hole FROM v_smooth),
f AS (SELECT g.row, g.col, hole, coalesce(z, (SELECT arg_min(n.z, ((n.row - g.row) ** 2 + (n.col - g.col) ** 2) * 1e9::DOUBLE + n.row * 1000 + n.col) FROM v_smooth n WHERE n.z IS NOT NULL AND abs(n.row - g.row) <= 3 AND abs(n.col - g.col) <= 3)) AS z FROM g)"""


@query(f"WITH {SQL_FILLED} SELECT row, col, z FROM f", "smooth")
def j13_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fill_nearest(V.smooth(spark, sf_dir)).select("row", "col", "z")


@query(f"""WITH {SQL_FILLED}, a AS (SELECT *, coalesce(lag(z) OVER r, z) AS w, coalesce(lead(z) OVER r, z) AS e FROM f WINDOW r AS (PARTITION BY row ORDER BY col)),
  b AS (SELECT *, e - w AS de, w + 2 * z + e AS s FROM a),
  c AS (SELECT *, (coalesce(lag(de) OVER k, de) + 2 * de + coalesce(lead(de) OVER k, de)) / 240 AS ge, (coalesce(lag(s) OVER k, s) - coalesce(lead(s) OVER k, s)) / 240 AS gn FROM b WINDOW k AS (PARTITION BY col ORDER BY row))
  SELECT row, col, round(CASE WHEN NOT hole THEN degrees(atan(sqrt(ge * ge + gn * gn))) END, 6) + 0.0::DOUBLE AS slope,
  round(CASE WHEN NOT hole THEN CASE WHEN ge = 0 AND gn = 0 THEN 180 ELSE (degrees(atan2(-ge, -gn)) + 360) % 360 END END, 6) + 0.0::DOUBLE AS aspect FROM c""", "smooth")
def w01_slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.slope_aspect(V.smooth(spark, sf_dir), 30.0).select("row", "col", r6(F.col("slope")).alias("slope"), r6(F.col("aspect")).alias("aspect"))


@query(f"""WITH {SQL_FILLED}, k AS (SELECT i, w / sum(w) OVER () AS w FROM (SELECT range - 4 AS i, exp(-0.5 * (range - 4.0::DOUBLE) ** 2) AS w FROM range(9))),
  edge AS (SELECT max(row) AS mr, max(col) AS mc FROM v_smooth),
  a AS (SELECT f.row, f.col, sum(n.z * k.w) AS z FROM f, edge, k JOIN f n ON n.row = f.row AND n.col = least(greatest(f.col + k.i, 0), mc) GROUP BY 1, 2),
  b AS (SELECT a.row, a.col, sum(n.z * k.w) AS z FROM a, edge, k JOIN a n ON n.col = a.col AND n.row = least(greatest(a.row + k.i, 0), mr) GROUP BY 1, 2)
  SELECT row, col, round(z, 6) AS z FROM b""", "smooth")
def w02_gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.gaussian(T.fill_nearest(V.smooth(spark, sf_dir)), 1.0).select("row", "col", r6(F.col("z")).alias("z"))


@query("""WITH m AS (SELECT DISTINCT s.row, s.col FROM v_streams s JOIN v_terrain t ON t.row = s.row AND t.col = s.col WHERE poly_code = 1) SELECT t.row, t.col, round(30 * sqrt(min((t.row - m.row) ** 2 + (t.col - m.col) ** 2)), 6) AS distance FROM v_terrain t LEFT JOIN m ON true GROUP BY 1, 2""", "terrain", "streams")
def w03_water_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.streams(spark, sf_dir).where("poly_code = 1").select("row", "col", F.lit(True).alias("water")).distinct()
    cells = V.terrain(spark, sf_dir).select("row", "col").join(m, ["row", "col"], "left").withColumn("water", F.coalesce("water", F.lit(False)))
    return T.distance_to(cells, 30.0).select("row", "col", r6(F.col("distance")).alias("distance"))


@query("""SELECT t.row, t.col, round(t.z - avg(n.z), 6) + 0.0::DOUBLE AS tpi FROM v_smooth t JOIN v_smooth n ON abs(n.row - t.row) <= 3 AND abs(n.col - t.col) <= 3 GROUP BY t.row, t.col, t.z""", "smooth")
def w04_topographic_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.topographic_position(V.smooth(spark, sf_dir), 30.0, 90.0).select("row", "col", r6(F.col("tpi")).alias("tpi"))


@query("""SELECT w.row, w.col FROM v_wide w JOIN v_wide n ON abs(n.row - w.row) <= 4 AND abs(n.col - w.col) <= 4 GROUP BY w.row, w.col, w.score HAVING w.score = max(n.score)""", "wide")
def w06_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.local_maxima(V.wide(spark, sf_dir), 4).select("row", "col")


@query(f"""WITH {SQL_TRIANGLE}, c AS (SELECT row, col, z, col * 100.0::DOUBLE AS x0, 11900 - row * 100.0::DOUBLE AS y0, col * 100.0::DOUBLE + 100 AS x1, 12000 - row * 100.0::DOUBLE AS y1 FROM v_terrain),
  side AS (SELECT poly_id, ax AS px, ay AS py, bx AS qx, by_ AS qy, cx AS ox, cy AS oy FROM tri UNION ALL SELECT poly_id, bx, by_, cx, cy, ax, ay FROM tri UNION ALL SELECT poly_id, cx, cy, ax, ay, bx, by_ FROM tri),
  apart AS (SELECT c.row, c.col, poly_id, bool_or(CASE WHEN (qx - px) * (oy - py) - (qy - py) * (ox - px) > 0
      THEN greatest((qx - px) * (y0 - py) - (qy - py) * (x0 - px), (qx - px) * (y1 - py) - (qy - py) * (x0 - px), (qx - px) * (y0 - py) - (qy - py) * (x1 - px), (qx - px) * (y1 - py) - (qy - py) * (x1 - px)) < 0
      ELSE least((qx - px) * (y0 - py) - (qy - py) * (x0 - px), (qx - px) * (y1 - py) - (qy - py) * (x0 - px), (qx - px) * (y0 - py) - (qy - py) * (x1 - px), (qx - px) * (y1 - py) - (qy - py) * (x1 - px)) > 0 END) AS apart
    FROM side JOIN c ON c.x1 >= least(px, qx, ox) AND c.x0 <= greatest(px, qx, ox) AND c.y1 >= least(py, qy, oy) AND c.y0 <= greatest(py, qy, oy) GROUP BY 1, 2, 3)
  SELECT c.row, c.col, z FROM c WHERE EXISTS (SELECT 1 FROM apart a WHERE a.row = c.row AND a.col = c.col AND NOT apart)""", "terrain", "tenure")
def f01_area_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that an area of triangles touches, be it with a corner."""
    area = S.touched_cells(triangles(spark, sf_dir), S.Grid(0.0, 12_000.0, 100.0, 1 << 20, 50))
    return V.terrain(spark, sf_dir).join(area, ["row", "col"], "left_semi").select("row", "col", "z")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 > 4 THEN 3 ELSE 2 END AS points, CASE WHEN s_suppkey % 10 > 4 THEN s_suppkey + 2.0::DOUBLE ELSE s_suppkey + 4.0::DOUBLE END AS second FROM supplier")
def p11_simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines over a peak in their middle: it is kept where it is higher than the tolerance, and the points on the slopes are not."""
    from fernwerk.sources.sinks import simplified

    k = F.col("s_suppkey")
    pts = F.array(*(F.struct((k + i).cast("double").alias("x"), ((2 - abs(i - 2)) * (k % 10) / 8.0).alias("y")) for i in range(5)))
    out = simplified(V.read(spark, sf_dir, "supplier").select(k.alias("k"), pts.alias("pts")), 1.1)
    return out.select("k", F.size("pts").alias("points"), F.col("pts")[1]["x"].alias("second"))


@query("SELECT row, col, CASE WHEN slope IS NULL THEN NULL WHEN slope <= 35 THEN slope END AS slope, coalesce(slope > 35, true) AS rejected FROM v_terrain", "terrain")
def f03_slope_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground steeper than the bound, or of unknown slope, is rejected; the bound itself is not."""
    ok = F.coalesce(F.col("slope") <= 35, F.lit(False))
    return V.terrain(spark, sf_dir).select("row", "col", F.when(ok, F.col("slope")).alias("slope"), (~ok).alias("rejected"))
