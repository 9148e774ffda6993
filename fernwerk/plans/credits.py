"""Queries of the per-cell credits, classes and predicates (M, F, P and A rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernwerk.functions import curves as C, labels as L
from fernwerk.plans import views as V
from fernwerk.plans.views import oracle

ELEVATION = (1300.0, 1500.0, 2100.0, 2500.0)
NDVI = {"hard_min": 0.1, "optimal_min": 0.4, "optimal_max": 0.8, "hard_max": None}
OPENNESS = {"bare": 0.05, "meadow": 1.0, "open_forest": 0.6, "closed_forest": 0.1}
KNOTS = [(0, 0.0), (15, 0.0), (40, 1.0), (150, 1.0), (300, 0.7)]
AFFINITY = {"FD": 1.0, "HW": 0.8, "PL": 0.3, "CW": 0.0, "S": 0.2, "SX": 0.25}
CLOSURE = {"hard_min": 20.0, "optimal_min": 45.0, "optimal_max": 90.0, "hard_max": 100.5}
SUBWEIGHTS = {"elevation": 0.45, "slope": 0.25, "aspect": 0.30}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *names)
        return f

    return add


def r6(c: Column) -> Column:
    """Six places, and no negative zero. The product is rounded, half away from zero, as SQL rounds a DOUBLE; F.round takes the digits
    that the double prints as, which differs where these, or the product, lie on a half."""
    return F.round(c * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)


SQL_TRAPEZOID = """CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {a} OR {x} >= {d} THEN 0 WHEN {x} < {b} THEN ({x} - {a}) / ({b} - {a})
  WHEN {x} > {c} THEN ({d} - {x}) / ({d} - {c}) ELSE 1 END"""
SQL_ELEVATION = SQL_TRAPEZOID.format(x="z", a="1300.0::DOUBLE", b="1500.0::DOUBLE", c="2100.0::DOUBLE", d="2500.0::DOUBLE")
SQL_SLOPE = "CASE WHEN slope IS NULL THEN NULL WHEN slope <= 20 THEN 1 WHEN slope >= 35 THEN 0 ELSE (35 - slope) / 15 END"
SQL_DELTA = "least(((aspect - 202.5) % 360 + 360) % 360, 360 - ((aspect - 202.5) % 360 + 360) % 360)"
SQL_ASPECT = f"CASE WHEN aspect IS NULL THEN NULL WHEN slope < 3 THEN 0.5 WHEN {SQL_DELTA} <= 45 THEN 1 ELSE 0.5 * (1 + cos(pi() * ({SQL_DELTA} - 45) / 135)) END"
SQL_WEIGHTED = "(coalesce(e * 0.45, 0) + coalesce(s * 0.25, 0) + coalesce(a * 0.30, 0)) / nullif((e IS NOT NULL)::INT * 0.45::DOUBLE + (s IS NOT NULL)::INT * 0.25::DOUBLE + (a IS NOT NULL)::INT * 0.30::DOUBLE, 0)"
SQL_TERRAIN = f"SELECT *, {SQL_WEIGHTED} AS terrain FROM (SELECT *, {SQL_ELEVATION} AS e, {SQL_SLOPE} AS s, {SQL_ASPECT} AS a FROM v_terrain)"
SQL_CLOSURE = "CASE WHEN ndmi IS NOT NULL THEN 0.8 * least(greatest((ndmi + 0.2) / 0.5, 0), 1) + 0.2 * (1 - least(greatest((texture - 0.2) / 0.6, 0), 1)) END"
SQL_OPENNESS = "CASE WHEN closure <= 0.5 THEN 1 - 0.8 * closure ELSE 0.6 - (closure - 0.5) END"
SQL_NDVI_FIT = "CASE WHEN ndvi IS NULL THEN NULL WHEN ndvi <= 0.1 THEN 0 WHEN ndvi < 0.4 THEN (ndvi - 0.1) / (0.4::DOUBLE - 0.1::DOUBLE) ELSE 1 END"
SQL_AGE = "CASE WHEN {x} IS NULL THEN 0.5 WHEN {x} <= 15 THEN 0 WHEN {x} <= 40 THEN ({x} - 15) / 25 WHEN {x} <= 150 THEN 1 WHEN {x} <= 300 THEN 1 - ({x} - 150) * 0.002 ELSE 0.7 END"
SQL_AFFINITY = "CASE WHEN {c} IS NULL THEN 0 WHEN upper(trim({c})) LIKE 'SX%' THEN 0.25 WHEN upper(trim({c})) LIKE 'FD%' THEN 1 WHEN upper(trim({c})) LIKE 'HW%' THEN 0.8 WHEN upper(trim({c})) LIKE 'PL%' THEN 0.3 WHEN upper(trim({c})) LIKE 'CW%' THEN 0 WHEN upper(trim({c})) LIKE 'S%' THEN 0.2 ELSE 0.1 END"


def terrain_parts() -> dict[str, Column]:
    return {"elevation": C.trapezoid(F.col("z"), *ELEVATION), "slope": C.trapezoid(F.col("slope"), None, 0, 20, 35), "aspect": C.aspect_score(F.col("aspect"), F.col("slope"), 202.5, 45, 3)}


def closure() -> Column:
    return C.canopy_closure(F.col("ndmi"), F.col("texture"), -0.2, 0.3, 0.2, 0.2, 0.8)


@query(f"SELECT row, col, round({SQL_ELEVATION}, 6) + 0.0::DOUBLE AS credit FROM v_terrain", "terrain")
def m01_trapezoid_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.trapezoid(F.col("z"), *ELEVATION)).alias("credit"))


@query("SELECT row, col, round(CASE WHEN slope IS NULL THEN NULL ELSE least(greatest((45 - slope) / 35, 0), 1) END, 6) + 0.0::DOUBLE AS credit FROM v_terrain", "terrain")
def m02_ramp_down_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.ramp_down(F.col("slope"), 10, 45)).alias("credit"))


@query(f"SELECT row, col, round({SQL_ASPECT}, 6) + 0.0::DOUBLE AS credit FROM v_terrain", "terrain")
def m03_aspect_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(terrain_parts()["aspect"]).alias("credit"))


@query(f"SELECT row, col, round(terrain, 6) + 0.0::DOUBLE AS score FROM ({SQL_TERRAIN})", "terrain")
def m04_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.terrain(spark, sf_dir).withColumns({f"_{k}": v for k, v in terrain_parts().items()})
    return t.select("row", "col", r6(C.weighted_mean({k: F.col(f"_{k}") for k in terrain_parts()}, SUBWEIGHTS)).alias("score"))


@query("SELECT row, col, round(least(greatest((ndvi - 0.1) / 0.4, 0), 1), 6) + 0.0::DOUBLE AS x FROM v_terrain WHERE ndvi IS NOT NULL UNION ALL SELECT row, col, NULL FROM v_terrain WHERE ndvi IS NULL", "terrain")
def m05_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.linear(F.col("ndvi"), 0.1, 0.5)).alias("x"))


@query(f"SELECT row, col, round(CASE WHEN closure IS NOT NULL THEN {SQL_OPENNESS} END, 6) + 0.0::DOUBLE AS credit FROM (SELECT *, {SQL_CLOSURE} AS closure FROM v_terrain)", "terrain")
def m06_openness_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = [(0, OPENNESS["meadow"]), (0.5, OPENNESS["open_forest"]), (1, OPENNESS["closed_forest"])]
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.piecewise(closure(), knots)).alias("credit"))


@query(f"SELECT stand_id, round({SQL_AGE.format(x='age')}, 6) + 0.0::DOUBLE AS credit FROM v_stands", "stands")
def m07_age_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stands(spark, sf_dir).select("stand_id", r6(C.age_credit(F.col("age"), KNOTS, 0.5)).alias("credit"))


SQL_SPEED = "6 * exp(-3.5 * abs(tan(radians(slope)) + 0.05))"


@query(f"SELECT row, col, round({SQL_SPEED}, 6) + 0.0::DOUBLE AS kmh FROM v_terrain", "terrain")
def m08_hike_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.hiking_speed(F.col("slope"))).alias("kmh"))


@query(f"""SELECT row, col, round(CASE WHEN row % 7 = 0 THEN 1e-6 WHEN slope IS NULL OR slope > 45 THEN 1e4
  ELSE 60 / (least(greatest({SQL_SPEED}, 0.05), 8) * 1000) * CASE WHEN col % 5 = 0 THEN 1 ELSE 1.6 END END, 9) + 0.0::DOUBLE AS cost FROM v_terrain""", "terrain")
def m09_cost_per_metre(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = C.cost_per_metre(F.col("slope"), F.col("col") % 5 == 0, F.col("row") % 7 == 0)
    return V.terrain(spark, sf_dir).select("row", "col", (F.round(cost, 9) + F.lit(0.0)).alias("cost"))


@query("""SELECT row, col, round(CASE WHEN NOT no_water AND water_m <= 350 THEN 0.1 + 0.9 * (0.7 * least(greatest((397 - water_m) / 314, 0), 1)
  + 0.3 * least(greatest((6.2::DOUBLE - tpi) / (6.2::DOUBLE + 4.1::DOUBLE), 0), 1)) END + 0 * tpi, 6) + 0.0::DOUBLE AS credit FROM v_terrain""", "terrain")
def m10_moisture_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    credit = C.moisture_credit(F.col("water_m"), F.col("no_water"), F.col("tpi"), 83, 397, -4.1, 6.2, 0.7, 0.3, 0.1, 350)
    return V.terrain(spark, sf_dir).select("row", "col", r6(credit).alias("credit"))


@query(f"SELECT row, col, round({SQL_CLOSURE}, 6) + 0.0::DOUBLE AS closure FROM v_terrain", "terrain")
def m11_canopy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(closure()).alias("closure"))


@query(f"""SELECT row, col, round(CASE WHEN closure IS NULL OR ndvi < 0.1 THEN NULL ELSE ({SQL_NDVI_FIT}) * ({SQL_OPENNESS}) END, 6) + 0.0::DOUBLE AS score
  FROM (SELECT *, {SQL_CLOSURE} AS closure FROM v_terrain)""", "terrain")
def m12_vegetation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.vegetation_score(F.col("ndvi"), closure(), NDVI, OPENNESS)).alias("score"))


@query("SELECT row, col, round(CASE WHEN logged_age IS NULL THEN 1 ELSE 0.3 + 0.7 * least(logged_age / 45, 1) END, 6) + 0.0::DOUBLE AS penalty FROM v_terrain", "terrain")
def m13_clearcut_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.clearcut_penalty(F.col("logged_age"), 0.3, 45)).alias("penalty"))


SQL_VEG_CLASS = f"""SELECT row, col, CASE WHEN ndvi IS NULL OR closure IS NULL THEN 0 WHEN ndvi < 0.1 THEN 1
  WHEN closure >= 2.0::DOUBLE / 3 THEN 4 WHEN closure >= 1.0::DOUBLE / 3 THEN 3 WHEN logged_age < 45 THEN 5 ELSE 2 END AS class
  FROM (SELECT *, {SQL_CLOSURE} AS closure FROM v_terrain)"""


def vegetation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", C.vegetation_class(F.col("ndvi"), closure(), 0.1, F.col("logged_age"), 45).alias("class"))


@query(SQL_VEG_CLASS, "terrain")
def m14_vegetation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vegetation_classes(spark, sf_dir)


@query("""SELECT scene, frow, fcol, round(CASE WHEN scl IN (4, 5, 7) AND abs(x) <= 1 THEN x END, 6) + 0.0::DOUBLE AS ndvi FROM (
  SELECT *, (nir - red) / nullif(nir + red - 2000, 0) AS x FROM v_pixels)""", "pixels")
def m15_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    nir, red = ((F.col(b) - 1000) / 10000 for b in ("nir", "red"))
    kept = F.when(F.col("scl").isin(4, 5, 7), C.normalised_difference(nir, red))
    return V.pixels(spark, sf_dir).select("scene", "frow", "fcol", r6(kept).alias("ndvi"))


def forests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stands with host share, treed flag and effective age."""
    species = V.stand_species(spark, sf_dir)
    share = F.coalesce(F.col("pct"), F.lit(0.0)) / 100 * F.coalesce(L.longest_prefix(F.col("code"), AFFINITY, 0.1), F.lit(0.0))
    host = species.groupBy("stand_id").agg(F.sum(share).alias("share"), F.max(F.when(F.col("slot") == 1, F.col("code").isNotNull())).alias("named"))
    s = V.stands(spark, sf_dir).join(host, "stand_id", "left")
    treed = F.coalesce(F.upper(F.trim("level2")) == "T", F.col("named"), F.lit(False))
    s = s.withColumn("treed", treed)
    return s.select("stand_id", "treed", "closure", F.when(treed, C.clip(F.coalesce("share", F.lit(0.0)), 0, 1)).otherwise(F.lit(0.0)).alias("host"), F.when(treed, F.least("age", "harvest_age")).alias("stand_age"))


SQL_FORESTS = f"""WITH h AS (SELECT stand_id, sum(coalesce(pct, 0) / 100 * ({SQL_AFFINITY.format(c='code')})) AS share, bool_or(slot = 1 AND code IS NOT NULL) AS named FROM v_stand_species GROUP BY 1),
f AS (SELECT s.stand_id, coalesce(upper(level2) = 'T', named, false) AS treed, closure, share, age, harvest_age FROM v_stands s LEFT JOIN h ON s.stand_id = h.stand_id),
forests AS (SELECT stand_id, treed, closure, CASE WHEN treed THEN least(greatest(coalesce(share, 0), 0), 1) ELSE 0 END AS host, CASE WHEN treed THEN least(age, harvest_age) END AS stand_age FROM f)
"""
SQL_CLOSURE_CREDIT = SQL_TRAPEZOID.format(x="closure", a="20.0::DOUBLE", b="45.0::DOUBLE", c="90.0::DOUBLE", d="100.5::DOUBLE")


@query(SQL_FORESTS + "SELECT stand_id, treed, round(host, 6) + 0.0::DOUBLE AS host FROM forests", "stands", "stand_species")
def a03_host_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forests(spark, sf_dir).select("stand_id", "treed", r6(F.col("host")).alias("host"))


@query(SQL_FORESTS + "SELECT count(*) AS stands, count_if(treed) AS treed, count_if(NOT treed) AS open_ground FROM forests", "stands", "stand_species")
def a04_treed_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forests(spark, sf_dir).agg(F.count(F.lit(1)).alias("stands"), F.count_if("treed").alias("treed"), F.count_if(~F.col("treed")).alias("open_ground"))


@query(SQL_FORESTS + "SELECT stand_id, stand_age FROM forests", "stands", "stand_species")
def a05_stand_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forests(spark, sf_dir).select("stand_id", "stand_age")


@query(SQL_FORESTS + f"""SELECT stand_id, round(CASE WHEN host >= 0.2 THEN least(host / 0.6, 1) * ({SQL_AGE.format(x='stand_age')}) * coalesce({SQL_CLOSURE_CREDIT}, 0.5) END, 6) + 0.0::DOUBLE AS score
  FROM forests""", "stands", "stand_species")
def m16_forest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = C.forest_score(F.col("host"), F.col("stand_age"), F.col("closure"), F.lit(True), 0.6, 0.2, KNOTS, CLOSURE)
    return forests(spark, sf_dir).select("stand_id", r6(score).alias("score"))


@query(SQL_FORESTS + f"""SELECT stand_id, CASE WHEN stand_id % 29 = 0 THEN 0 WHEN NOT treed THEN 1 WHEN host < 0.2 THEN 2
  WHEN stand_age IS NOT NULL AND ({SQL_AGE.format(x='stand_age')}) <= 0 THEN 5 WHEN host >= 0.6 THEN 4 ELSE 3 END AS class FROM forests""", "stands", "stand_species")
def m17_forest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = C.forest_class(F.col("host"), F.col("treed"), F.col("stand_id") % 29 != 0, F.col("stand_age"), C.age_credit(F.col("stand_age"), KNOTS, 0.5), 0.6, 0.2)
    return forests(spark, sf_dir).select("stand_id", cls.alias("class"))


@query("""SELECT row, col, round((coalesce(0.4 * d, 0) + coalesce(0.6 * h, 0)) / nullif((d IS NOT NULL)::INT * 0.4::DOUBLE + (h IS NOT NULL)::INT * 0.6::DOUBLE, 0), 6) + 0.0::DOUBLE AS score FROM (
  SELECT row, col, CASE WHEN slope IS NOT NULL THEN least(greatest((90 - slope * 3) / 67.5, 0), 1) END AS d,
    CASE WHEN water_m IS NOT NULL THEN least(greatest((6 - water_m / 100) / 5.75, 0), 1) END AS h FROM v_terrain)""", "terrain")
def m18_access_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = C.access_score(F.col("slope") * 3, F.col("water_m") / 100, {"drive": 0.4, "hike": 0.6})
    return V.terrain(spark, sf_dir).select("row", "col", r6(score).alias("score"))


@query("""SELECT row, col, round(0.5 + 0.5 * least(greatest(texture / 40 * 2 * pi() * 9, 0), 1), 6) + 0.0::DOUBLE AS score FROM v_terrain""", "terrain")
def m19_observation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", r6(C.observation_score(F.col("texture") / 40, 3.0, 0.5)).alias("score"))


SQL_STOPS = "CASE WHEN t <= 0.25 THEN {a} + ({b} - {a}) * t / 0.25 WHEN t <= 0.5 THEN {b} + ({c} - {b}) * (t - 0.25) / 0.25 WHEN t <= 0.75 THEN {c} + ({d} - {c}) * (t - 0.5) / 0.25 ELSE {d} + ({e} - {d}) * (t - 0.75) / 0.25 END"
SQL_RGB = [SQL_STOPS.format(a=a, b=b, c=c, d=d, e=e) for a, b, c, d, e in ((68, 59, 33, 94, 253), (1, 82, 145, 201, 231), (84, 139, 140, 98, 37))]


@query("SELECT i, " + ", ".join(f"CAST(floor({s} + 1e-9) AS INT) AS {n}" for s, n in zip(SQL_RGB, "rgb")) + " FROM (SELECT CAST(range AS INT) AS i, range / 255.0::DOUBLE AS t FROM range(256))")
def m20_colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("i") / F.lit(255.0)
    parts = [F.floor(C.piecewise(t, [(s[0], s[k]) for s in L.SCORE_STOPS]) + 1e-9).cast("int").alias(n) for k, n in ((1, "r"), (2, "g"), (3, "b"))]
    return spark.range(256).select(F.col("id").cast("int").alias("i")).select("i", *parts)


@query("SELECT row, col, 'rgb(' || " + " || ',' || ".join(f"CAST(floor({s} + 0.5) AS BIGINT)" for s in SQL_RGB) + " || ')' AS colour, round(5 + least(sqrt(CASE WHEN a = 0 THEN 1 ELSE a END) * 1.4, 9), 6) AS radius FROM (SELECT row, col, score AS t, floor(score * 60) AS a FROM v_wide)", "wide")
def m21_pin_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.wide(spark, sf_dir).select("row", "col", L.score_colour(F.col("score")).alias("colour"), r6(L.pin_radius(F.floor(F.col("score") * 60).cast("double"))).alias("radius"))


@query("""SELECT id, CASE WHEN taxon IS NULL OR taxon = '' THEN 0.5 WHEN taxon = 'Arnica cordifolia' THEN 0.2
  WHEN taxon = 'Arnica latifolia' OR taxon LIKE 'Arnica latifolia %' THEN 1 ELSE 0.5 END::DOUBLE AS weight FROM v_observations""", "observations")
def m22_record_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observations(spark, sf_dir).select("id", L.record_weight(F.col("taxon"), "Arnica latifolia", ["Arnica cordifolia"]).alias("weight"))


_CODE = {k: i + 1 for i, k in enumerate(sorted(L.TREE_NAMES))}
SQL_CODE = "CASE WHEN code IS NULL OR trim(code) = '' THEN 0 " + " ".join(f"WHEN upper(trim(code)) LIKE '{k}%' THEN {v}" for k, v in sorted(_CODE.items(), key=lambda x: -len(x[0]))) + " ELSE 255 END"
SQL_NAME = "CASE " + " ".join(f"WHEN c = {v} THEN '{L.TREE_NAMES[k]}'" for k, v in _CODE.items()) + " WHEN c = 255 THEN 'other' END"


@query(f"SELECT stand_id, slot, c AS tree, ({SQL_NAME}) || coalesce(' ' || CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR) || '%', '') AS label FROM (SELECT *, {SQL_CODE} AS c FROM v_stand_species)", "stand_species")
def m23_leading_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stand_species(spark, sf_dir).withColumn("tree", L.tree_code(F.col("code"))).select("stand_id", "slot", "tree", L.tree_label(F.col("tree"), F.col("pct")).alias("label"))


@query("""SELECT row, col, CASE WHEN aspect IS NULL THEN 'n/a' ELSE (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(trunc(aspect / 22.5 + 0.5) AS INT) % 16 + 1] END AS wind FROM v_terrain""", "terrain")
def p09_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", L.compass(F.col("aspect")).alias("wind"))


@query("""SELECT stand_id, slot, code, round(CASE WHEN code IS NOT NULL THEN """ + SQL_AFFINITY.format(c="code") + """ END, 6) + 0.0::DOUBLE AS affinity FROM v_stand_species""", "stand_species")
def j14_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stand_species(spark, sf_dir).select("stand_id", "slot", "code", r6(L.longest_prefix(F.col("code"), AFFINITY, 0.1)).alias("affinity"))


@query(f"WITH c AS ({SQL_VEG_CLASS}) SELECT CAST(k.class AS INT) AS class, name, count(c.row) AS cells, round(count(c.row)::DOUBLE / nullif((SELECT count(*) FROM c), 0), 6) AS share FROM (VALUES (0, 'unknown'), (1, 'bare'), (2, 'meadow'), (3, 'open forest'), (4, 'closed forest'), (5, 'cutblock')) k(class, name) LEFT JOIN c ON c.class = k.class GROUP BY ALL", "terrain")
def a07_class_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class, those without cells too, and its share."""
    names = spark.createDataFrame(list(L.VEGETATION_CLASSES.items()), "class int, name string")
    count = vegetation_classes(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("cells"))
    total = count.agg(F.sum("cells").alias("total"))
    return F.broadcast(names).join(count, "class", "left").join(F.broadcast(total), how="cross").select("class", "name", F.coalesce("cells", F.lit(0)).alias("cells"), F.round(F.coalesce("cells", F.lit(0)) / F.col("total"), 6).alias("share"))


@query("""SELECT count(*) AS cells, round(avg((ndvi IS NOT NULL)::INT), 6) AS ndvi_share, round(avg((ndmi IS NOT NULL)::INT), 6) AS ndmi_share,
  round(avg(coalesce(water_m <= 350, false)::INT), 6) AS near_water FROM v_terrain""", "terrain")
def a22_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return V.terrain(spark, sf_dir).agg(F.count(F.lit(1)).alias("cells"), share(F.col("ndvi").isNotNull()).alias("ndvi_share"), share(F.col("ndmi").isNotNull()).alias("ndmi_share"), share(F.col("water_m") <= 350).alias("near_water"))
