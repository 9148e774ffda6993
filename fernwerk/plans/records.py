"""Queries of validation statistics, record accounting, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fernwerk.functions import labels as L
from fernwerk.operators import sites as Z, stats as A
from fernwerk.plans import views as V
from fernwerk.plans.credits import r6
from fernwerk.plans.layers import SQL_ALBERS, albers
from fernwerk.plans.routes import SQL_SITES, ranked_sites
from fernwerk.plans.views import oracle
from fernwerk.sources import profiles as P, sinks as K, tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *names)
        return f

    return add


#: Replicates of the cluster bootstrap and of the permutation test.
REPLICATES, PERMUTATIONS = 2_000, 10_000
SURFACES = {"score": "round(o_totalprice / 1000)", "terrain": "o_totalprice % 977", "aspect": "o_orderkey % 101"}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, unit, positive, cluster, rejected, value): orders by status, with ties and rejects."""
    o = V.read(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    value = F.expr("stack(3, " + ", ".join(f"'{k}', cast({v} as double)" for k, v in SURFACES.items()) + ") as (surface, value)")
    return o.select(F.col("o_orderkey").alias("unit"), (F.col("o_orderstatus") == "F").alias("positive"), (F.col("o_custkey") % 40).alias("cluster"), (F.col("o_orderkey") % 17 == 0).alias("rejected"), value)


SQL_SAMPLES = """s AS (SELECT o_orderkey AS unit, o_orderstatus = 'F' AS positive, o_custkey % 40 AS cluster, o_orderkey % 17 = 0 AS rejected, k.surface,
  CASE k.surface WHEN 'score' THEN round(o_totalprice / 1000) WHEN 'terrain' THEN o_totalprice % 977 ELSE (o_orderkey % 101)::DOUBLE END AS value
  FROM orders, (VALUES ('score'), ('terrain'), ('aspect')) k(surface) WHERE o_orderstatus IN ('F', 'O'))"""


@query(f"""WITH {SQL_SAMPLES}, v AS (SELECT surface, positive, CASE WHEN rejected THEN -1e300 ELSE value END AS value FROM s), r AS (SELECT *, rank() OVER (PARTITION BY surface ORDER BY value) + (count(*) OVER (PARTITION BY surface, value) - 1) / 2 AS rk FROM v)
  SELECT surface, round((sum(CASE WHEN positive THEN rk END) - count_if(positive) * (count_if(positive) + 1) / 2) / (count_if(positive) * count_if(NOT positive)), 9) AS auc, count_if(positive) AS n_pos, count_if(NOT positive) AS n_neg FROM r GROUP BY 1""")
def a13_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.auc(samples(spark, sf_dir), "value", "positive", ["surface"], "rejected")
    return out.select("surface", F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query(f"""WITH {SQL_SAMPLES}, g AS (SELECT value, count_if(NOT positive) AS n FROM s WHERE surface = 'score' GROUP BY 1),
  b AS (SELECT value, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER () AS total FROM g)
  SELECT unit, round(below::DOUBLE / total, 9) AS percentile FROM s JOIN b ON b.value = s.value WHERE surface = 'score' AND positive""")
def a14_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("surface = 'score'")
    out = A.percentile_rank(s.where("positive").select("unit", "value"), "value", s.where("not positive").select("value"), "value")
    return out.select("unit", F.round("percentile", 9).alias("percentile"))


@query(f"WITH {SQL_SAMPLES} SELECT positive, count(DISTINCT cluster) AS units, count(*) AS records FROM s WHERE surface = 'score' GROUP BY 1")
def a15_effective_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("surface = 'score'").groupBy("positive").agg(F.count_distinct("cluster").alias("units"), F.count(F.lit(1)).alias("records"))


@query(f"WITH {SQL_SAMPLES} SELECT surface, positive, cluster, round(avg(value), 6) AS mean FROM s GROUP BY 1, 2, 3")
def a16_cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("surface", "positive", "cluster").agg(r6(F.avg("value")).alias("mean"))


SQL_DRAW = "((({r} * 7919 + {i} * 104729 + 20240802) % 2147483647 * 48271) % 2147483647 * 69621) % 2147483647"
#: Pairs in order of each pair of clusters, then weighted by how often a replicate draws them: another way than the query's.
SQL_BOOT = f"""{SQL_SAMPLES}, c AS (SELECT positive, cluster, row_number() OVER (PARTITION BY positive ORDER BY cluster) - 1 AS i, count(*) OVER (PARTITION BY positive) AS n FROM (SELECT DISTINCT positive, cluster FROM s)),
  d AS (SELECT replicate, positive, i, count(*) AS w FROM (SELECT r.replicate, c.positive, {SQL_DRAW.format(r='r.replicate', i='(c.i * 2 + c.positive::INT)')} % c.n AS i FROM c, (SELECT range AS replicate FROM range({REPLICATES})) r) GROUP BY 1, 2, 3),
  x AS (SELECT s.surface, s.positive, c.i, s.value, count(*) AS m FROM s JOIN c ON c.positive = s.positive AND c.cluster = s.cluster GROUP BY 1, 2, 3, 4),
  u AS (SELECT p.surface, p.i, q.i AS j, sum(p.m * q.m * CASE WHEN q.value < p.value THEN 1 WHEN q.value = p.value THEN 0.5::DOUBLE ELSE 0 END) AS u, sum(p.m * q.m) AS pairs FROM x p JOIN x q ON q.surface = p.surface AND p.positive AND NOT q.positive GROUP BY 1, 2, 3),
  boot AS (SELECT u.surface, a.replicate, sum(a.w * b.w * u.u) / sum(a.w * b.w * u.pairs) AS auc FROM u JOIN d a ON a.positive AND a.i = u.i JOIN d b ON NOT b.positive AND b.i = u.j AND b.replicate = a.replicate GROUP BY 1, 2)"""


@query(f"WITH {SQL_BOOT} SELECT surface, replicate, round(auc, 8) AS auc FROM boot")
def a18_bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bootstrap_auc(samples(spark, sf_dir), REPLICATES).select("surface", "replicate", F.round("auc", 8).alias("auc"))


@query(f"WITH {SQL_BOOT} SELECT surface, round(quantile_cont(auc, 0.025), 7) AS low, round(quantile_cont(auc, 0.975), 7) AS high, count(*) AS replicates FROM boot GROUP BY 1")
def a17_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.interval(A.bootstrap_auc(samples(spark, sf_dir), REPLICATES), ["surface"])
    return out.select("surface", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), "replicates")


@query(f"""WITH {SQL_BOOT}, dd AS (SELECT a.replicate, a.auc - b.auc AS diff FROM boot a JOIN boot b USING (replicate) WHERE a.surface = 'score' AND b.surface = 'terrain'), q AS (SELECT quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high FROM dd)
  SELECT round(low, 7) + 0.0::DOUBLE AS low, round(high, 7) + 0.0::DOUBLE AS high, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'no clear difference' END AS verdict FROM q""")
def a23_paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    boot = A.bootstrap_auc(samples(spark, sf_dir), REPLICATES)
    wide = boot.groupBy("replicate").pivot("surface", ["score", "terrain"]).agg(F.first("auc"))
    q = A.interval(wide.select((F.col("score") - F.col("terrain")).alias("auc")).withColumn("g", F.lit(1)), ["g"])
    verdict = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("no clear difference")
    return q.select((F.round("low", 7) + 0.0).alias("low"), (F.round("high", 7) + 0.0).alias("high"), verdict.alias("verdict"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("surface = 'score'").groupBy("positive", "cluster").agg(r6(F.avg("value")).alias("value"))
    return s.select((F.col("cluster") * 2 + F.col("positive").cast("int")).alias("unit"), "positive", "value")


@query(f"""WITH {SQL_SAMPLES}, u AS (SELECT cluster * 2 + positive::INT AS unit, positive, round(avg(value), 6) AS value FROM s WHERE surface = 'score' GROUP BY cluster, positive),
  i AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS i FROM u), k AS (SELECT count_if(positive) AS k, count(*) AS n FROM u),
  h AS (SELECT replicate, value, row_number() OVER (PARTITION BY replicate ORDER BY {SQL_DRAW.format(r='replicate', i='i')}, i) AS place FROM i, (SELECT range AS replicate FROM range({PERMUTATIONS})) r),
  a AS (SELECT replicate, rank() OVER (PARTITION BY replicate ORDER BY value) + (count(*) OVER (PARTITION BY replicate, value) - 1) / 2 AS rk, place <= k AS up FROM h, k),
  p AS (SELECT replicate, (sum(CASE WHEN up THEN rk END) - k * (k + 1) / 2) / (k * (n - k)) AS auc FROM a, k GROUP BY replicate, k, n),
  o AS (SELECT (sum(CASE WHEN positive THEN rk END) - k * (k + 1) / 2) / (k * (n - k)) AS observed FROM (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM u), k GROUP BY k, n)
  SELECT round(observed, 9) AS observed, count_if(auc >= observed - 1e-12) AS hits, round((count_if(auc >= observed - 1e-12) + 1) / ({PERMUTATIONS} + 1.0::DOUBLE), 9) AS p FROM p, o GROUP BY observed""")
def a19_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.permutation_p(units(spark, sf_dir), PERMUTATIONS)
    return out.select(F.round("observed", 9).alias("observed"), "hits", F.round("p", 9).alias("p"))


ROLES = {"target": "Arnica latifolia", "contrast": "Arnica cordifolia"}


def _role() -> F.Column:
    return F.when(L.is_target(F.col("taxon"), ROLES["target"]), "target").when(L.is_target(F.col("taxon"), ROLES["contrast"]), "contrast").alias("role")


@query("""SELECT role, count(*) AS in_aoi, count_if(obs) AS obscured, count_if(NOT obs AND NOT precise) AS imprecise, count_if(NOT obs AND precise) AS usable FROM (
  SELECT role, coalesce(obscured, false) AS obs, coalesce(accuracy_m <= 100, false) AS precise FROM v_observations JOIN (VALUES ('target', 'Arnica latifolia'), ('contrast', 'Arnica cordifolia')) r(role, name) ON taxon = name OR taxon LIKE name || ' %') GROUP BY 1""", "observations")
def a21_record_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.observations(spark, sf_dir).withColumn("role", _role()).where("role is not null")
    obscured, precise = F.coalesce("obscured", F.lit(False)), F.coalesce(F.col("accuracy_m") <= 100, F.lit(False))
    return o.groupBy("role").agg(F.count(F.lit(1)).alias("in_aoi"), F.count_if(obscured).alias("obscured"), F.count_if(~obscured & ~precise).alias("imprecise"), F.count_if(~obscured & precise).alias("usable"))


@query("""SELECT role, count(*) AS n, round(median(z), 6) AS median, min(z) AS low, max(z) AS high FROM (SELECT CASE WHEN taxon = 'Arnica cordifolia' THEN 'contrast' ELSE 'target' END AS role, CAST(trunc(y / 300) AS INT) AS r, CAST(trunc(x / 300) AS INT) AS c
  FROM v_observations WHERE taxon LIKE 'Arnica latifolia%' OR taxon = 'Arnica cordifolia') o JOIN v_terrain t ON t.row = r AND t.col = c AND z IS NOT NULL GROUP BY 1""", "observations", "terrain")
def a24_elevation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = V.observations(spark, sf_dir).select(_role(), (F.col("y") / 300).cast("int").alias("row"), (F.col("x") / 300).cast("int").alias("col")).where("role is not null")
    out = A.group_summary(rec.join(V.terrain(spark, sf_dir).select("row", "col", "z"), ["row", "col"]), "role", "z")
    return out.select("role", "n", r6(F.col("median")).alias("median"), "low", "high")


@query(f"WITH {SQL_SAMPLES} SELECT count(DISTINCT CASE WHEN positive THEN cluster END) >= 10 AS enough_target, count(DISTINCT CASE WHEN NOT positive THEN cluster END) >= 5 AS enough_contrast FROM s")
def a25_sample_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sample_guard(samples(spark, sf_dir))


TERRAIN = {"elevation_m": {"hard_min": 1000, "optimal_min": 1300, "optimal_max": 2000, "hard_max": 2450}, "slope_deg": {"optimal_min": 2, "optimal_max": 20, "hard_max": 40}, "aspect": {"optimal_bearing_deg": 200, "tolerance_deg": 60, "flat_slope_deg": 3}}
SURFACE_WEIGHTS = {"terrain": 0.4, "vegetation": 0.35, "moisture": 0.25}
SQL_TRAPEZOID = "CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {a} OR {x} >= {d} THEN 0 WHEN {x} < {b} THEN ({x} - {a}) / ({b} - {a})::DOUBLE WHEN {x} <= {c} THEN 1 ELSE ({d} - {x}) / ({d} - {c})::DOUBLE END"


def scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain with a score of each layer, as the build's layers have them."""
    t = V.terrain(spark, sf_dir)
    return t.select("row", "col", "z", "slope", "aspect", (F.lit(1) - F.col("slope") / 48).alias("score_terrain"), ((F.col("ndvi") + 0.6) / 2).alias("score_vegetation"), ((F.col("ndmi") + 0.6) / 1.6).alias("score_moisture"))


@query(f"""WITH p AS (SELECT row, col, z, slope, aspect, 1 - slope / 48 AS t, (ndvi + 0.6) / 2 AS v, (ndmi + 0.6) / 1.6 AS m FROM v_terrain),
  l AS (SELECT *, CASE WHEN t + v + m IS NOT NULL THEN (0.4::DOUBLE * t + 0.35::DOUBLE * v + 0.25::DOUBLE * m) / (0.4::DOUBLE + 0.35::DOUBLE + 0.25::DOUBLE) END AS h, {SQL_TRAPEZOID.format(x='z', a=1000, b=1300, c=2000, d=2450)} AS e,
    CASE WHEN slope IS NULL THEN NULL WHEN slope >= 40 THEN 0 WHEN slope < 2 THEN slope / 2 WHEN slope <= 20 THEN 1 ELSE (40 - slope) / 20 END AS s FROM p)
  SELECT row, col, k.surface, round(CASE k.surface WHEN 'habitat' THEN h WHEN 'terrain' THEN t WHEN 'elevation' THEN e WHEN 'vegetation' THEN v ELSE m END, 6) + 0.0::DOUBLE AS value FROM l, (VALUES ('habitat'), ('terrain'), ('elevation'), ('vegetation'), ('moisture')) k(surface)""", "terrain")
def c10_candidate_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surface worth testing, of every cell; slope and aspect fits have queries of their own (m01, m03)."""
    out = Z.candidate_surfaces(scored_cells(spark, sf_dir), "vegetation", ["moisture"], SURFACE_WEIGHTS, TERRAIN)
    return out.where(~F.col("surface").isin("slope", "aspect")).select("row", "col", "surface", r6(F.col("value")).alias("value"))


@query(f"SELECT row, col FROM v_wide ORDER BY {SQL_DRAW.format(r='row::BIGINT', i='col::BIGINT')}, row, col LIMIT 10000", "wide")
def c11_random_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 cells, no cell twice; the choice is by a hash of row and column."""
    return A.random_cells(V.wide(spark, sf_dir).select("row", "col"), 10_000)


@query("SELECT rec.id, t.z FROM (SELECT id, CAST(trunc(y / 300) AS INT) AS row, CAST(trunc(x / 300) AS INT) AS col FROM v_observations) rec JOIN v_terrain t ON t.row = rec.row AND t.col = rec.col WHERE t.z IS NOT NULL", "observations", "terrain")
def j18_sampled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the value of the cell they lie in, where there is one."""
    rec = V.observations(spark, sf_dir).select("id", (F.col("y") / 300).cast("int").alias("row"), (F.col("x") / 300).cast("int").alias("col"))
    return rec.join(V.terrain(spark, sf_dir).where("z is not null").select("row", "col", "z"), ["row", "col"]).select("id", "z")


# sources


@query("SELECT poly_id FROM v_tenure WHERE col1 >= 5 AND col0 <= 20 AND row1 >= 3 AND row0 <= 18 AND layer <> 'national'", "tenure")
def s05_layer_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = V.tenure(spark, sf_dir).unionByName(V.tenure(spark, sf_dir)).withColumnsRenamed({"poly_id": "FEATURE_ID"})
    found = T.in_bounds(layer, (5, 3, 20, 18), ("col0", "row0", "col1", "row1"), "layer <> 'national'")
    return T.first_by_id(found, "FEATURE_ID", ["layer", "row0"]).select(F.col("FEATURE_ID").alias("poly_id"))


@query("""WITH p AS (SELECT id, x, y FROM v_observations), l AS (SELECT id, d.range AS depth, CAST(floor(x / (16000 / 2 ** d.range)) AS BIGINT) AS tx, CAST(floor(y / (16000 / 2 ** d.range)) AS BIGINT) AS ty FROM p, range(7) d),
  n AS (SELECT depth, tx, ty, count(*) AS n FROM l GROUP BY 1, 2, 3), own AS (SELECT l.id, min(l.depth) AS depth FROM l JOIN n ON n.depth = l.depth AND n.tx = l.tx AND n.ty = l.ty WHERE n.n <= 40 OR l.depth = 6 GROUP BY 1)
  SELECT CAST(l.depth AS INT) AS depth, l.tx, l.ty, count(*) AS features FROM own JOIN l ON l.id = own.id AND l.depth = own.depth GROUP BY 1, 2, 3""", "observations")
def s06_split_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the records' square, split until each holds at most 40 of them or has been split six times."""
    return T.quadrant_tiles(V.observations(spark, sf_dir), (0.0, 0.0, 16_000.0, 16_000.0), 40, 6)


@query(f"WITH {SQL_ALBERS} SELECT round(min(least(x, 1600000)) - 5000, 3) AS west, round(min(least(y, 500000)) - 5000, 3) AS south, round(max(greatest(x, 1600000)) + 5000, 3) AS east, round(max(greatest(y, 500000)) + 5000, 3) AS north FROM ab", "observations")
def s10_buffered_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around the records in Albers metres and one more place, widened by five kilometres."""
    return T.buffered_bounds(albers(spark, sf_dir), 5000.0, (1_600_000.0, 500_000.0))


@query("SELECT l_partkey AS cell, arg_min(z, tile) AS z FROM (SELECT l_partkey, l_suppkey % 5 AS tile, max(l_quantity) AS z FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2) GROUP BY 1")
def s11_first_finite_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), (F.col("l_suppkey") % 5).alias("tile"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("z"))
    return T.mosaic(li.groupBy("cell", "tile").agg(F.max("z").alias("z")), ["cell"], "z", "tile")


SQL_SCENES = "found AS (SELECT * FROM v_scenes WHERE cloud < 20 AND strftime(date, '%m-%d') BETWEEN '06-20' AND '07-31' AND year(date) IN (1996, 1997, 1999)), clear AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY tile, date ORDER BY cloud, scene_id) = 1)"


@query(f"WITH {SQL_SCENES} SELECT scene_id, tile, round(cloud, 6) AS cloud FROM clear", "scenes")
def s13_scene_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.search_scenes(V.scenes(spark, sf_dir), [1996, 1997, 1999], "06-20", "07-31", 20.0).select("scene_id", "tile", r6(F.col("cloud")).alias("cloud"))


@query(f"WITH {SQL_SCENES} SELECT scene_id, tile FROM clear QUALIFY row_number() OVER (PARTITION BY tile ORDER BY cloud, scene_id) <= 8", "scenes")
def s14_top_scenes_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clearest_per_tile(T.search_scenes(V.scenes(spark, sf_dir), [1996, 1997, 1999], "06-20", "07-31", 20.0), 8).select("scene_id", "tile")


@query("""SELECT o_orderkey AS scene_id, o_orderpriority AS tile FROM orders o WHERE (SELECT count(*) FROM orders p WHERE p.o_orderpriority = o.o_orderpriority AND (p.o_totalprice % 100 < o.o_totalprice % 100 OR p.o_totalprice % 100 = o.o_totalprice % 100 AND p.o_orderkey < o.o_orderkey)) < 25""")
def w08_top_n_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 clearest of all scenes of each tile."""
    return T.clearest_per_tile(V.scenes(spark, sf_dir), 25).select("scene_id", "tile")


@query("SELECT scene_id, round(least(greatest((cloud * 100 + CASE WHEN baseline >= '04.00' THEN -1000 ELSE 0 END) / 10000, 0), 1e9), 6) + 0.0::DOUBLE AS reflectance FROM v_scenes", "scenes")
def s15_reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernwerk.functions.curves import reflectance

    return V.scenes(spark, sf_dir).select("scene_id", r6(reflectance(F.col("cloud") * 100, F.col("baseline"))).alias("reflectance"))


@query("SELECT way_id, coalesce(tag, 'path') AS tag FROM (SELECT s_suppkey AS way_id, CASE s_suppkey % 7 WHEN 0 THEN 'path' WHEN 1 THEN 'footway' WHEN 2 THEN 'track' WHEN 3 THEN 'primary' WHEN 4 THEN 'steps' WHEN 5 THEN 'bridleway' END AS tag, s_suppkey % 3 AS points, s_suppkey % 5 = 0 AS route FROM supplier) WHERE (tag IN ('path', 'footway', 'track', 'bridleway', 'steps') OR route) AND points >= 2")
def s16_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    tag = F.element_at(F.array(*map(F.lit, ("path", "footway", "track", "primary", "steps", "bridleway", None))), (k % 7 + 1).cast("int"))
    ways = V.read(spark, sf_dir, "supplier").select(k.alias("way_id"), tag.alias("highway"), F.when(k % 5 == 0, "hiking").alias("route"), (k % 3).alias("points"))
    return T.trails(ways).select("way_id", "tag")


@query("SELECT arg_max(p_partkey, coalesce(p_size, 0) * 1000000 - p_partkey) AS taxon_id FROM part WHERE lower(p_name) = 'small ring' AND p_partkey % 3 <> 0")
def s17_taxon_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxa = V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3 != 0).alias("is_active"), F.col("p_size").alias("observations_count"))
    return T.pick_taxon(taxa, "Small Ring").select(F.col("id").alias("taxon_id"))


@query("SELECT id, taxon FROM v_observations WHERE x BETWEEN 1000 AND 9000 AND y BETWEEN 500 AND 8000 AND month(observed_on) IN (1, 7) AND taxon LIKE 'Arnica %'", "observations")
def s19_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.occurrences(V.observations(spark, sf_dir), (1000, 500, 9000, 8000), [1, 7]).where(F.col("taxon").startswith("Arnica ")).select("id", "taxon")


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'species' WHEN p_size % 3 = 0 AND p_size % 7 <> 1 THEN 'shared' WHEN p_size % 5 = 0 THEN 'output' END AS place FROM part""")
def s20_layer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each layer is taken from, by which places have it; some are never taken from the shared ones."""
    n = F.col("p_size")
    have = V.read(spark, sf_dir, "part").select("p_partkey", F.array_compact(F.array(F.when(n % 5 == 0, "output"), F.when(n % 3 == 0, "shared"), F.when(n % 2 == 0, "species"))).alias("have"), (n % 7 == 1).alias("private"))
    return have.select(F.col("p_partkey").alias("k"), T.located("have", "private").alias("place"))


@query("""SELECT min(id) AS id, taxon, observed_on FROM v_observations GROUP BY taxon, observed_on""", "observations")
def u02_distinct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_by_id(V.observations(spark, sf_dir), ["taxon", "observed_on"], ["id"]).select("id", "taxon", "observed_on")


@query("SELECT segment_id, class, status FROM (SELECT segment_id, class, status FROM v_roads UNION ALL SELECT poly_id + 100000, layer, NULL FROM v_tenure)", "roads", "tenure")
def u01_union_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tenure(spark, sf_dir).select((F.col("poly_id") + 100_000).alias("segment_id"), F.col("layer").alias("class"))
    return V.roads(spark, sf_dir).select("segment_id", "class", "status").unionByName(t, allowMissingColumns=True)


@query("SELECT DISTINCT taxon FROM v_observations WHERE taxon IS NOT NULL EXCEPT SELECT * FROM (VALUES ('Arnica latifolia'), ('Rosa'))", "observations")
def u03_unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Arnica latifolia",), ("Rosa",)], "taxon string")
    return V.observations(spark, sf_dir).where("taxon is not null").select("taxon").subtract(known)


# sites and sinks

STATUS = tuple(L.TENURE_CLASSES.values())
SQL_SITE_ROWS = SQL_SITES + """, site AS (SELECT rank, round(score, 4) AS score, area_ha, CAST(900 + row * 7 % 1500 AS INT) AS elevation_m, CASE WHEN rank % 7 <> 3 THEN row * 11 % 1000 / 10.0::DOUBLE END AS drive_minutes, col % 80 / 10.0::DOUBLE AS hike_km,
  (['crown_land', 'woodlot', 'private', 'recreation_area', 'provincial_park', 'conservancy', 'ecological_reserve', 'national_park'])[CAST(rank % 8 + 1 AS INT)] AS land_status, rank % 8 <> 0 AS land_flagged, rank % 3 = 0 AS on_cutblock,
  CASE WHEN rank % 3 = 0 THEN rank * 7 % 80 END AS years_since_logging, row * 0.001::DOUBLE + 49 AS lat, -118 + col * 0.001::DOUBLE AS lon FROM ranked)"""


def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, row, col = F.col("rank"), F.col("row"), F.col("col")
    s = ranked_sites(spark, sf_dir)
    return s.select(
        "rank",
        F.round("score", 4).alias("score"),
        "area_ha",
        (900 + row * 7 % 1500).cast("int").alias("elevation_m"),
        F.when(r % 7 != 3, row * 11 % 1000 / 10.0).alias("drive_minutes"),
        (col % 80 / 10.0).alias("hike_km"),
        F.element_at(F.array(*map(F.lit, STATUS)), r % 8 + 1).alias("land_status"),
        (r % 8 != 0).alias("land_flagged"),
        (r % 3 == 0).alias("on_cutblock"),
        F.when(r % 3 == 0, r * 7 % 80).alias("years_since_logging"),
        (row * 0.001 + 49).alias("lat"),
        (F.lit(-118) + col * 0.001).alias("lon"),
    )


@query(SQL_SITE_ROWS + " SELECT rank, land_status FROM site WHERE score >= 0.5 AND coalesce(drive_minutes <= 80, true) AND hike_km <= 5 AND elevation_m BETWEEN 1000 AND 2200 AND NOT land_flagged AND NOT (on_cutblock AND coalesce(years_since_logging < 45, false))", "wide")
def f16_site_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.visible(site_rows(spark, sf_dir), 0.5, 80, 5, (1000, 2200), True, True).select("rank", "land_status")


@query(SQL_SITE_ROWS + " SELECT rank, score FROM site ORDER BY rank LIMIT 200", "wide")
def o04_list_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_rows(spark, sf_dir).orderBy("rank").limit(200).select("rank", "score")


@query(SQL_SITE_ROWS + """ SELECT count(*) AS sites, count_if(land_flagged) AS flagged, coalesce(min(score), 0) AS score_min, coalesce(max(score), 1) AS score_max, coalesce(min(elevation_m), 0)::DOUBLE AS elevation_min, coalesce(max(elevation_m), 0)::DOUBLE AS elevation_max,
  coalesce(min(drive_minutes), 0) AS drive_min, coalesce(max(drive_minutes), 0) AS drive_max, coalesce(min(hike_km), 0) AS hike_min, coalesce(max(hike_km), 0) AS hike_max FROM site""", "wide")
def k04_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counts_and_ranges(site_rows(spark, sf_dir))


@query("""SELECT p_brand AS brand, coalesce(min(s), 0) AS score_min, coalesce(max(s), 1) AS score_max, coalesce(min(d), 0) AS drive_min, coalesce(max(d), 0) AS drive_max FROM
  (SELECT p_brand, CASE WHEN p_brand <> 'Brand#11' THEN p_size / 50.0::DOUBLE END AS s, CASE WHEN p_partkey % 3 = 0 AND p_brand <> 'Brand#12' THEN p_retailprice END AS d FROM part) GROUP BY 1""")
def a20_manifest_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges by group; a group without any score has 0 to 1, without any drive time 0 to 0."""
    score = F.when(F.col("p_brand") != "Brand#11", F.col("p_size") / 50.0)
    drive = F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_brand") != "Brand#12"), F.col("p_retailprice"))
    rows = V.read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), score.alias("score"), F.lit(None).cast("double").alias("elevation_m"), drive.alias("drive_minutes"), F.lit(None).cast("double").alias("hike_km"), F.lit(False).alias("land_flagged"))
    return K.counts_and_ranges(rows, ["brand"]).select("brand", "score_min", "score_max", "drive_min", "drive_max")


@query(SQL_SITE_ROWS + """ SELECT rank, '<wpt lat="' || printf('%.6f', lat) || '" lon="' || printf('%.6f', lon) || '"><ele>' || elevation_m || '</ele><name>' || '#' || rank || ' ' || printf('%.2f', score + 1e-9) || ' ' || elevation_m || 'm</name><desc>' || land_status || CASE WHEN on_cutblock THEN '; logged ' || years_since_logging || ' yr ago' ELSE '' END || '</desc><sym>Flag, Green</sym></wpt>' AS wpt FROM site""", "wide")
def k11_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_rows(spark, sf_dir).select("rank", K.waypoint(F.col("land_status")).alias("wpt"))


@query(SQL_SITE_ROWS + """ SELECT rank, rank || ',' || elevation_m || ',"' || 'a ""' || land_status || '"", b' || '",' || coalesce(CAST(years_since_logging AS VARCHAR), '') AS line FROM site""", "wide")
def k12_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('a "'), F.col("land_status"), F.lit('", b'))
    return site_rows(spark, sf_dir).withColumn("text", text).select("rank", K.csv_line(["rank", "elevation_m", "text", "years_since_logging"]).alias("line"))


@query("""SELECT id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"id":' || id || CASE WHEN taxon IS NULL THEN '' ELSE ',"taxon":"' || taxon || '"' END || ',"observed_on":"' || strftime(observed_on, '%Y-%m-%d') || '"'
  || CASE WHEN accuracy_m IS NULL THEN '' ELSE ',"precise":' || (accuracy_m <= 60) END || CASE WHEN obscured IS NULL THEN '' ELSE ',"obscured":' || obscured END || ',"x":' || x || ',"y":' || y || ',"weight":' || CASE WHEN taxon = 'Arnica latifolia' OR taxon LIKE 'Arnica latifolia %' THEN '1.0' WHEN taxon = 'Arnica cordifolia' THEN '0.2' ELSE '0.5' END || '}}' AS feature FROM v_observations""", "observations")
def k03_observation_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with eight properties; what is not known is left out."""
    o = V.observations(spark, sf_dir).withColumn("precise", F.col("accuracy_m") <= 60).withColumn("weight", L.record_weight(F.col("taxon"), "Arnica latifolia", ["Arnica cordifolia"]))
    return o.select("id", K.feature(F.col("x"), F.col("y"), [F.col(c) for c in ("id", "taxon", "observed_on", "precise", "obscured", "x", "y", "weight")]).alias("feature"))


@query("""WITH q AS (SELECT quantile_cont(score, 0.02) AS lo, quantile_cont(score, 0.98) AS hi FROM v_wide) SELECT row, col, CAST(trunc(least(greatest((score - lo) / greatest(hi - lo, 1e-9), 0), 1) * 255) AS INT) AS idx FROM v_wide, q""", "wide")
def k07_overlay_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stretch(V.wide(spark, sf_dir), "score").select("row", "col", "idx")


@query("SELECT row, col, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN k.class IS NULL THEN 0 ELSE 190 END AS alpha FROM (SELECT row, col, CASE WHEN ndvi IS NULL THEN 0 WHEN ndvi < 0.1 THEN 1 WHEN ndvi < 0.5 THEN 2 ELSE 9 END AS class FROM v_terrain) t LEFT JOIN (VALUES (1, 150, 120, 90), (2, 120, 200, 80)) k(class, r, g, b) ON k.class = t.class", "terrain")
def k08_categorical_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ndvi = F.col("ndvi")
    cls = F.when(ndvi.isNull(), 0).when(ndvi < 0.1, 1).when(ndvi < 0.5, 2).otherwise(9)
    return K.categorical(V.terrain(spark, sf_dir).select("row", "col", cls.alias("class")), "class", {1: (150, 120, 90), 2: (120, 200, 80)})


@query("SELECT poly_id, upper(coalesce(designation, '')) AS name, CASE WHEN upper(coalesce(designation, '')) LIKE '%ECOLOGICAL RESERVE%' THEN 6 WHEN upper(coalesce(designation, '')) LIKE '%CONSERVANCY%' THEN 5 WHEN upper(coalesce(designation, '')) LIKE '%RECREATION AREA%' THEN 3 ELSE 4 END AS class FROM v_tenure", "tenure")
def j15_designation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tenure(spark, sf_dir).select("poly_id", F.upper(F.coalesce("designation", F.lit(""))).alias("name"), L.tenure_of(F.col("designation")).alias("class"))


@query("""SELECT row, col, CASE WHEN water_m IS NULL THEN '-' WHEN water_m / 4 < 90 THEN CAST(floor(water_m / 4 + 0.5) AS BIGINT) || ' min' ELSE CAST(floor(water_m / 240) AS BIGINT) || ' h ' || CAST(floor(water_m / 4 - 60 * floor(water_m / 240) + 0.5) AS BIGINT) || ' min' END AS label FROM v_terrain""", "terrain")
def x01_minutes_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.terrain(spark, sf_dir).select("row", "col", L.minutes_label(F.col("water_m") / 4).alias("label"))


@query("SELECT id, sha1(coalesce(taxon, '') || '|' || coalesce(CAST(observed_on AS VARCHAR), '') || '|' || id) AS key FROM v_observations", "observations")
def x02_request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observations(spark, sf_dir).select("id", L.request_key(F.col("taxon"), F.col("observed_on"), F.col("id")).alias("key"))


@query("SELECT o_orderkey AS k, '&lt;' || o_orderpriority || ' &amp; ' || o_orderstatus || '&gt;' AS text FROM orders")
def x03_escape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<"), "o_orderpriority", F.lit(" & "), "o_orderstatus", F.lit(">"))
    return V.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), L.escape_xml(text).alias("text"))


SQL_LORE = """lore AS (SELECT p_partkey AS k, p_size, p_size % 3 AS names, p_partkey % 17 AS theme, (['none', 'caution', 'toxic', 'restricted', 'mild'])[CAST(p_size % 5 + 1 AS INT)] AS level, CASE WHEN p_size % 7 <> 0 THEN ' ' || p_name END AS note FROM part)"""


def lore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lore block of each part: up to two names, one or two associations, some of unknown themes or levels, some without notes."""
    n, k = F.col("p_size"), F.col("p_partkey")
    theme = F.element_at(F.array(*map(F.lit, (*P.THEMES, "fame"))), (k % 17 + 1).cast("int"))
    note = F.when(n % 7 != 0, F.concat(F.lit(" "), "p_name"))
    one = F.struct(theme.alias("theme"), note.alias("note"), F.lit("o").alias("origin"))
    level = F.element_at(F.array(*map(F.lit, (*P.SAFETY, "mild"))), (n % 5 + 1).cast("int"))
    block = F.struct(F.slice(F.array("p_brand", "p_type"), F.lit(1), (n % 3).cast("int")).alias("folk_names"), F.array("p_type").alias("traditions"), F.when(n % 2 == 0, F.array(one)).otherwise(F.array(one, one)).alias("associations"), F.struct(level.alias("level"), note.alias("note")).alias("safety"), F.array(F.lit("s")).alias("sources"))
    return V.read(spark, sf_dir, "part").select(k.alias("k"), block.alias("block"))


@query(f"""WITH {SQL_LORE} SELECT k, CAST((names = 0)::INT + (level = 'mild')::INT + (note IS NULL)::INT + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END * ((theme = 16)::INT + (note IS NULL)::INT) AS INT) AS problems FROM lore""")
def x04_profile_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the lore blocks of profiles, as a column."""
    return lore_rows(spark, sf_dir).select("k", F.size(P.lore_problems()).alias("problems"))


@query(f"""WITH {SQL_LORE} SELECT k, CASE level WHEN 'none' THEN 'No known hazard' WHEN 'toxic' THEN 'Toxic' WHEN 'restricted' THEN 'Do not use' ELSE 'Caution' END AS level,
  (['protection', 'warding', 'banishing', 'purification', 'love', 'fertility', 'prosperity', 'luck', 'divination', 'dreams', 'courage', 'healing', 'spirit work', 'death & mourning', 'weather', 'hunting', 'fame'])[CAST(theme + 1 AS INT)] AS theme, coalesce(note, '') AS note FROM lore""")
def x05_profile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of level and first theme; an unknown level is shown as caution, an unknown theme as it is."""
    out = lore_rows(spark, sf_dir).withColumn("m", P.lore_manifest())
    return out.select("k", F.col("m.safety.level_label").alias("level"), F.col("m.associations")[0]["theme_label"].alias("theme"), F.col("m.safety.note").alias("note"))


@query(f"""WITH {SQL_BOOT}, q AS (SELECT surface, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM boot GROUP BY 1),
  r AS (SELECT *, rank() OVER (PARTITION BY surface ORDER BY value) + (count(*) OVER (PARTITION BY surface, value) - 1) / 2 AS rk FROM s),
  a AS (SELECT surface, (sum(CASE WHEN positive THEN rk END) - count_if(positive) * (count_if(positive) + 1) / 2) / (count_if(positive) * count_if(NOT positive)) AS auc FROM r GROUP BY 1)
  SELECT a.surface, round(auc, 8) AS auc, round(low, 7) AS low, round(high, 7) AS high FROM a JOIN q ON q.surface = a.surface""")
def k13_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.validation_report(samples(spark, sf_dir), REPLICATES)
    return out.select("surface", F.round("auc", 8).alias("auc"), F.round("low", 7).alias("low"), F.round("high", 7).alias("high"))


@query(SQL_SITE_ROWS + """ SELECT rank, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(col AS INT) || ',' || CAST(row AS INT) || ']},"properties":{"rank":' || rank || ',"flagged":' || (rank % 8 <> 0) || '}}' AS feature FROM ranked""", "wide")
def k02_site_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ranked_sites(spark, sf_dir)
    return s.select("rank", K.feature(F.col("col"), F.col("row"), [F.col("rank"), (F.col("rank") % 8 != 0).alias("flagged")]).alias("feature"))


@query(f"WITH {SQL_SCENES} SELECT CAST(row_number() OVER (ORDER BY tile, cloud, scene_id) AS INT) AS place, scene_id FROM clear", "scenes")
def o03_scene_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by name, each tile's scenes by cloud. A search returns few scenes."""
    found = T.search_scenes(V.scenes(spark, sf_dir), [1996, 1997, 1999], "06-20", "07-31", 20.0)
    return found.withColumn("place", F.row_number().over(Window.orderBy("tile", "cloud", "scene_id"))).select("place", "scene_id")


@query("SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'WHSE_BASEMAPPING.FWA_LAKES_POLY' WHEN 1 THEN 'WHSE_FOREST_VEGETATION.VEG_COMP_LYR_R1_POLY' WHEN 2 THEN 'OWN.' || s_name WHEN 3 THEN 'WHSE_CADASTRE.PMBC_PARCEL_FABRIC_POLY_SVW' END AS layer FROM supplier")
def s07_layer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's names of layers: of an alias its layer, a full name is its own, anything else is unknown."""
    k = F.col("s_suppkey")
    alias = F.when(k % 5 == 0, "fwa_lakes").when(k % 5 == 1, "vri").when(k % 5 == 2, F.concat(F.lit("OWN."), "s_name")).when(k % 5 == 3, "parcels").otherwise("nothing")
    return V.read(spark, sf_dir, "supplier").select(k.alias("k"), T.layer_names(alias).alias("layer"))


@query("""SELECT p_partkey AS k, 'terrain,' || CASE WHEN p_size % 2 = 0 THEN 'forest,' ELSE 'vegetation,' END || CASE WHEN p_size % 3 = 0 THEN 'moisture,' ELSE '' END || 'access,observations,landstatus,scoring,export' AS stages FROM part""")
def c04_stages_of_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages that each profile needs, by its habitat model and optional blocks."""
    p = V.read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "host_trees").alias("model"), (F.col("p_size") % 3 == 0).alias("moisture"))
    return p.select(F.col("p_partkey").alias("k"), F.concat_ws(",", P.stages_of(F.col("model"), {"moisture": F.col("moisture")})).alias("stages"))
