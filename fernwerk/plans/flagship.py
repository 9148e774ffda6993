"""The query end to end: terrain to credits to rejection to the percentile cut to ranked cells, and the full model to sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fernwerk.functions import curves as C
from fernwerk.operators import sites as Z
from fernwerk.operators.stats import exact_percentile
from fernwerk.plans import views as V
from fernwerk.plans.credits import OPENNESS, NDVI, SQL_CLOSURE, SQL_NDVI_FIT, SQL_OPENNESS, SQL_TERRAIN, SUBWEIGHTS, closure, terrain_parts
from fernwerk.plans.views import oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their terrain score, missing where a hard bound rejects them."""
    ok = F.coalesce(F.col("z").between(1300, 2500), F.lit(False)) & F.coalesce(F.col("slope") <= 35, F.lit(False))
    t = V.terrain(spark, sf_dir).withColumns({f"_{k}": v for k, v in terrain_parts().items()})
    return t.select("row", "col", "z", "slope", F.when(ok, terrain_blend()).alias("score"))


def terrain_blend() -> Column:
    """Of credits that are columns already: each is named twice, and Spark computes it once."""
    return C.weighted_mean({k: F.col(f"_{k}") for k in terrain_parts()}, SUBWEIGHTS)


def best_ground(spark: SparkSession, sf_dir: str, percentile: float = 90.0, limit: int = 50) -> DataFrame:
    """The best cells by terrain alone, at or above the percentile of scored cells, ranked."""
    cells = scored(spark, sf_dir)
    at = exact_percentile(cells, "score", percentile / 100)
    order = [F.desc("score"), F.asc("row"), F.asc("col")]
    best = cells.where(F.col("score") >= (at or 0.0)).withColumn("score", F.round("score", 6)).orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "row", "col", "z", "score")


def suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers of each cell blended and rejected: terrain, vegetation with the clearcut penalty, access and observations."""
    t = V.terrain(spark, sf_dir).withColumns({f"_{k}": v for k, v in terrain_parts().items()}).withColumn("_closure", closure())
    veg = C.vegetation_score(F.col("ndvi"), F.col("_closure"), NDVI, OPENNESS) * C.clearcut_penalty(F.col("logged_age"), 0.3, 45)
    access = C.access_score(F.col("slope") * 3, F.col("water_m") / 100, {"drive": 0.4, "hike": 0.6})
    parts = {"terrain": terrain_blend(), "vegetation": veg, "access": access, "observations": C.observation_score(F.col("texture") / 40, 3.0, 0.5)}
    t = t.select("row", "col", *(v.alias(k) for k, v in parts.items()))
    score = C.weighted_mean({k: F.col(k) for k in parts}, {"terrain": 0.3, "vegetation": 0.3, "access": 0.2, "observations": 0.2})
    return t.withColumn("score", Z.rejected(score, F.col("terrain"), F.col("vegetation")))


QUERIES["w07_best_ground"] = best_ground
ORACLES["w07_best_ground"] = oracle(
    f"""WITH t AS (SELECT row, col, z, CASE WHEN z BETWEEN 1300 AND 2500 AND slope <= 35 THEN terrain END AS score FROM ({SQL_TERRAIN}))
  SELECT CAST(row_number() OVER (ORDER BY round(score, 6) DESC, row, col) AS INT) AS rank, row, col, z, round(score, 6) AS score FROM t WHERE score >= (SELECT quantile_cont(score, 0.9) FROM t) QUALIFY rank <= 50""",
    "terrain",
)


def q01_suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suitability(spark, sf_dir).select("row", "col", F.round("score", 5).alias("score"))


QUERIES["q01_suitability"] = q01_suitability
_VEG = f"CASE WHEN closure IS NULL OR ndvi < 0.1 THEN NULL ELSE ({SQL_NDVI_FIT}) * ({SQL_OPENNESS}) * CASE WHEN logged_age IS NULL THEN 1 ELSE 0.3 + 0.7 * least(logged_age / 45, 1) END END"
ORACLES["q01_suitability"] = oracle(
    f"""WITH t AS (SELECT *, {SQL_CLOSURE} AS closure FROM ({SQL_TERRAIN})),
  p AS (SELECT row, col, terrain, {_VEG} AS veg, CASE WHEN slope IS NOT NULL THEN least(greatest((90 - slope * 3) / 67.5, 0), 1) END AS d, CASE WHEN water_m IS NOT NULL THEN least(greatest((6 - water_m / 100) / 5.75, 0), 1) END AS h,
    0.5 + 0.5 * least(greatest(texture / 40 * 2 * pi() * 9, 0), 1) AS o FROM t),
  q AS (SELECT *, (coalesce(0.4 * d, 0) + coalesce(0.6 * h, 0)) / nullif((d IS NOT NULL)::INT * 0.4::DOUBLE + (h IS NOT NULL)::INT * 0.6::DOUBLE, 0) AS acc FROM p)
  SELECT row, col, round(CASE WHEN terrain IS NOT NULL AND veg IS NOT NULL THEN (0.3 * terrain + 0.3 * veg + coalesce(0.2 * acc, 0) + 0.2 * o) / (0.8::DOUBLE + CASE WHEN acc IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END) END, 5) + 0.0::DOUBLE AS score FROM q""",
    "terrain",
)
