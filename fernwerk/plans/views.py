"""Domain views over the driver's tables, as DataFrames and as DuckDB SQL written independently.

The driver has no rasters, so measurements are projected from keys by plain arithmetic; NULL is "no data".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CODES = ("FDI", "FD", "HW", "PLI", "CW", "SE", "SX", "S", "BL", "BG", "LW", "L", "AT", "EP", "ZZ", "YC", "PY", "", "B", "PA")
CLASSES = ("highway", "arterial", "collector", "local", "resource", "trail", "Runway")
TAXA = {"view": "Arnica latifolia", "purchase": "Arnica latifolia var. gracilis", "error": "Arnica cordifolia", "signup": "Arnicastrum", "click": None}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.expr("p_partkey div 50").cast("int").alias("row"),
        (k % 50).cast("int").alias("col"),
        F.when(k % 97 != 13, 900.0 + 32 * F.col("p_size")).alias("z"),
        F.when(k % 89 != 7, (k * 7 % 480) / 10.0).cast("double").alias("slope"),
        F.when(k % 83 != 5, (k * 37 % 3600) / 10.0).cast("double").alias("aspect"),
        F.when(k % 19 != 3, (k * 13 % 200 - 60) / 100.0).cast("double").alias("ndvi"),
        F.when(k % 23 != 4, (k * 29 % 160 - 60) / 100.0).cast("double").alias("ndmi"),
        ((k * 3 % 100) / 100.0).cast("double").alias("texture"),
        F.when(k % 5 == 0, k * 17 % 80).cast("double").alias("logged_age"),
        F.when(k % 31 != 0, (k * 53 % 900)).cast("double").alias("water_m"),
        (k % 31 == 0).alias("no_water"),
        F.when(k % 37 != 9, (k * 11 % 200 - 100) / 10.0).cast("double").alias("tpi"),
    )


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    row, col = F.expr("p_partkey div 50").cast("int"), (k % 50).cast("int")
    return read(spark, sf_dir, "part").select(row.alias("row"), col.alias("col"), F.when(k % 97 != 13, 1000.0 + 8 * col + 5 * row + 40 * (F.col("p_size") % 3)).alias("z"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").cast("int").alias("row"), (k % 100).cast("int").alias("col"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("score"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 m pixels of four scenes over the cells of `terrain`."""
    li = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).cast("int").alias("scene"), "l_partkey", "l_linenumber")
    agg = li.agg(F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), (F.max("l_suppkey") % 12).cast("int").alias("scl"))
    n = F.col("l_linenumber") - 1
    return agg.select(
        "scene",
        (F.expr("l_partkey div 50") * 3 + F.floor(n / 3)).cast("int").alias("frow"),
        (F.col("l_partkey") % 50 * 3 + n % 3).cast("int").alias("fcol"),
        (1000 + F.col("d") * 1e4).alias("red"),
        (1000 + F.col("q") * 60).alias("nir"),
        (1000 + F.col("t") * 2e4).alias("swir"),
        "scl",
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_orderpriority").alias("tile"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_totalprice") % 100).alias("cloud"),
        F.when(F.col("o_orderstatus") == "F", "03.01").when(F.col("o_orderstatus") == "O", "04.00").otherwise("05.09").alias("baseline"),
    )


def stand_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six species slots of each stand, by share."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    total = Window.partitionBy("l_orderkey")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("l_partkey") % len(CODES) + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").withColumn("slot", F.row_number().over(w)).withColumn("pct", 100 * F.col("l_quantity") / F.sum("l_quantity").over(total))
    return rows.where("slot <= 6").select(F.col("l_orderkey").alias("stand_id"), "slot", F.when(F.col("l_partkey") % 41 != 0, code).alias("code"), F.when(F.col("l_partkey") % 43 != 0, F.col("pct")).alias("pct"))


def stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("stand_id"),
        F.when(F.col("o_orderstatus") == "F", "T").when(F.col("o_orderstatus") == "O", "n").alias("level2"),
        F.when(k % 13 != 2, (k * 7 % 320)).cast("double").alias("age"),
        F.when(k % 17 != 4, F.floor(F.col("o_totalprice")) % 101).cast("double").alias("closure"),
        F.when(k % 6 == 1, k * 11 % 90).cast("double").alias("harvest_age"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harvested rectangles [row0, row1] x [col0, col1] on the cells of `terrain`."""
    k = F.col("c_custkey")
    row0, col0 = (k * 7 % 40).cast("int"), (k * 11 % 50).cast("int")
    return read(spark, sf_dir, "customer").select(
        k.alias("block_id"), row0.alias("row0"), col0.alias("col0"), (row0 + k % 3).cast("int").alias("row1"), (col0 + k % 4).cast("int").alias("col1"), (1960 + F.floor(F.abs("c_acctbal")) % 75).cast("int").alias("harvest_year")
    )


def tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    row0, col0 = (k * 3 % 40).cast("int"), (k * 19 % 50).cast("int")
    layer = F.element_at(F.array(*map(F.lit, ("woodlot", "private", "park", "conservancy", "national"))), (n % 5 + 1).cast("int"))
    des = F.element_at(F.array(*map(F.lit, ("Ecological Reserve", "PROVINCIAL PARK", "Recreation Area", "x conservancy"))), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(k.alias("poly_id"), layer.alias("layer"), F.when(k % 7 != 0, des).alias("designation"), row0.alias("row0"), col0.alias("col0"), (row0 + k % 5).cast("int").alias("row1"), (col0 + k % 6).cast("int").alias("col1"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("stream_id"), (k * 13 % 40).cast("int").alias("row"), (k * 17 % 25).cast("int").alias("col"), F.when(k % 11 != 0, 1 + k % 9).cast("int").alias("stream_order"), (F.col("s_nationkey") % 4).cast("int").alias("poly_code"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice segments with ends up to 1.1 m apart, so that junctions have to be clustered."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    gx, gy = k % 10, F.expr("s_suppkey div 10") % 10
    across = n % 2
    cls = F.element_at(F.array(*map(F.lit, CLASSES)), (n % 7 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(
        k.alias("segment_id"),
        (gx * 1000 + (k % 3) * 0.5).cast("double").alias("x0"),
        (gy * 1000 + (k % 2) * 0.5).cast("double").alias("y0"),
        ((gx + across) * 1000 + (k % 2) * 0.5).cast("double").alias("x1"),
        ((gy + 1 - across) * 1000 + (k % 3) * 0.5).cast("double").alias("y1"),
        F.when(k % 13 != 5, cls).alias("class"),
        F.when(k % 9 == 0, "overgrown").when(k % 9 == 1, None).otherwise("loose").alias("surface"),
        F.when(k % 8 == 0, "RETIRED").when(k % 8 == 1, None).otherwise("ACTIVE").alias("status"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    taxon = F.when(F.lit(False), F.lit(None).cast("string"))
    for event, name in TAXA.items():
        taxon = taxon.when(F.col("event_type") == event, F.lit(name))
    return read(spark, sf_dir, "events").select(
        k.alias("id"),
        taxon.alias("taxon"),
        F.to_date("ts").alias("observed_on"),
        F.when(k % 29 != 0, F.col("value")).alias("accuracy_m"),
        F.when(k % 31 != 0, u % 11 == 0).alias("obscured"),
        (u * 37 % 150 * 100 + k % 7 * 10).cast("double").alias("x"),
        (u * 53 % 120 * 100 + k % 5 * 10).cast("double").alias("y"),
    )


SQL = {
    "terrain": """SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col,
  CASE WHEN p_partkey % 97 <> 13 THEN 900.0::DOUBLE + 32 * p_size END AS z,
  CASE WHEN p_partkey % 89 <> 7 THEN (p_partkey * 7 % 480) / 10.0::DOUBLE END AS slope,
  CASE WHEN p_partkey % 83 <> 5 THEN (p_partkey * 37 % 3600) / 10.0::DOUBLE END AS aspect,
  CASE WHEN p_partkey % 19 <> 3 THEN (p_partkey * 13 % 200 - 60) / 100.0::DOUBLE END AS ndvi,
  CASE WHEN p_partkey % 23 <> 4 THEN (p_partkey * 29 % 160 - 60) / 100.0::DOUBLE END AS ndmi,
  (p_partkey * 3 % 100) / 100.0::DOUBLE AS texture,
  CASE WHEN p_partkey % 5 = 0 THEN (p_partkey * 17 % 80)::DOUBLE END AS logged_age,
  CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey * 53 % 900)::DOUBLE END AS water_m,
  p_partkey % 31 = 0 AS no_water,
  CASE WHEN p_partkey % 37 <> 9 THEN (p_partkey * 11 % 200 - 100) / 10.0::DOUBLE END AS tpi FROM part""",
    "smooth": """SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col,
  CASE WHEN p_partkey % 97 <> 13 THEN 1000.0::DOUBLE + 8 * (p_partkey % 50) + 5 * (p_partkey // 50) + 40 * (p_size % 3) END AS z FROM part""",
    "wide": "SELECT CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, least(o_totalprice / 500000, 1.0::DOUBLE) AS score FROM orders",
    "pixels": """SELECT CAST(l_suppkey % 4 AS INT) AS scene, CAST((l_partkey // 50) * 3 + (l_linenumber - 1) // 3 AS INT) AS frow,
  CAST((l_partkey % 50) * 3 + (l_linenumber - 1) % 3 AS INT) AS fcol, 1000 + max(l_discount) * 1e4 AS red, 1000 + max(l_quantity) * 60 AS nir,
  1000 + max(l_tax) * 2e4 AS swir, CAST(max(l_suppkey) % 12 AS INT) AS scl FROM lineitem GROUP BY CAST(l_suppkey % 4 AS INT), l_partkey, l_linenumber""",
    "scenes": """SELECT o_orderkey AS scene_id, o_orderpriority AS tile, CAST(o_orderdate AS DATE) AS date, o_totalprice % 100 AS cloud,
  CASE o_orderstatus WHEN 'F' THEN '03.01' WHEN 'O' THEN '04.00' ELSE '05.09' END AS baseline FROM orders""",
    "stand_species": f"""SELECT l_orderkey AS stand_id, slot, CASE WHEN l_partkey % 41 <> 0 THEN ({list(CODES)})[CAST(l_partkey % {len(CODES)} + 1 AS INT)] END AS code,
  CASE WHEN l_partkey % 43 <> 0 THEN pct END AS pct FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS slot,
      100 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS pct FROM lineitem) WHERE slot <= 6""",
    "stands": """SELECT o_orderkey AS stand_id, CASE o_orderstatus WHEN 'F' THEN 'T' WHEN 'O' THEN 'n' END AS level2,
  CASE WHEN o_orderkey % 13 <> 2 THEN (o_orderkey * 7 % 320)::DOUBLE END AS age,
  CASE WHEN o_orderkey % 17 <> 4 THEN (floor(o_totalprice)::BIGINT % 101)::DOUBLE END AS closure,
  CASE WHEN o_orderkey % 6 = 1 THEN (o_orderkey * 11 % 90)::DOUBLE END AS harvest_age FROM orders""",
    "blocks": """SELECT c_custkey AS block_id, CAST(c_custkey * 7 % 40 AS INT) AS row0, CAST(c_custkey * 11 % 50 AS INT) AS col0,
  CAST(c_custkey * 7 % 40 + c_custkey % 3 AS INT) AS row1, CAST(c_custkey * 11 % 50 + c_custkey % 4 AS INT) AS col1,
  CAST(1960 + floor(abs(c_acctbal))::BIGINT % 75 AS INT) AS harvest_year FROM customer""",
    "tenure": """SELECT s_suppkey AS poly_id, (['woodlot', 'private', 'park', 'conservancy', 'national'])[CAST(s_nationkey % 5 + 1 AS INT)] AS layer,
  CASE WHEN s_suppkey % 7 <> 0 THEN (['Ecological Reserve', 'PROVINCIAL PARK', 'Recreation Area', 'x conservancy'])[CAST(s_suppkey % 4 + 1 AS INT)] END AS designation,
  CAST(s_suppkey * 3 % 40 AS INT) AS row0, CAST(s_suppkey * 19 % 50 AS INT) AS col0, CAST(s_suppkey * 3 % 40 + s_suppkey % 5 AS INT) AS row1,
  CAST(s_suppkey * 19 % 50 + s_suppkey % 6 AS INT) AS col1 FROM supplier""",
    "streams": """SELECT s_suppkey AS stream_id, CAST(s_suppkey * 13 % 40 AS INT) AS row, CAST(s_suppkey * 17 % 25 AS INT) AS col,
  CASE WHEN s_suppkey % 11 <> 0 THEN CAST(1 + s_suppkey % 9 AS INT) END AS stream_order, CAST(s_nationkey % 4 AS INT) AS poly_code FROM supplier""",
    "roads": f"""SELECT s_suppkey AS segment_id, ((s_suppkey % 10) * 1000 + (s_suppkey % 3) * 0.5)::DOUBLE AS x0,
  ((s_suppkey // 10 % 10) * 1000 + (s_suppkey % 2) * 0.5)::DOUBLE AS y0, ((s_suppkey % 10 + s_nationkey % 2) * 1000 + (s_suppkey % 2) * 0.5)::DOUBLE AS x1,
  ((s_suppkey // 10 % 10 + 1 - s_nationkey % 2) * 1000 + (s_suppkey % 3) * 0.5)::DOUBLE AS y1,
  CASE WHEN s_suppkey % 13 <> 5 THEN ({list(CLASSES)})[CAST(s_nationkey % 7 + 1 AS INT)] END AS class,
  CASE s_suppkey % 9 WHEN 0 THEN 'overgrown' WHEN 1 THEN NULL ELSE 'loose' END AS surface,
  CASE s_suppkey % 8 WHEN 0 THEN 'RETIRED' WHEN 1 THEN NULL ELSE 'ACTIVE' END AS status FROM supplier""",
    "observations": """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'Arnica latifolia' WHEN 'purchase' THEN 'Arnica latifolia var. gracilis'
    WHEN 'error' THEN 'Arnica cordifolia' WHEN 'signup' THEN 'Arnicastrum' END AS taxon, CAST(ts AS DATE) AS observed_on,
  CASE WHEN event_id % 29 <> 0 THEN value END AS accuracy_m, CASE WHEN event_id % 31 <> 0 THEN user_id % 11 = 0 END AS obscured,
  (user_id * 37 % 150 * 100 + event_id % 7 * 10)::DOUBLE AS x, (user_id * 53 % 120 * 100 + event_id % 5 * 10)::DOUBLE AS y FROM events""",
}


def _counts(sql: str) -> str:
    """count_if as BIGINT, the type of Spark's; DuckDB has HUGEINT."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        j, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + f"CAST(count_if({_counts(sql[i + len('count_if('):j - 1])}) AS BIGINT)"
        at = j
    return out + sql[at:]


def oracle(body: str, *names: str) -> str:
    """The body over the named views."""
    body = _counts(body)
    ctes = [f"v_{n} AS ({SQL[n]})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[14:].strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:].strip()])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
