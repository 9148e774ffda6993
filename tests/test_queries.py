"""Every query against its SQL on the smallest tables, as the driver does."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fernwerk.plans.catalog import ORACLES, QUERIES
from fernwerk.plans.credits import r6

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    out = con.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in columns)) for r in out.fetchall())


def test_six_places_are_those_of_sql(spark, con):
    values = [0.5163125, 0.7719374999999999, -0.5163125, 0.5126875, 0.4133125, 1234567.8912345, -0.0, None, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(r6(F.col("x"))).collect()]
    assert got == [con.execute("select round(?::DOUBLE, 6) + 0.0::DOUBLE", [v]).fetchone()[0] for v in values]


def test_candidate_surfaces_on_halves(spark):
    """sf0.01 has cells whose blend lies on half of a sixth place."""
    c, sf = duckdb.connect(), "/root/testdata/sf0.01"
    c.execute(f"create view part as select * from '{sf}/part.parquet'")
    want = c.execute(f"select row, col, surface, value from ({ORACLES['c10_candidate_surfaces']})").fetchall()
    got = QUERIES["c10_candidate_surfaces"](spark, sf).select("row", "col", "surface", "value").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
