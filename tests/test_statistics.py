import math
import random

import pytest
from pyspark.sql import functions as F

from fernwerk.operators import stats as A


def frame(spark, pos, neg):
    return spark.createDataFrame([(float(v), True, v is None) for v in pos] + [(float(v), False, v is None) for v in neg], "value double, up boolean, out boolean")


@pytest.mark.parametrize(("pos", "neg"), [([3, 4], [1, 2]), ([1, 2], [3, 4]), ([1, 1], [1, 1]), ([1, 5, 5, 9], [2, 5, 7])])
def test_auc_against_all_pairs(spark, pos, neg):
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert A.auc(frame(spark, pos, neg), "value", "up").first()["auc"] == pytest.approx(want)


def test_rejects_rank_last_and_one_sided_samples_are_missing(spark):
    rows = spark.createDataFrame([(9.0, True, True), (1.0, False, False)], "value double, up boolean, out boolean")
    assert A.auc(rows, "value", "up", rejected="out").first()["auc"] == 0
    assert A.auc(rows.where("up"), "value", "up").first()["auc"] is None


@pytest.mark.parametrize("hold", [3, 50_000])
def test_exact_percentile(spark, hold):
    rng = random.Random(5)
    xs = sorted([rng.choice([1.0, 2.0, 2.0, rng.random() * 10]) for _ in range(501)])
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double")
    for p in (0.0, 0.02, 0.5, 0.777, 0.99, 1.0):
        at = p * 500
        want = xs[math.floor(at)] + (xs[math.ceil(at)] - xs[math.floor(at)]) * (at - math.floor(at))
        assert A.exact_percentile(df, "v", p, hold) == pytest.approx(want)
    assert A.exact_percentile(df.where("v is null"), "v", 0.5) is None


def test_running_total_is_global(spark):
    df = spark.createDataFrame([(i, 1) for i in range(200)], "i int, n int").repartition(7)
    assert A.running_total(df, [F.asc("i")], "n", "b").where("b <> i").count() == 0


def test_percentile_rank(spark):
    ref = spark.createDataFrame([(-1.0,), (-1.0,), (0.2,), (0.4,)], "r double")
    got = A.percentile_rank(spark.createDataFrame([(-1.0,), (0.4,), (9.0,)], "v double"), "v", ref, "r")
    assert {r["v"]: r["percentile"] for r in got.collect()} == {-1.0: 0.0, 0.4: 0.75, 9.0: 1.0}


def test_clusters_chain(spark):
    pts = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate((0.0, 800.0, 1600.0, 10_000.0, 10_000.0))], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in A.record_clusters(pts, 1000.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_permutation_separates(spark):
    far = spark.createDataFrame([(i, i >= 8, float(i)) for i in range(16)], "unit long, positive boolean, value double")
    same = far.withColumn("value", F.lit(1.0))
    assert A.permutation_p(far, 200).first()["p"] < 0.02
    assert A.permutation_p(same, 50).first()["p"] == 1


def test_bootstrap_is_paired_and_keeps_perfect_separation(spark):
    rows = [(s, i >= 10, i % 5 + 10 * (i >= 10), float(i)) for s in ("a", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "surface string, positive boolean, cluster long, value double")
    got = A.bootstrap_auc(df, 10).collect()
    assert len(got) == 20 and {r["auc"] for r in got} == {1.0}
    assert {r["low"] for r in A.interval(spark.createDataFrame(got), ["surface"]).collect()} == {1.0}


WHOLE = "a13_auc a14_percentile_rank a15_effective_units a16_cluster_means a17_interval a18_bootstrap_auc a19_permutation a23_paired_difference a25_sample_guard k13_validation_report".split()


@pytest.mark.parametrize("name", WHOLE)
def test_validation_uses_all_orders_and_all_replicates(spark, name):
    """Against the SQL without its filter of orders, with the production numbers of replicates."""
    import duckdb

    from fernwerk.plans.catalog import ORACLES, QUERIES

    sql = ORACLES[name]
    for cut, whole in ((" AND o_orderkey % 5 = 0", ""), ("range(20)", "range(2000)"), ("range(50)", "range(10000)"), ("/ 51", "/ 10001")):
        sql = sql.replace(cut, whole)
    con = duckdb.connect()
    con.execute("create view orders as select * from '/root/testdata/sf0.001/orders.parquet'")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    want = sorted(out.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-7) if all(isinstance(x, float) for x in a) else all(x == pytest.approx(y, abs=2e-7) if isinstance(y, float) else x == y for x, y in zip(a, b))


def test_bootstrap_over_ranges_equals_one_of_each_replicate(spark):
    """Ties, missing values and replicates across ranges, by brute force."""
    rng = random.Random(3)
    rows = [(s, rng.random() < 0.4, rng.randrange(9), rng.choice([None, 1.0, 2.0, rng.random() * 5])) for s in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "surface string, positive boolean, cluster long, value double")
    got = {(r["surface"], r["replicate"]): r["auc"] for r in A.bootstrap_auc(df, 7).collect()}
    clusters = {up: sorted({r[2] for r in rows if r[1] == up}) for up in (True, False)}
    for rep in range(7):
        times = {}
        for up, all_ in clusters.items():
            for slot in range(len(all_)):
                x = (((rep * 7919 + (slot * 2 + up) * 104_729 + 20240802) % A.MODULUS * 48_271) % A.MODULUS * 69_621) % A.MODULUS
                k = up, all_[x % len(all_)]
                times[k] = times.get(k, 0) + 1
        for s in ("a", "b"):
            key = lambda v: -1.0 if v is None else v
            own = [(up, key(v), times.get((up, c), 0)) for x, up, c, v in rows if x == s]
            pos, neg = [x for x in own if x[0]], [x for x in own if not x[0]]
            pairs = sum(t * u * ((v > w) + 0.5 * (v == w)) for _, v, t in pos for _, w, u in neg)
            assert got[s, rep] == pytest.approx(pairs / (sum(x[2] for x in pos) * sum(x[2] for x in neg)), abs=1e-12)
