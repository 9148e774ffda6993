import math

import pytest
from pyspark.sql import functions as F

from fernwerk.functions import curves as C, labels as L


def values(spark, column, xs, kind="double"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_trapezoid_edges_are_zero_and_the_plateau_is_closed(spark):
    got = values(spark, lambda x: C.trapezoid(x, 1300, 1500, 2100, 2500), [1200.0, 1300.0, 1400.0, 1500.0, 1800.0, 2100.0, 2300.0, 2500.0, 2600.0])
    assert got == pytest.approx([0, 0, 0.5, 1, 1, 1, 0.5, 0, 0])


def test_trapezoid_open_edges_keep_full_credit(spark):
    assert values(spark, lambda x: C.trapezoid(x, None, 10, 20, None), [0.0, 5.0, 50.0]) == [1, 1, 1]


@pytest.mark.parametrize("x", [None, float("nan"), float("inf")])
def test_what_is_not_finite_is_missing(spark, x):
    assert values(spark, lambda c: C.trapezoid(c, 0, 1, 2, 3), [x]) == [None]
    assert values(spark, lambda c: C.ramp_down(c, 10, 45), [x]) == [None]


def test_ramp_down(spark):
    assert values(spark, lambda x: C.ramp_down(x, 10, 45), [0.0, 10.0, 22.5, 45.0, 90.0]) == pytest.approx([1, 1, 22.5 / 35, 0, 0])


@pytest.mark.parametrize(("aspect", "slope", "want"), [(202.5, 20.0, 1.0), (247.5, 20.0, 1.0), (22.5, 20.0, 0.0), (-157.5, 20.0, 1.0), (22.5, 1.0, 0.5), (202.5, None, 1.0), (None, 1.0, None)])
def test_aspect_wraps_and_flat_ground_counts_half(spark, aspect, slope, want):
    row = spark.createDataFrame([(aspect, slope)], "a double, s double").select(C.aspect_score(F.col("a"), F.col("s"), 202.5, 45, 3)).first()[0]
    assert row == (None if want is None else pytest.approx(want, abs=1e-9))


def test_weighted_mean_renormalises_over_what_is_there(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (None, 0.4), (None, None)], "a double, b double")
    parts = {"a": F.col("a"), "b": F.col("b")}
    assert [r[0] for r in rows.select(C.weighted_mean(parts, {"a": 3, "b": 1})).collect()] == [0.75, 0.4, None]
    assert [r[0] for r in rows.select(C.weighted_mean(parts, {"a": 0, "b": 1})).collect()] == [0.0, 0.4, None]
    with pytest.raises(ValueError):
        C.weighted_mean(parts, {"a": 0})


def test_piecewise_and_unsorted_knots(spark):
    knots = [(0, 0.0), (15, 0.0), (40, 1.0), (150, 1.0), (300, 0.7)]
    assert values(spark, lambda x: C.age_credit(x, knots, 0.5), [-1.0, 10.0, 27.5, 100.0, 225.0, 999.0, None]) == pytest.approx([0, 0, 0.5, 1, 0.85, 0.7, 0.5])
    with pytest.raises(ValueError):
        C.piecewise(F.lit(1.0), [(10, 0), (5, 1)])


def test_hiking_speed_is_symmetric_but_for_the_offset(spark):
    got = values(spark, lambda x: C.hiking_speed(x), [0.0, 10.0, 40.0])
    assert got[0] == pytest.approx(6 * math.exp(-0.175)) and got[0] > got[1] > got[2]


def test_cost_precedence(spark):
    rows = spark.createDataFrame([(60.0, False, True), (60.0, True, False), (None, True, False), (0.0, True, False), (0.0, False, False)], "s double, t boolean, r boolean")
    got = [r[0] for r in rows.select(C.cost_per_metre(F.col("s"), F.col("t"), F.col("r"))).collect()]
    assert got[:3] == [1e-6, 1e4, 1e4] and got[4] == pytest.approx(got[3] * 1.6)


def test_moisture_needs_a_weight_and_a_position(spark):
    with pytest.raises(ValueError):
        C.moisture_credit(F.lit(1.0), F.lit(False), F.lit(0.0), 30, 230, -5, 5, 0, 0)
    rows = spark.createDataFrame([(10.0, False, -5.0), (10.0, False, None), (None, True, -5.0), (400.0, False, 5.0)], "d double, w boolean, t double")
    got = [r[0] for r in rows.select(C.moisture_credit(F.col("d"), F.col("w"), F.col("t"), 30, 230, -5, 5, 0.5, 0.5, 0.1)).collect()]
    assert got == [1.0, None, pytest.approx(0.55), pytest.approx(0.1)]


def test_classes_follow_the_order_of_overwriting(spark):
    rows = spark.createDataFrame([(0.05, 0.9, 5.0), (0.5, 0.1, 5.0), (0.5, 0.1, 90.0), (0.5, 0.5, 5.0), (0.5, 0.9, 5.0), (None, 0.5, None)], "n double, c double, a double")
    assert [r[0] for r in rows.select(C.vegetation_class(F.col("n"), F.col("c"), 0.1, F.col("a"), 45)).collect()] == [1, 5, 2, 3, 4, 0]


def test_compass_of_missing_bearing(spark):
    assert values(spark, L.compass, [0.0, 11.24, 11.25, 359.0, -90.0, None]) == ["N", "N", "NNE", "N", "W", "n/a"]


def test_longest_prefix_and_tree_codes(spark):
    table = {"FD": 1.0, "S": 0.2, "SX": 0.25}
    assert values(spark, lambda x: L.longest_prefix(x, table, 0.0), ["fdi ", "SXW", "SE", "ZZ", None], "string") == [1.0, 0.25, 0.2, 0.0, None]
    assert values(spark, L.tree_code, ["FDI", "??", " ", None], "string") == [sorted(L.TREE_NAMES).index("FD") + 1, 255, 0, 0]


def test_a_genus_is_not_a_family(spark):
    assert values(spark, lambda x: L.is_target(x, "Rosa"), ["Rosa", "Rosa woodsii", "Rosaceae", None], "string") == [True, True, False, False]


def test_down_weighting_comes_before_the_match(spark):
    got = values(spark, lambda x: L.record_weight(x, "Rosa", ["Rosa rugosa"]), ["Rosa rugosa", "Rosa nutkana", "Rubus", "", None], "string")
    assert got == [0.2, 1.0, 0.5, 0.5, 0.5]


def test_minutes_label(spark):
    assert values(spark, L.minutes_label, [45.4, 89.6, 90.0, 150.0, None]) == ["45 min", "90 min", "1 h 30 min", "2 h 30 min", "-"]
