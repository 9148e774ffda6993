import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fernwerk.sources import profiles as P, sinks as K, tables as T


def test_comments_go_at_any_depth(tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"$comment": "a", "b": [{"$comment_c": 1, "d": 2}]}))
    assert P.load_json(path) == {"b": [{"d": 2}]}


def config(**species):
    return P.Config({}, {"weights": dict(P.WEIGHTS)}, species)


def test_stages_follow_the_model():
    assert "forest" not in config().stages and "vegetation" in config().stages
    assert "vegetation" not in config(habitat_model="host_trees").stages
    with pytest.raises(P.ConfigError):
        _ = config(habitat_model="riparian").habitat_model


def test_block_and_weight_come_together():
    with pytest.raises(P.ConfigError):
        config(moisture={}).check()
    P.Config({}, {"weights": {**P.WEIGHTS, "moisture": 0.2}}, {"moisture": {}}).check()


def test_replacement_is_by_section():
    assert P.replaced({"weights": {"a": 1, "b": 2}, "x": 1}, {"weights": {"a": 3}}) == {"weights": {"a": 3}, "x": 1}
    with pytest.raises(P.ConfigError):
        P.replaced({}, {"legality": {}})


def test_stage_order_is_fixed():
    assert P.chosen(only="export,terrain") == ["terrain", "export"]
    assert P.chosen(skip="access")[-1] == "export"
    with pytest.raises(P.ConfigError):
        P.chosen(only="terrian")


def test_lore_problems(spark):
    rows = P.lore_frame(spark, P.EXAMPLES + [{"id": "none", "block": None}])
    got = {r["id"]: r["p"] for r in rows.select("id", P.lore_problems().alias("p")).collect()}
    assert got["good"] == [] and got["none"] == ["no block"] and len(got["no safety"]) == 2
    with pytest.raises(P.ConfigError):
        P.check_lore(rows)


def test_retry_waits_longer_and_raises_at_last():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("x")

    with pytest.raises(OSError):
        T.retrying(fails, 3, waits.append)()
    assert len(calls) == 3 and waits == [1.0, 2.0]


def test_taxon_pick(spark):
    taxa = spark.createDataFrame([(1, "Rosa", True, 5), (2, "rosa", True, 9), (3, "Rosa", False, 99), (4, "Rosaceae", True, 1000)], "id long, name string, is_active boolean, observations_count long")
    assert T.resolve_taxon(taxa, "ROSA") == 2
    with pytest.raises(LookupError, match="Rosa"):
        T.resolve_taxon(taxa, "Rosae")


def test_quadrants_stop_at_the_depth():
    assert len(T.quadrants((0, 0, 1, 1), lambda b: 99, cap=1, depth=2)) == 16


def test_declared_source_raises():
    with pytest.raises(T.SourceNotAvailableError):
        T.elevation_source("lidarbc")
    with pytest.raises(ValueError):
        T.elevation_source("x")


def test_simplify_keeps_corners(spark):
    assert K.simplify([(0, 0), (1, 0.1), (2, 0), (2, 5)], 0.5) == [(0, 0), (2, 0), (2, 5)]
    lines = spark.range(1).select(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in range(5))).alias("pts"))
    assert len(K.simplified(lines, 1.0).first()["pts"]) == 2


def test_png_is_an_image():
    data = K.png(pd.DataFrame({"row": [0], "col": [1], "r": [9], "g": [8], "b": [7], "alpha": [255]}), 2, 3)
    assert data.startswith(b"\x89PNG") and struct.unpack(">II", data[16:24]) == (3, 2)


def test_geojson_of_nothing(spark, tmp_path):
    path = tmp_path / "a.geojson"
    K.write_geojson(spark.createDataFrame([], "f string"), "f", str(path))
    assert json.loads(path.read_text()) == {"type": "FeatureCollection", "features": []}


def test_gpx_escapes_the_title(spark):
    sites = spark.createDataFrame([(1, 0.5, 1200, "x & y", False, None, 49.0, -118.0)], "rank int, score double, elevation_m int, land_status string, on_cutblock boolean, years_since_logging int, lat double, lon double")
    text = K.gpx(sites, "A & B", F.col("land_status"))
    assert "<name>A &amp; B</name>" in text and "x &amp; y" in text and text.count("<wpt") == 1
