import dataclasses
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwerk import cli
from fernwerk.operators.spatial import Grid, from_utm, to_utm
from fernwerk.plans.build import Build, MissingLayerError
from fernwerk.sources.geotiff import write_geotiff
from fernwerk.sources.profiles import Config, ConfigError

X, Y, N, RES = 450_000.0, 5_439_990.0, 24, 30.0


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A square of 24 cells on a slope that faces south, with a road along its south edge."""
    root = tmp_path_factory.mktemp("world")
    corner = lambda x, y: spark.range(1).select(*from_utm(F.lit(x), F.lit(y), 11)).first()
    lon0, lat0 = corner(X + 1, Y + 1)
    lon1, lat1 = corner(X + N * RES - 1, Y + N * RES - 1)
    lon2, lat2 = corner(X + 1, Y + N * RES - 1)
    lon3, lat3 = corner(X + N * RES - 1, Y + 1)
    spectral = {
        "id": "arnica", "folk_magic": {"folk_names": ["leopard's bane"], "traditions": ["Alpine"], "associations": [{"theme": "healing", "note": "n", "origin": "o"}], "safety": {"level": "toxic", "note": "not to be eaten"}, "sources": ["s"]},
        "terrain": {"elevation_m": {"hard_min": 900, "optimal_min": 1000, "optimal_max": 2000, "hard_max": 2200}, "slope_deg": {"optimal_min": 0, "optimal_max": 25, "hard_max": 40}, "aspect": {"optimal_bearing_deg": 180, "tolerance_deg": 45, "flat_slope_deg": 3}},
        "vegetation": {"ndvi": {"hard_min": 0.1, "optimal_min": 0.3, "optimal_max": 0.8}, "ndmi": {"open_max": -0.2, "closed_min": 0.4}, "openness_preference": {"bare": 0.1, "meadow": 1, "open_forest": 0.6, "closed_forest": 0.1}, "logging": {"penalty": 0.3, "recovery_years": 45}},
        "observations": {"taxon_name": "Arnica latifolia", "boost_radius_m": 60, "no_observation_baseline": 0.5, "congeners_downweight": []},
    }
    host = {k: spectral[k] for k in ("terrain", "observations", "folk_magic")} | {
        "id": "cedar", "habitat_model": "host_trees", "weights_override": {"weights": {"terrain": 0.3, "forest": 0.3, "access": 0.2, "observations": 0.1, "moisture": 0.1}},
        "forest": {"host_affinity": {"CW": 1.0, "HW": 0.5}, "host_fraction": {"hard_min": 0.2, "saturation": 0.6}, "stand_age_credit": {"knots": [[0, 0], [50, 1], [300, 1]]}, "crown_closure_pct": {"hard_min": 10, "optimal_min": 30, "optimal_max": 100, "hard_max": None}},
        "moisture": {"water_distance_m": {"optimal_max": 60, "zero_at": 900}, "tpi": {"radius_m": 60, "wet_at_m": -4, "dry_at_m": 6}, "blend": {"water": 0.7, "tpi": 0.3}, "water_features": ["streams", "lakes"]},
    }
    weights = {"weights": {"terrain": 0.3, "vegetation": 0.3, "access": 0.2, "observations": 0.2}, "terrain_subweights": {"elevation": 0.45, "slope": 0.25, "aspect": 0.3}, "access_subweights": {"drive": 0.4, "hike": 0.6}, "legality": {"exclude_from_ranking": ["national_park"], "unflagged_default": "crown_land"}}
    pipeline = {"aoi": "aoi/a.geojson", "species": "species/arnica.json", "weights": "weights.json", "grid": {"resolution_m": RES}, "access": {"origin": {"lon": lon0, "lat": lat0}, "max_drive_minutes": 90, "max_hike_km": 6, "offtrail_penalty": 1.6}, "sites": {"selection": "percentile", "score_percentile": 80, "min_score": 0.2, "min_area_ha": 0.2, "max_area_ha": 3, "separation_m": 120, "max_sites": 5}}
    for name, value in {"pipeline.json": pipeline, "weights.json": weights, "species/arnica.json": spectral, "species/cedar.json": host, "aoi/a.geojson": {"features": [{"geometry": {"type": "Polygon", "coordinates": [[[lon0, lat0], [lon3, lat3], [lon1, lat1], [lon2, lat2]]]}}]}}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(json.dumps(value))
    data = str(root / "data")
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{data}/{name}.parquet")
    box = lambda r0, c0, r1, c1: [[{"x": X + c * RES, "y": Y + (N - r) * RES} for r, c in ((r0, c0), (r0, c1), (r1, c1), (r1, c0))]]
    ring = "array<array<struct<x:double,y:double>>>"
    save("elevation", [(r, c, 1000.0 + 8 * (N - r)) for r in range(N) for c in range(N)], "row int, col int, z double")
    save("pixels", [(s, r, c, 1500.0, 3000.0 + 20 * (c // 3), 2500.0, 4, "05.00") for s in range(2) for r in range(3 * N) for c in range(3 * N)], "scene int, frow int, fcol int, red double, nir double, swir double, scl int, baseline string")
    save("blocks", [(box(0, 0, 4, 4), 2020)], f"rings {ring}, harvest_year int")
    save("stands", [(1, "T", 120.0, 60.0, box(0, 0, N, 12)), (2, "N", None, None, box(0, 12, N, N))], f"stand_id long, level2 string, age double, closure double, rings {ring}")
    save("stand_species", [(1, 1, "CW", 60.0), (1, 2, "HW", 40.0)], "stand_id long, slot int, code string, pct double")
    save("streams", [(X, Y + 300, X + N * RES, Y + 300, 2)], "x0 double, y0 double, x1 double, y1 double, stream_order int")
    save("roads", [(i, X + i * 240.0, Y + 15, X + (i + 1) * 240.0, Y + 15, "local", None, None, None) for i in range(3)], "segment_id long, x0 double, y0 double, x1 double, y1 double, class string, surface string, status string, source string")
    save("tenure", [("national", None, box(0, 20, N, N)), ("private", None, box(0, 18, N, 20)), ("park", "CONSERVANCY", box(0, 20, 3, N))], f"layer string, designation string, rings {ring}")
    save("observations", [(1, "Arnica latifolia", 10.0, False, X + 100, Y + 400), (2, "Arnica latifolia", 10.0, True, X + 100, Y + 400)], "id long, taxon string, accuracy_m double, obscured boolean, x double, y double")
    return root


def pixels(path):
    data, at, packed = path.read_bytes(), 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]
        if kind == b"IHDR":
            cols, rows = struct.unpack(">II", body[:8])
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(rows, 1 + 4 * cols)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(rows, cols, 4)


def test_a_bad_block_of_lore_stops_the_build(spark, world, tmp_path):
    cfg = Config.load(world)
    for block in (None, "text", {"folk_names": ["a"]}, cfg.species["folk_magic"] | {"safety": {"level": "mild", "note": "n"}}):
        bad = dataclasses.replace(cfg, species=cfg.species | {"folk_magic": block})
        with pytest.raises(ConfigError, match="arnica"):
            Build(spark, bad, str(world / "data"), str(tmp_path))


def test_elevation_from_a_geotiff(spark, world, tmp_path):
    """The plane of the world's elevations on a grid of degrees with cells of its own comes out the same, but for the rim."""
    b = Build(spark, Config.load(world), str(tmp_path), str(tmp_path))
    with pytest.raises(MissingLayerError):
        b.elevation()
    west, south, east, north = b.bounds
    far = Grid(west - 0.002, north + 0.002, 0.0002, int((north - south + 0.004) / 0.0002), int((east - west + 0.004) / 0.0002))
    x, y = to_utm(F.col("x"), F.col("y"), b.zone)
    write_geotiff(far.cells(spark).withColumn("z", 1000 + 8 * (b.grid.top - y) / RES), "z", far, 4326, f"{tmp_path}/elevation.tif")
    rows = b.elevation().collect()
    assert len(rows) == N * N and all(r["z"] == pytest.approx(1000 + 8 * (r["row"] + 0.5), abs=0.01) for r in rows)
    write_geotiff(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, z double"), "z", Grid(0, 0, 1, 1, 1), 3005, f"{tmp_path}/elevation.tif")
    with pytest.raises(ConfigError, match="3005"):
        b.elevation()


def test_scoring_needs_its_layers(spark, world, tmp_path):
    with pytest.raises(MissingLayerError):
        Build(spark, Config.load(world), str(world / "data"), str(tmp_path)).scoring()


def test_spectral_build_from_tables_to_sites(spark, world, tmp_path, capsys):
    assert cli.main(["run", "--config", str(world), "--data", str(world / "data"), "--out", str(tmp_path)]) == 0
    assert "[forest] not part of this profile" in capsys.readouterr().out
    b = Build(spark, Config.load(world), str(world / "data"), str(tmp_path))
    assert (b.grid.rows, b.grid.cols, b.grid.left, b.grid.top) == (N, N, X, Y + N * RES)
    ground = b.layer("ground").where("row = 10 and col = 10").first()
    assert ground["aspect"] == pytest.approx(180) and ground["slope"] == pytest.approx(14.93, abs=0.01)
    cells = {(r["row"], r["col"]): r for r in b.layer("suitability").collect()}
    assert len(cells) == N * N
    assert all(cells[r, 22]["score"] is None for r in range(N)) and cells[12, 10]["score"] > cells[2, 2]["score"]
    web = tmp_path / "web" / "a" / "arnica"
    sites = json.loads((web / "sites.geojson").read_text())["features"]
    assert 1 <= len(sites) <= 5 and sites[0]["properties"]["rank"] == 1
    assert sites[0]["properties"]["land_status"] in ("crown_land", "private") and sites[0]["properties"]["aspect_compass"] == "S"
    manifest = json.loads((web / "manifest.json").read_text())
    assert manifest["counts"]["sites"] == len(sites) and manifest["species"]["folk_magic"]["disclaimer"] and manifest["species"]["habitat_label"] == "Vegetation"
    layers = manifest["raster_layers"]
    assert list(layers) == ["suitability", "elevation", "slope", "ndvi", "aspect", "vegetation", "logging_age", "land_tenure"]
    assert layers["vegetation"]["legend"][0] == ["#aa9682", "bare"] and layers["land_tenure"]["legend_key"] == "land_tenure" and "min" not in layers["aspect"]
    assert 1000 <= layers["elevation"]["min"] < layers["elevation"]["max"] <= 1192 and (layers["ndvi"]["min"], layers["ndvi"]["max"]) == (0, 1)
    (south, west), (north, east) = manifest["image_bounds"]
    pictures = {k: pixels(web / v["file"]) for k, v in layers.items()}
    assert {p.shape for p in pictures.values()} == {(N, round(N * (east - west) / (north - south)), 4)}
    wide = pictures["land_tenure"].shape[1]
    assert tuple(pictures["land_tenure"][12, wide - 1]) == (60, 130, 90, 190) and pictures["land_tenure"][12, 2, 3] == 0
    assert pictures["suitability"][12, wide - 1, 3] == 0 and pictures["suitability"][12, wide // 2, 3] == 200
    assert tuple(pictures["elevation"][0, wide // 2][:3]) == (250, 250, 252)
    records = json.loads((web / "observations.geojson").read_text())["features"]
    assert [r["properties"]["id"] for r in records] == [1] and records[0]["properties"]["weight"] == 1 and west <= records[0]["geometry"]["coordinates"][0] <= east
    roads = json.loads((web / "roads.geojson").read_text())["features"]
    assert len(roads) == 3 and roads[0]["properties"] == {"class": "local"} and len(roads[0]["geometry"]["coordinates"]) == 2
    (park,) = json.loads((web / "protected_areas.geojson").read_text())["features"]
    assert park["properties"] == {"designation": "CONSERVANCY"} and park["geometry"]["coordinates"][0][0] == park["geometry"]["coordinates"][0][-1]
    assert json.loads((web / "aoi.geojson").read_text())["features"] and not (web / "trails.geojson").exists()
    assert json.loads((tmp_path / "web" / "index.json").read_text())["areas"][0]["id"] == "a/arnica"
    assert (web / "suitability.png").read_bytes()[:4] == b"\x89PNG" and len((web / "sites.csv").read_text().splitlines()) == len(sites) + 1
    again = Build(spark, Config.load(world), str(world / "data"), str(tmp_path)).run(["vegetation", "scoring"], reuse_imagery=True)
    assert again == ["vegetation", "scoring"]


def test_host_tree_build_with_moisture(spark, world, tmp_path):
    b = Build(spark, Config.load(world, species="species/cedar.json"), str(world / "data"), str(tmp_path))
    assert "forest" in b.run() and b.components() == ["terrain", "forest", "access", "observations", "moisture"]
    sites = b.layer("sites").collect()
    assert sites and all(s["col"] < 12 and s["veg_class"] == "host-rich forest" and s["leading_species"] == "western redcedar 60%" for s in sites)
    wet = {r["row"]: r["water_distance_m"] for r in b.layer("moisture").where("col = 5").collect()}
    assert min(wet.values()) == 0 and wet[0] > 300
