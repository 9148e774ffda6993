import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from fernwerk import cli
from fernwerk.operators.spatial import Grid
from fernwerk.sources import layers as Y
from fernwerk.sources.features import FeatureSource, bounds_of, geometry_column
from fernwerk.sources.profiles import ConfigError
from fernwerk.sources.tables import first_by_id, layer_name
from fernwerk.streaming.occurrences import seeds


def test_tiles_of_a_feature_service(spark, tmp_path):
    features = [{"type": "Feature", "id": f"f{i}", "properties": {"OBJECTID": i, "x": None}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in range(20)]
    features.append({"type": "Feature", "id": "wide", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[1, 1], [19, 19]]}})
    (tmp_path / "roads_dra.geojson").write_text(json.dumps({"features": features}))
    spark.dataSource.register(FeatureSource)
    df = spark.read.format("features").options(folder=str(tmp_path), layer="roads_dra", bounds="0,0,20,20", cap="8").load()
    assert df.rdd.getNumPartitions() > 1
    assert first_by_id(df, "id", ["id"]).count() == 21
    assert bounds_of({"type": "LineString", "coordinates": [[1, 5], [3, 2]]}) == (1, 2, 3, 5)
    assert layer_name("vri").startswith("WHSE") and layer_name("A.B") == "A.B"
    with pytest.raises(KeyError):
        layer_name("nothing")


SCHEMA = '<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema"><xsd:element name="ID" type="xsd:int"/><xsd:element name="SHAPE" nillable="true" type="gml:MultiSurfacePropertyType"/></xsd:schema>'


@pytest.fixture
def service():
    """A service of 20 points whose geometry is called SHAPE; a box on any other name is refused. The first request of all fails."""
    seen = []

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen.append(q)
            box = re.match(r"\(?BBOX\(SHAPE,([^)]*)\)", q.get("CQL_FILTER", ""))
            bad = len(seen) == 1 or not q["typeNames"].startswith("pub:") or (q["request"] == "GetFeature" and not box)
            body = SCHEMA
            if box:
                x0, y0, x1, y1 = map(float, box[1].split(","))
                inside = [i for i in range(20) if x0 <= i <= x1 and y0 <= i <= y1]
                found = [{"id": f"f{i}", "properties": {"ID": i}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in inside]
                body = f'<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" numberMatched="{len(inside)}"/>' if q.get("resultType") == "hits" else json.dumps({"features": found})
            self.send_response(400 if bad else 200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/wfs", seen
    server.shutdown()


def test_a_service_names_its_geometry_and_is_asked_once(spark, service, tmp_path):
    url, seen = service
    spark.dataSource.register(FeatureSource)
    read = lambda: spark.read.format("features").options(url=url, layer="roads_dra", bounds="0,0,20,20", cap="8", properties="ID", filter="ID >= 0", cache=str(tmp_path / "kept")).load()
    rows = {r["id"]: r for r in read().collect()}
    assert len(rows) == 20 and rows["f3"]["properties"] == {"ID": "3"} and (rows["f3"]["xmin"], rows["f3"]["ymax"]) == (3, 3)
    pages = [q for q in seen if "outputFormat" in q]
    assert pages and all(q["propertyName"] == "ID,SHAPE" and q["CQL_FILTER"].endswith("AND (ID >= 0)") for q in pages)
    asked = len(seen)
    assert read().count() >= 20 and len(seen) == asked


def test_geometry_columns():
    assert geometry_column(SCHEMA) == "SHAPE"
    assert geometry_column("<a/>") == geometry_column("not a description") == "GEOMETRY"


def test_layers_fall_back_to_the_shared_one(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, z double")
    Y.write_layer(cells, str(tmp_path), "elevation", "a")
    Y.write_layer(cells.withColumn("z", F.lit(2.0)), str(tmp_path), "elevation", "a", "s")
    read = lambda **k: Y.read_layer(spark, str(tmp_path), "elevation", "a", **k)
    assert read(species="s").first()["z"] == 2 and read(species="t").first()["z"] == 1
    assert read(species="t", never_shared=True) is None


def config(tmp_path):
    files = {
        "pipeline.json": {"$comment": "x", "aoi": "aoi/a.geojson", "species": "species/s.json", "weights": "weights.json", "access": {"origin": {"name": "o"}, "max_hike_km": 6}},
        "aoi/a.geojson": {"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]},
        "species/s.json": {"id": "s", "weights_override": {"weights": {"terrain": 1, "moisture": 1}}, "moisture": {}},
        "weights.json": {"weights": {"terrain": 0.3}, "terrain_subweights": {}},
    }
    for name, value in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(json.dumps(value))
    return tmp_path


def test_config_manifest_and_index(spark, tmp_path):
    cfg = cli.Config.load(config(tmp_path))
    assert cfg.weights["weights"] == {"terrain": 1, "moisture": 1} and cfg.rings() == [[[(0, 0), (1, 0), (1, 1)]]]
    sites = spark.createDataFrame([(0.5, 1000, 5.0, 1.0, True)], "score double, elevation_m int, drive_minutes double, hike_km double, land_flagged boolean")
    m = Y.manifest(cfg, sites)
    assert m["counts"] == {"sites": 1, "flagged": 1} and m["ranges"]["elevation_m"] == [1000, 1000]
    none = Y.manifest(cfg, sites.limit(0))
    assert none["counts"] == {"sites": 0, "flagged": 0} and none["ranges"]["score"] == [0, 1]
    out = tmp_path / "web"
    (out / "a" / "s").mkdir(parents=True)
    (out / "a" / "s" / "manifest.json").write_text(json.dumps(m))
    (out / "old.manifest.json").write_text("{}")
    assert [(x["id"], x["label"], x["sites"]) for x in Y.write_index(spark, out)] == [("a/s", "a", 1)]
    assert Y.publish([out / "index.json", out / "missing"], tmp_path / "copy")
    assert Y.legend({1: (255, 0, 16)}, {1: "x"}) == [["#ff0010", "x"]]


def test_command_line(tmp_path, capsys):
    root = config(tmp_path)
    assert cli.main(["areas", "--config", str(root)]) == 0 and capsys.readouterr().out == "a\n"
    with pytest.raises(ConfigError):
        cli.main(["run", "--config", str(root), "--skip", "nothing"])


def test_records_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "Rosa", 5.0, 5.0, False), ("2024-01-02 00:00:00", "Rubus", 5.0, 5.0, None), ("2024-01-02 00:00:00", "Rosa", 5.0, 5.0, True), ("2024-03-01 00:00:00", "Rosa", 15.0, 5.0, False)]
    df = spark.createDataFrame(rows, "t string, taxon string, x double, y double, obscured boolean").select(F.to_timestamp("t").alias("ts"), "taxon", "x", "y", "obscured")
    grid = Grid(0, 10, 10, 1, 2)
    batch = {(r["row"], r["col"], r["weight"], r["records"]) for r in seeds(df, grid, "Rosa", []).collect()}
    assert batch == {(0, 0, 1.5, 2), (0, 1, 1.0, 1)}
    df.write.parquet(str(tmp_path / "in"))
    stream = seeds(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), grid, "Rosa", [])
    q = stream.writeStream.format("memory").queryName("seeds").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["row"], r["col"], r["weight"], r["records"]) for r in spark.table("seeds").collect()} == batch
