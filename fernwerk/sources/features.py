"""A feature service as a Spark data source: one partition a tile, tiles split until they are under the service's cap.

``spark.dataSource.register(FeatureSource); spark.read.format("features").option("url", ...).load()``. Tested against a small service of
the tests' own: the container has no network. A folder of GeoJSON files per layer can stand in (option ``folder``).
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fernwerk.sources.tables import FEATURE_CAP, SPLIT_DEPTH, Bounds, layer_name, quadrants, retrying


@dataclass
class Tile(InputPartition):
    bounds: Bounds


class FeatureSource(DataSource):
    """Options: url or folder, layer, bounds (west,south,east,north), properties (comma-separated), filter, cap, depth, geometry (the
    name of the geometry column; by default the service is asked), cache (a folder that all executors share; answers are kept there)."""

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "id string, properties map<string,string>, geometry string, xmin double, ymin double, xmax double, ymax double"

    def reader(self, schema: object) -> DataSourceReader:
        return FeatureReader(dict(self.options))


def bounds_of(geometry: dict | None) -> Bounds | None:
    """The box around a geometry."""
    points: list[tuple[float, float]] = []
    todo = [geometry["coordinates"]] if geometry and geometry.get("coordinates") else []
    while todo:
        x = todo.pop()
        if x and isinstance(x[0], (int, float)):
            points.append((x[0], x[1]))
        else:
            todo += x
    return (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else None


def geometry_column(description: str) -> str:
    """The first attribute of a geometry type in a service's description of a layer; GEOMETRY if there is none, or none that can be read."""
    try:
        parts = ET.fromstring(description).iter("{http://www.w3.org/2001/XMLSchema}element")
    except ET.ParseError:
        return "GEOMETRY"
    kinds = ("Geometry", "Surface", "Curve", "Point", "Polygon", "LineString")
    for e in parts:
        prefix, _, kind = e.get("type", "").partition(":")
        if prefix == "gml" and kind.endswith("PropertyType") and any(k in kind for k in kinds):
            return e.get("name", "GEOMETRY")
    return "GEOMETRY"


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.layer = options["layer"]
        self.bounds: Bounds = tuple(float(x) for x in options["bounds"].split(","))
        self.cap, self.depth = int(options.get("cap", FEATURE_CAP)), int(options.get("depth", SPLIT_DEPTH))

    def _answer(self, query: dict[str, str]) -> bytes:
        """The service's answer, from the cache if it has been given before. A file appears in the cache when it is whole."""
        url = f"{self.options['url']}?{urllib.parse.urlencode(query)}"
        kept = Path(self.options["cache"]) / hashlib.sha1(url.encode()).hexdigest() if "cache" in self.options else None
        if kept and kept.exists():
            return kept.read_bytes()
        with urllib.request.urlopen(url, timeout=120) as r:  # noqa: S310
            found = r.read()
        if kept:
            kept.parent.mkdir(parents=True, exist_ok=True)
            part = kept.with_name(f"{kept.name}.{os.getpid()}")
            part.write_bytes(found)
            part.replace(kept)
        return found

    def _geometry(self) -> str:
        """Layers do not agree on the name of their geometry, and a box on a wrong name is refused."""
        if "geometry" not in self.options:
            query = {"service": "WFS", "version": "2.0.0", "request": "DescribeFeatureType", "typeNames": f"pub:{layer_name(self.layer)}"}
            try:
                self.options["geometry"] = geometry_column(retrying(self._answer)(query).decode("utf-8", "replace"))
            except OSError:
                self.options["geometry"] = "GEOMETRY"
        return self.options["geometry"]

    def _request(self, bounds: Bounds, **more: str) -> bytes:
        o = self.options
        box = f"BBOX({self._geometry()}," + ",".join(f"{x:.3f}" for x in bounds) + ")"
        query = {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeNames": f"pub:{layer_name(self.layer)}", "srsName": "EPSG:3005", "CQL_FILTER": f"({box}) AND ({o['filter']})" if o.get("filter") else box} | more
        return self._answer(query)

    def _features(self, bounds: Bounds) -> list[dict]:
        if "folder" in self.options:
            found = json.loads((Path(self.options["folder"]) / f"{self.layer}.geojson").read_text(encoding="utf-8"))["features"]
            boxes = [bounds_of(f["geometry"]) for f in found]
            return [f for f, b in zip(found, boxes) if b and b[2] >= bounds[0] and b[0] <= bounds[2] and b[3] >= bounds[1] and b[1] <= bounds[3]]
        more = {"propertyName": ",".join([*self.options["properties"].split(","), self._geometry()])} if self.options.get("properties") else {}
        return json.loads(retrying(self._request)(bounds, outputFormat="application/json", count=str(self.cap), **more))["features"]

    def _count(self, bounds: Bounds) -> int:
        if "folder" in self.options:
            return len(self._features(bounds))
        hits = ET.fromstring(retrying(self._request)(bounds, resultType="hits"))
        return int(hits.get("numberMatched") or 0)

    def partitions(self) -> list[Tile]:
        return [Tile(b) for b, n in quadrants(self.bounds, self._count, self.cap, self.depth) if n]

    def read(self, partition: Tile) -> Iterator[tuple]:
        """Features of the tile. One that lies in several tiles comes from each: take `first_by_id`."""
        for f in self._features(partition.bounds):
            box = bounds_of(f["geometry"]) or (None,) * 4
            p = {k: None if v is None else str(v) for k, v in (f.get("properties") or {}).items()}
            yield (str(f.get("id") or p.get("OBJECTID") or p.get("FEATURE_ID")), p, json.dumps(f["geometry"]), *box)
