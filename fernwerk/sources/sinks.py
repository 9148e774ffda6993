"""Exports: GeoJSON, manifest, overlays, GPX and CSV."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fernwerk.functions.curves import piecewise
from fernwerk.functions.labels import escape_xml
from fernwerk.operators.stats import exact_percentile
from fernwerk.sources.files import save


def feature(x: Column, y: Column, properties: Sequence[Column]) -> Column:
    """A GeoJSON point feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def shape(kind: str, coordinates: Column, properties: Sequence[Column]) -> Column:
    """A GeoJSON feature of lines or polygons as text."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), (F.struct(*properties) if properties else F.create_map().cast("map<string,string>")).alias("properties")))


def collection(features: DataFrame, column: str) -> Iterator[str]:
    """A FeatureCollection in pieces, feature by feature; without features an empty one."""
    yield '{"type":"FeatureCollection","features":['
    for i, row in enumerate(features.select(column).toLocalIterator()):
        yield ("," if i else "") + row[0]
    yield "]}"


def write_geojson(features: DataFrame, column: str, path: str) -> None:
    save(features.sparkSession, path, collection(features, column))


def counts_and_ranges(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The manifest's figures, of all sites or by group; without sites scores are 0 to 1 and the rest 0."""
    out = [F.count(F.lit(1)).alias("sites"), F.coalesce(F.count_if("land_flagged"), F.lit(0)).alias("flagged")]
    for name, col, high in (("score", "score", 1.0), ("elevation", "elevation_m", 0.0), ("drive", "drive_minutes", 0.0), ("hike", "hike_km", 0.0)):
        c = F.col(col).cast("double")
        out += [F.coalesce(F.min(c), F.lit(0.0)).alias(f"{name}_min"), F.coalesce(F.max(c), F.lit(high)).alias(f"{name}_max")]
    return sites.groupBy(*by).agg(*out)


def waypoint(description: Column) -> Column:
    """One GPX waypoint of a site."""
    name = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.format_string("%.2f", F.col("score") + F.lit(1e-9)), F.lit(" "), F.col("elevation_m").cast("string"), F.lit("m"))
    logged = F.when(F.col("on_cutblock"), F.concat(F.lit("; logged "), F.col("years_since_logging").cast("string"), F.lit(" yr ago"))).otherwise("")
    return F.concat(
        F.format_string('<wpt lat="%.6f" lon="%.6f">', "lat", "lon"),
        F.lit("<ele>"), F.coalesce(F.col("elevation_m").cast("string"), F.lit("0")), F.lit("</ele><name>"), escape_xml(name),
        F.lit("</name><desc>"), escape_xml(F.concat(description, logged)), F.lit("</desc><sym>Flag, Green</sym></wpt>"),
    )


def gpx(sites: DataFrame, title: str, description: Column) -> str:
    """The file of a bounded list of sites, in order of rank."""
    body = [r[0] for r in sites.orderBy("rank").select(waypoint(description)).collect()]
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="fernwerk" xmlns="http://www.topografix.com/GPX/1/1">\n<metadata><name>{safe}</name></metadata>\n' + "\n".join(body) + "\n</gpx>\n"


def csv_line(columns: Sequence[str]) -> Column:
    """Values by commas; those with a comma, quote or line feed in quotes, quotes doubled; NULL is empty."""

    def cell(name: str) -> Column:
        v = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *(cell(c) for c in columns))


def stretch(cells: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Index 0 to 255 of each cell between the bounds, by default the 2nd and 98th percentile; missing is 0 and transparent."""
    lo = exact_percentile(cells, value, 0.02) if low is None else low
    hi = exact_percentile(cells, value, 0.98) if high is None else high
    if lo is None or hi is None:
        return cells.withColumn("idx", F.lit(0)).withColumn("alpha", F.lit(0))
    share = F.least(F.greatest((F.col(value) - lo) / max(hi - lo, 1e-9), F.lit(0.0)), F.lit(1.0))
    known = F.col(value).isNotNull()
    return cells.withColumn("idx", F.when(known, (share * 255).cast("int")).otherwise(0)).withColumn("alpha", F.when(known, 200).otherwise(0))


def ramp(stops: Sequence[tuple[float, int, int, int]], index: Column) -> list[Column]:
    """r, g, b of an index on the colour ramp."""
    t = index / F.lit(255.0)
    return [F.floor(piecewise(t, [(s[0], s[k]) for s in stops]) + 1e-9).cast("int").alias(n) for k, n in ((1, "r"), (2, "g"), (3, "b"))]


def categorical(cells: DataFrame, code: str, colours: Mapping[int, tuple[int, int, int]], opacity: int = 190) -> DataFrame:
    """row, col and colour of each cell; codes without a colour are transparent."""
    pick = lambda k: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for c, v in colours.items() for x in (c, v[k]))), F.col(code)), F.lit(0))
    known = F.coalesce(F.col(code).isin(*colours), F.lit(False))
    return cells.select("row", "col", pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), F.when(known, opacity).otherwise(0).alias("alpha"))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(cells: DataFrame, rows: int, cols: int) -> Iterator[bytes]:
    """An RGBA image in pieces. cells: row, col, r, g, b, alpha, one row for each pixel.

    Lines are put together by Spark and packed one at a time, so that the driver holds one partition of lines at most.
    """
    pixel = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in ("r", "g", "b", "alpha")))
    line = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", pixel.alias("p")))), lambda x: x["p"]), ""))
    yield b"\x89PNG\r\n\x1a\n" + _part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0))
    pack, seen = zlib.compressobj(), 0
    for r in cells.groupBy("row").agg(line.alias("line")).orderBy("row").toLocalIterator():
        if r["row"] != seen or len(r["line"]) != 4 * cols:
            raise ValueError(f"line {r['row']} of the image is not whole")
        seen += 1
        if some := pack.compress(b"\0" + bytes(r["line"])):
            yield _part(b"IDAT", some)
    if seen != rows:
        raise ValueError(f"{seen} of {rows} lines in the image")
    yield _part(b"IDAT", pack.flush()) + _part(b"IEND", b"")


def png(cells: pd.DataFrame, rows: int, cols: int) -> bytes:
    """An RGBA image of row, col, r, g, b, alpha; absent cells are transparent."""
    img = np.zeros((rows, cols, 4), np.uint8)
    img[cells["row"], cells["col"]] = cells[["r", "g", "b", "alpha"]].to_numpy(np.uint8)
    raw = b"".join(b"\0" + line.tobytes() for line in img)
    return b"\x89PNG\r\n\x1a\n" + _part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)) + _part(b"IDAT", zlib.compress(raw)) + _part(b"IEND", b"")


def simplify(points: Sequence[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line with the points left out that are within the tolerance of the rest (Douglas and Peucker)."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    p = np.asarray(points, float).reshape(-1, 2)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, off = p[b] - p[a], p[a + 1 : b] - p[a]
        size = float(np.hypot(*line))
        d = np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / size if size else np.hypot(off[:, 0], off[:, 1])
        i = int(d.argmax())
        if d[i] > tolerance:
            m = a + 1 + i
            keep.add(m)
            stack += [(a, m), (m, b)]
    return [tuple(p[i]) for i in sorted(keep)] if len(points) else []


def simplified(lines: DataFrame, tolerance: float, column: str = "pts") -> DataFrame:
    """Lines (arrays of points x, y) simplified; those left with fewer than two points are dropped."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda pts: [{"x": x, "y": y} for x, y in simplify([(q["x"], q["y"]) for q in pts], tolerance)])

    return lines.withColumn(column, run(column)).where(F.size(column) >= 2)
