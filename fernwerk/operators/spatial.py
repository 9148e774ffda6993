"""Grids, projections, polygons on cells, and joins by distance."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fernwerk.functions.curves import num

# Fixed values of the GRS 80 ellipsoid and of the BC Albers projection.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
ALBERS = {"lat1": 50.0, "lat2": 58.5, "lat0": 45.0, "lon0": -126.0, "x0": 1_000_000.0, "y0": 0.0}


@dataclass(frozen=True)
class Grid:
    """A north-up grid: left and top edge, size of a cell, numbers of rows and columns."""

    left: float
    top: float
    resolution: float
    rows: int
    cols: int

    @classmethod
    def around(cls, left: float, bottom: float, right: float, top: float, resolution: float) -> Grid:
        """The bounds moved outward to whole cells."""
        x0, y0 = math.floor(left / resolution) * resolution, math.floor(bottom / resolution) * resolution
        x1, y1 = math.ceil(right / resolution) * resolution, math.ceil(top / resolution) * resolution
        return cls(x0, y1, resolution, int(round((y1 - y0) / resolution)), int(round((x1 - x0) / resolution)))

    def cells(self, spark) -> DataFrame:
        """One row a cell with its centre."""
        i = F.col("id")
        return spark.range(self.rows * self.cols).select(F.expr(f"cast(id div {self.cols} as int)").alias("row"), (i % self.cols).cast("int").alias("col")).select("row", "col", self.x(F.col("col")).alias("x"), self.y(F.col("row")).alias("y"))

    def x(self, col: Column) -> Column:
        return num(self.left) + (col + num(0.5)) * num(self.resolution)

    def y(self, row: Column) -> Column:
        return num(self.top) - (row + num(0.5)) * num(self.resolution)

    def cell_of(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """Row and column of each point that has one. Quotients are cut toward zero before the range is checked, so a
        point less than a cell left of or above the grid falls into its first column or row."""
        out = points.withColumn("row", ((num(self.top) - F.col(y)) / num(self.resolution)).cast("int")).withColumn("col", ((F.col(x) - num(self.left)) / num(self.resolution)).cast("int"))
        return out.where((F.col("row") >= 0) & (F.col("row") < self.rows) & (F.col("col") >= 0) & (F.col("col") < self.cols))

    @property
    def cell_ha(self) -> float:
        return self.resolution**2 / 10_000

    def site_limits(self, min_ha: float, max_ha: float, separation_m: float) -> tuple[int, int, int]:
        """Least and most cells of a site, and the spacing of peaks in cells."""
        return max(round(min_ha / self.cell_ha), 1), int(max_ha / self.cell_ha), max(round(separation_m / self.resolution), 1)


def snapped(left: Column, bottom: Column, right: Column, top: Column, resolution: float) -> list[Column]:
    """left_, top, rows and cols of `Grid.around` as columns."""
    res = num(resolution)
    x0, y0, x1, y1 = (f(c / res) * res for f, c in ((F.floor, left), (F.floor, bottom), (F.ceil, right), (F.ceil, top)))
    return [x0.cast("double").alias("left_"), y1.cast("double").alias("top"), F.round((y1 - y0) / res).cast("int").alias("rows"), F.round((x1 - x0) / res).cast("int").alias("cols")]


def site_limits(resolution: Column, min_ha: float, max_ha: float, separation_m: float) -> list[Column]:
    """cell_ha, and the limits of `Grid.site_limits`, as columns."""
    ha = resolution * resolution / num(10_000)
    least, spacing = (F.greatest(F.bround(x, 0).cast("int"), F.lit(1)) for x in (num(min_ha) / ha, num(separation_m) / resolution))
    return [ha.alias("cell_ha"), least.alias("min_cells"), (num(max_ha) / ha).cast("int").alias("max_cells"), spacing.alias("spacing")]


def utm_zone(lon: float) -> int:
    return int((lon + 180) // 6) + 1


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) by Krueger's series to the sixth power of the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
    )
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - num(zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - num(e) * F.atanh(num(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(num(1) + t * t))
    x, y = eta, xi
    for j, aj in enumerate(alpha, 1):
        x = x + num(aj) * F.cos(num(2 * j) * xi) * F.sinh(num(2 * j) * eta)
        y = y + num(aj) * F.sin(num(2 * j) * xi) * F.cosh(num(2 * j) * eta)
    return num(500_000) + num(0.9996 * a) * x, num(0.9996 * a) * y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude, the inverse series."""
    n = FLATTENING / (2 - FLATTENING)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45 - 2854 * n**6 / 675,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315 + 2323 * n**6 / 945,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105 + 73814 * n**6 / 2835,
        4279 * n**4 / 630 - 332 * n**5 / 35 - 399572 * n**6 / 14175,
    )
    xi, eta = y / num(0.9996 * a), (x - num(500_000)) / num(0.9996 * a)
    u, v = xi, eta
    for j, bj in enumerate(beta, 1):
        u = u - num(bj) * F.sin(num(2 * j) * xi) * F.cosh(num(2 * j) * eta)
        v = v - num(bj) * F.cos(num(2 * j) * xi) * F.sinh(num(2 * j) * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, dj in enumerate(delta, 1):
        phi = phi + num(dj) * F.sin(num(2 * j) * chi)
    return num(zone * 6 - 183) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area conic coordinates."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    def q(s: object) -> object:
        if isinstance(s, Column):
            return num(1 - e2) * (s / (num(1) - num(e2) * s * s) - num(1 / (2 * e)) * F.log((num(1) - num(e) * s) / (num(1) + num(e) * s)))
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    p1, p2, p0 = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    q1, q2, q0 = (q(math.sin(p)) for p in (p1, p2, p0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
    c = m(p1) ** 2 + n * q1
    rho = num(AXIS / n) * F.sqrt(num(c) - num(n) * q(F.sin(F.radians(lat))))
    rho0 = AXIS / n * math.sqrt(c - n * q0)
    theta = num(n) * F.radians(lon - num(ALBERS["lon0"]))
    return num(ALBERS["x0"]) + rho * F.sin(theta), num(ALBERS["y0"] + rho0) - rho * F.cos(theta)


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings (arrays of points x, y); rings need not be closed."""

    def crossings(ring: Column) -> Column:
        nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.size(F.filter(F.arrays_zip(ring.alias("a"), nxt.alias("b")), lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < F.try_divide((s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]), s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1


def polygon_cells(polygons: DataFrame, grid: Grid, rings: str = "rings") -> DataFrame:
    """Each polygon with the cells (row, col) whose centre is inside: cells of its bounds, then the even-odd rule."""
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    res = num(grid.resolution)
    lo_c = F.greatest(F.floor((F.array_min(xs) - num(grid.left)) / res).cast("int"), F.lit(0))
    hi_c = F.least(F.floor((F.array_max(xs) - num(grid.left)) / res).cast("int"), F.lit(grid.cols - 1))
    lo_r = F.greatest(F.floor((num(grid.top) - F.array_max(ys)) / res).cast("int"), F.lit(0))
    hi_r = F.least(F.floor((num(grid.top) - F.array_min(ys)) / res).cast("int"), F.lit(grid.rows - 1))
    seq = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    rows = polygons.withColumn("row", F.explode(seq(lo_r, hi_r))).withColumn("col", F.explode(seq(lo_c, hi_c)))
    return rows.where(inside(grid.x(F.col("col")), grid.y(F.col("row")), F.col(rings)))


def line_cells(lines: DataFrame, grid: Grid, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """Each segment with all cells that it touches: per row of cells crossed, the columns between the crossings."""
    res = num(grid.resolution)
    cx0, cx1 = ((F.col(x) - num(grid.left)) / res for x in (x0, x1))
    cy0, cy1 = ((num(grid.top) - F.col(y)) / res for y in (y0, y1))
    lines = lines.withColumn("_u0", F.when(cy0 <= cy1, cx0).otherwise(cx1)).withColumn("_v0", F.least(cy0, cy1)).withColumn("_u1", F.when(cy0 <= cy1, cx1).otherwise(cx0)).withColumn("_v1", F.greatest(cy0, cy1))
    rows = lines.withColumn("row", F.explode(F.sequence(F.floor("_v0").cast("int"), F.floor("_v1").cast("int"))))
    slope = F.try_divide(F.col("_u1") - F.col("_u0"), F.col("_v1") - F.col("_v0"))
    at = lambda v: F.coalesce(F.col("_u0") + slope * (v - F.col("_v0")), F.col("_u0"))
    level = F.col("_v0") == F.col("_v1")
    a = F.when(level, F.col("_u0")).otherwise(at(F.greatest(F.col("row").cast("double"), F.col("_v0"))))
    b = F.when(level, F.col("_u1")).otherwise(at(F.least((F.col("row") + 1).cast("double"), F.col("_v1"))))
    rows = rows.withColumn("col", F.explode(F.sequence(F.floor(F.least(a, b)).cast("int"), F.floor(F.greatest(a, b)).cast("int"))))
    keep = (F.col("row") >= 0) & (F.col("row") < grid.rows) & (F.col("col") >= 0) & (F.col("col") < grid.cols)
    return rows.where(keep).drop("_u0", "_v0", "_u1", "_v1")


def segments(lines: DataFrame, parts: str) -> DataFrame:
    """Segments (part, place, x0, y0, x1, y1) of lines of several parts (arrays of arrays of points x, y); other columns stay."""
    rest = [c for c in lines.columns if c != parts]
    rows = lines.select(*rest, F.posexplode(parts).alias("part", "_pts"))
    nxt = F.slice("_pts", F.lit(2), F.greatest(F.size("_pts") - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(F.col("_pts").alias("a"), nxt.alias("b")), lambda s: s["b"].isNotNull())
    rows = rows.select(*rest, "part", F.posexplode(pairs).alias("place", "_s"))
    return rows.select(*rest, "part", "place", *(F.col(f"_s.{e}.{c}").alias(f"{c}{i}") for i, e in enumerate("ab") for c in "xy"))


def touched_cells(polygons: DataFrame, grid: Grid, rings: str = "rings") -> DataFrame:
    """(row, col) of all cells that any polygon touches: those whose centre is inside, and those that an edge passes through."""
    closed = F.transform(F.col(rings), lambda r: F.concat(r, F.slice(r, 1, 1)))
    edges = segments(polygons.select(closed.alias("_rings")), "_rings")
    return polygon_cells(polygons, grid, rings).select("row", "col").union(line_cells(edges, grid).select("row", "col")).distinct()


def rectangle_cells(boxes: DataFrame) -> DataFrame:
    """Rectangles (row0, col0, row1, col1 inclusive) with their cells."""
    return boxes.withColumn("row", F.explode(F.sequence("row0", "row1"))).withColumn("col", F.explode(F.sequence("col0", "col1")))


def within(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of both sides no further apart than the radius, as ``d``: an equi-join on tiles of that size, not a cross join.

    Each left row looks in the nine tiles around it.
    """
    tile = lambda c: F.floor(F.col(c) / num(radius)).cast("long")
    reach = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    a = left.withColumn("_tx", F.explode(F.transform(reach, lambda i: tile(left_xy[0]) + i))).withColumn("_ty", F.explode(F.transform(reach, lambda i: tile(left_xy[1]) + i)))
    b = right.withColumn("_tx", tile(right_xy[0])).withColumn("_ty", tile(right_xy[1]))
    out = a.join(b, ["_tx", "_ty"]).drop("_tx", "_ty")
    d = F.sqrt((F.col(left_xy[0]) - F.col(right_xy[0])) ** 2 + (F.col(left_xy[1]) - F.col(right_xy[1])) ** 2)
    return out.withColumn("d", d).where(F.col("d") <= radius)


def length(points: Column) -> Column:
    """Length of a line given as an array of points x, y."""
    nxt = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(points.alias("a"), nxt.alias("b")), lambda s: s["b"].isNotNull())
    return F.aggregate(pairs, num(0), lambda t, s: t + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))
