"""Source operators over tables that stand for the remote services, and their driver-side helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# The services' layer names.
LAYERS = {
    "roads_dra": "WHSE_BASEMAPPING.DRA_DGTL_ROAD_ATLAS_MPAR_SP",
    "roads_ften": "WHSE_FOREST_TENURE.FTEN_ROAD_SECTION_LINES_SVW",
    "trails_ften": "WHSE_FOREST_TENURE.FTEN_REC_TRAILS_SVW",
    "parks_provincial": "WHSE_TANTALIS.TA_PARK_ECORES_PA_SVW",
    "parks_national": "WHSE_ADMIN_BOUNDARIES.CLAB_NATIONAL_PARKS",
    "conservancies": "WHSE_TANTALIS.TA_CONSERVANCY_AREAS_SVW",
    "parcels": "WHSE_CADASTRE.PMBC_PARCEL_FABRIC_POLY_SVW",
    "woodlots": "WHSE_FOREST_TENURE.FTEN_MANAGED_LICENCE_POLY_SVW",
    "cutblocks": "WHSE_FOREST_VEGETATION.VEG_CONSOLIDATED_CUT_BLOCKS_SP",
    "vri": "WHSE_FOREST_VEGETATION.VEG_COMP_LYR_R1_POLY",
    "fwa_streams": "WHSE_BASEMAPPING.FWA_STREAM_NETWORKS_SP",
    "fwa_wetlands": "WHSE_BASEMAPPING.FWA_WETLANDS_POLY",
    "fwa_lakes": "WHSE_BASEMAPPING.FWA_LAKES_POLY",
    "fwa_rivers": "WHSE_BASEMAPPING.FWA_RIVERS_POLY",
}
TRAIL_TAGS = ("path", "footway", "track", "bridleway", "steps")
FEATURE_CAP, SPLIT_DEPTH = 10_000, 6
Bounds = tuple[float, float, float, float]


def layer_name(alias: str) -> str:
    """The service's name of a layer; a full name is its own."""
    if alias in LAYERS:
        return LAYERS[alias]
    if "." in alias:
        return alias
    raise KeyError(f"unknown layer {alias!r}; known: {', '.join(sorted(LAYERS))}")


def layer_names(alias: Column) -> Column:
    """`layer_name` as a column; null for an unknown alias."""
    known = F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, alias), F.when(F.contains(alias, F.lit(".")), alias))


def in_bounds(layer: DataFrame, bounds: Bounds, edges: Sequence[str] = ("xmin", "ymin", "xmax", "ymax"), extra: str | None = None) -> DataFrame:
    """Features whose box meets the bounds: comparisons of columns, which reach the Parquet scan."""
    x0, y0, x1, y1 = (F.col(e) for e in edges)
    found = layer.where((x1 >= bounds[0]) & (x0 <= bounds[2]) & (y1 >= bounds[1]) & (y0 <= bounds[3]))
    return found.where(extra) if extra else found


def first_by_id(df: DataFrame, keys: str | list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in the stated order."""
    keys = [keys] if isinstance(keys, str) else keys
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def quadrants(bounds: Bounds, count: Callable[[Bounds], int], cap: int = FEATURE_CAP, depth: int = SPLIT_DEPTH) -> list[tuple[Bounds, int]]:
    """Tiles with at most ``cap`` features each, halved both ways until they are, or the depth is used up."""
    n = count(bounds)
    if n <= cap or depth == 0:
        return [(bounds, n)]
    x0, y0, x1, y1 = bounds
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    parts = ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1))
    return [t for p in parts for t in quadrants(p, count, cap, depth - 1)]


def quadrant_tiles(points: DataFrame, bounds: Bounds, cap: int = FEATURE_CAP, depth: int = SPLIT_DEPTH) -> DataFrame:
    """(depth, tx, ty, features) of the tiles that hold points: a tile of more than ``cap`` is halved both ways, up to ``depth`` times.

    The tiles of `quadrants` without a request a tile: points are counted once in the smallest tiles, at most 4^depth rows, and
    those are added up. Points at the far edges belong to the last tiles.
    """
    most = (1 << depth) - 1
    at = lambda c, lo, hi: F.least(F.greatest(F.floor((F.col(c) - lo) / ((hi - lo) / (most + 1))), F.lit(0)), F.lit(most)).cast("long")
    small = points.where(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3])).groupBy(at("x", bounds[0], bounds[2]).alias("sx"), at("y", bounds[1], bounds[3]).alias("sy")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - depth)")
    every = small.withColumn("depth", levels).withColumn("tx", up("sx")).withColumn("ty", up("sy"))
    total = every.groupBy("depth", "tx", "ty").agg(F.sum("n").alias("features"))
    fits = every.join(total.where((F.col("features") <= cap) | (F.col("depth") == depth)), ["depth", "tx", "ty"])
    own = fits.groupBy("sx", "sy").agg(F.min(F.struct("depth", "tx", "ty", "features")).alias("t"))
    return own.select("t.*").distinct()


def buffered_bounds(points: DataFrame, buffer: float, extra: tuple[float, float] | None = None) -> DataFrame:
    """One row: the box around the points and one more place, widened by the buffer."""
    x, y = F.col("x"), F.col("y")
    lo = lambda c, i: F.least(F.min(c), F.lit(extra[i])) if extra else F.min(c)
    hi = lambda c, i: F.greatest(F.max(c), F.lit(extra[i])) if extra else F.max(c)
    return points.agg(F.round(lo(x, 0) - buffer, 3).alias("west"), F.round(lo(y, 1) - buffer, 3).alias("south"), F.round(hi(x, 0) + buffer, 3).alias("east"), F.round(hi(y, 1) + buffer, 3).alias("north"))


def mosaic(tiles: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each cell's value from the first tile that has one."""
    return tiles.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


class SourceNotAvailableError(NotImplementedError):
    """A source that is declared but not built."""


def elevation_source(name: str) -> str:
    if name == "copernicus":
        return "cop-dem-glo-30"
    if name == "lidarbc":
        raise SourceNotAvailableError("the lidarbc elevation source is not implemented; use copernicus")
    raise ValueError(f"unknown elevation source {name!r}")


def search_scenes(scenes: DataFrame, years: list[int], start: str, end: str, max_cloud: float) -> DataFrame:
    """Scenes under the cloud limit in the window of each year, the clearest of a tile and date."""
    found = scenes.where((F.col("cloud") < max_cloud) & F.date_format("date", "MM-dd").between(start, end) & F.year("date").isin(*years))
    return first_by_id(found, ["tile", "date"], ["cloud", "scene_id"])


def clearest_per_tile(scenes: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("tile").orderBy("cloud", "scene_id")
    return scenes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def trails(ways: DataFrame) -> DataFrame:
    """Ways with a trail tag or a hiking route, of two points or more; without a tag they are paths."""
    wanted = F.coalesce(F.col("highway").isin(*TRAIL_TAGS), F.lit(False)) | F.coalesce(F.col("route") == "hiking", F.lit(False))
    return ways.where(wanted & (F.col("points") >= 2)).withColumn("tag", F.coalesce("highway", F.lit("path")))


def pick_taxon(taxa: DataFrame, name: str) -> DataFrame:
    """The active taxon of exactly this name, in any case, with most observations; of equals the least id."""
    found = taxa.where(F.col("is_active") & (F.lower("name") == name.lower()))
    return found.agg(F.max_by(F.struct(*taxa.columns), F.struct(F.coalesce("observations_count", F.lit(0)), -F.col("id"))).alias("t")).where("t is not null").select("t.*")


def resolve_taxon(taxa: DataFrame, name: str) -> int:
    """The id of a taxon name; the error names the closest ones."""
    row = pick_taxon(taxa, name).first()
    if row is not None:
        return row["id"]
    close = [r["name"] for r in taxa.orderBy(F.levenshtein(F.lower("name"), F.lit(name.lower())), "name").limit(3).collect()]
    raise LookupError(f"no active taxon {name!r}; closest: {', '.join(close)}")


def occurrences(records: DataFrame, bounds: Bounds, months: list[int] | None = None) -> DataFrame:
    """Records with a place inside the bounds, observed in the months."""
    found = records.where(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))
    return found.where(F.month("observed_on").isin(*months)) if months else found


def locate(name: str, have: Mapping[str, set[str]], never_shared: set[str] = frozenset()) -> str | None:
    """Where a layer is taken from: the species' own, the shared, then the output ones; some are never taken from the shared."""
    for place in ("species", "shared", "output"):
        if name in have.get(place, ()) and not (place == "shared" and name in never_shared):
            return place
    return None


def located(have: str, private: str) -> Column:
    """`locate` as a column, of an array of the places that have a layer and of whether it is never taken from the shared ones."""
    place = lambda name: F.array_contains(F.col(have), name)
    return F.when(place("species"), "species").when(place("shared") & ~F.col(private), "shared").when(place("output"), "output")


def retrying(f: Callable, attempts: int = 4, wait: Callable[[float], None] | None = None, first: float = 1.0) -> Callable:
    """Calls f again after errors, with doubled waits; the last error is raised."""
    import time

    pause = wait or time.sleep

    def run(*args: object, **kwargs: object) -> object:
        for i in range(attempts):
            try:
                return f(*args, **kwargs)
            except Exception:
                if i + 1 == attempts:
                    raise
                pause(first * 2**i)
        return None

    return run


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))
