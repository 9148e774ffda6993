"""The whole model for one area and species, from input tables to ranked sites.

Inputs are Parquet tables in one folder (columns in parentheses; shapes in metres of the area's UTM zone):
elevation (row, col, z; or elevation.tif), pixels (scene, frow, fcol, red, nir, swir, scl, baseline), blocks and tenure (rings, harvest_year or layer, designation),
stands (stand_id, level2, age, closure, rings), stand_species (stand_id, slot, code, pct), streams (x0, y0, x1, y1, stream_order),
water (rings, kind), roads (segment_id, x0, y0, x1, y1, class, surface, status, source), trails (x0, y0, x1, y1),
observations (id, taxon, accuracy_m, obscured, x, y). A table that a stage can do without may be absent.
Each stage writes its layers; later stages read them, so a stage can be run again by itself.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernwerk.functions import curves as C, labels as L
from fernwerk.operators import network as N, sites as Z, spatial as S, stencil as T
from fernwerk.operators.stats import exact_percentile
from fernwerk.plans.layers import ndvi_mask, tenure_order, usable, water_mask
from fernwerk.sources import layers as Y, sinks as K
from fernwerk.sources.files import matching, save
from fernwerk.sources.geotiff import GeoTiffSource, raster
from fernwerk.sources.profiles import STAGES, Config, ConfigError, check_lore, lore_manifest, profile_lore
from fernwerk.sources.tables import point
from fernwerk.storage import materialise, release

NEVER_SHARED = {"terrain", "vegetation", "forest", "moisture", "observations"}


class MissingLayerError(ConfigError):
    """A stage needs a layer that no stage has written."""


class Build:
    def __init__(self, spark: SparkSession, cfg: Config, data: str, out: str, as_of_year: int = 2025):
        self.spark, self.cfg, self.data, self.out, self.year = spark, cfg, data.rstrip("/"), out.rstrip("/"), as_of_year
        self.species = cfg.species.get("id", "species")
        check_lore(profile_lore(spark, cfg.species))

    # grid and input

    @cached_property
    def zone(self) -> int:
        points = [p for poly in self.cfg.rings() for p in poly[0]]
        return S.utm_zone(sum(p[0] for p in points) / len(points))

    @cached_property
    def rings(self) -> list[list[list[tuple[float, float]]]]:
        """The area in metres."""
        flat = [(i, j, k, *p) for i, poly in enumerate(self.cfg.rings()) for j, ring in enumerate(poly) for k, p in enumerate(ring)]
        df = self.spark.createDataFrame(flat, "i int, j int, k int, lon double, lat double")
        x, y = S.to_utm(F.col("lon"), F.col("lat"), self.zone)
        out: list = []
        for r in df.select("i", "j", "k", x.alias("x"), y.alias("y")).orderBy("i", "j", "k").collect():
            while len(out) <= r["i"]:
                out.append([])
            while len(out[r["i"]]) <= r["j"]:
                out[r["i"]].append([])
            out[r["i"]][r["j"]].append((r["x"], r["y"]))
        return out

    @cached_property
    def grid(self) -> S.Grid:
        p = [q for poly in self.rings for q in poly[0]]
        return S.Grid.around(min(q[0] for q in p), min(q[1] for q in p), max(q[0] for q in p), max(q[1] for q in p), float(self.cfg.pipeline["grid"]["resolution_m"]))

    def input(self, name: str, needed: bool = True) -> DataFrame | None:
        path = f"{self.data}/{name}.parquet"
        if matching(self.spark, path):
            return self.spark.read.parquet(path)
        if needed:
            raise MissingLayerError(f"no input table {name}")
        return None

    def elevation(self) -> DataFrame:
        """(row, col, z): the table, or a GeoTIFF of that name in degrees or in metres of the area's zone, warped to the grid."""
        table, path = self.input("elevation", False), f"{self.data}/elevation.tif"
        if table is not None or not matching(self.spark, path):
            return table if table is not None else self.input("elevation")
        r = raster(path)
        left, top, dx, dy = r.place
        x, y = F.col("x"), F.col("y")
        if r.epsg in (4326, 4269):
            x, y = S.from_utm(x, y, self.zone)
        elif r.epsg not in (32600 + self.zone, 26900 + self.zone):
            raise ConfigError(f"elevation.tif is in EPSG:{r.epsg}, neither in degrees nor in zone {self.zone}")
        self.spark.dataSource.register(GeoTiffSource)
        cells = self.spark.read.format("geotiff").option("path", path).load().withColumnRenamed("value", "z")
        target = self.grid.cells(self.spark).select("row", "col", ((x - left) / dx - 0.5).alias("u"), ((F.lit(top) - y) / dy - 0.5).alias("v"))
        return T.warp(cells, target, "z")

    @cached_property
    def area(self) -> DataFrame:
        """Cells that the area touches."""
        shape = [(i, [[{"x": x, "y": y} for x, y in ring] for ring in poly]) for i, poly in enumerate(self.rings)]
        polys = self.spark.createDataFrame(shape, "i int, rings array<array<struct<x:double,y:double>>>")
        edges = [(*a, *b) for poly in self.rings for ring in poly for a, b in zip(ring, ring[1:] + ring[:1])]
        lines = self.spark.createDataFrame(edges, "x0 double, y0 double, x1 double, y1 double")
        return S.polygon_cells(polys, self.grid).select("row", "col").union(S.line_cells(lines, self.grid).select("row", "col")).distinct()

    def layer(self, name: str) -> DataFrame:
        found = Y.read_layer(self.spark, self.out, name, self.cfg.aoi_id, self.species, name in NEVER_SHARED)
        if found is None:
            raise MissingLayerError(f"no layer {name}: run its stage first")
        return found

    def write(self, df: DataFrame, name: str, shared: bool = False) -> None:
        Y.write_layer(df, self.out, name, self.cfg.aoi_id, None if shared else self.species)

    def on_area(self, df: DataFrame) -> DataFrame:
        return self.area.join(df, ["row", "col"], "left")

    # stages

    def terrain(self) -> None:
        t = self.cfg.species["terrain"]
        cells = self.grid.cells(self.spark).select("row", "col").join(self.elevation(), ["row", "col"], "left")
        ground = T.slope_aspect(cells, self.grid.resolution, float(self.cfg.pipeline.get("terrain", {}).get("smooth_sigma", 0)))
        self.write(ground, "ground", shared=True)
        ground = self.on_area(self.layer("ground"))
        e, s, a = t["elevation_m"], t["slope_deg"], t["aspect"]
        parts = {
            "elevation": C.trapezoid(F.col("z"), e.get("hard_min"), e["optimal_min"], e["optimal_max"], e.get("hard_max")),
            "slope": C.trapezoid(F.col("slope"), None, s["optimal_min"], s["optimal_max"], s["hard_max"]),
            "aspect": C.aspect_score(F.col("aspect"), F.col("slope"), a["optimal_bearing_deg"], a["tolerance_deg"], a["flat_slope_deg"]),
        }
        hard = self.cfg.weights.get("hard_filters", {})
        ok = F.col("z").isNotNull()
        if hard.get("enforce_elevation_hard_bounds", True):
            ok = ok & (F.col("z") >= (e.get("hard_min") or -1e9)) & (F.col("z") <= (e.get("hard_max") or 1e9))
        if hard.get("enforce_slope_hard_max", True):
            ok = ok & F.coalesce(F.col("slope") <= s["hard_max"], F.lit(False))
        scored = ground.withColumns({f"_{k}": v for k, v in parts.items()})
        blend = C.weighted_mean({k: F.col(f"_{k}") for k in parts}, self.cfg.weights["terrain_subweights"])
        self.write(scored.select("row", "col", F.when(ok, blend).alias("score")), "terrain")

    def logged(self) -> DataFrame:
        """(row, col, logged_age): years since the latest harvest."""
        blocks = self.input("blocks", False)
        if blocks is None:
            return self.spark.createDataFrame([], "row int, col int, logged_age double")
        age = F.greatest(F.lit(self.year) - F.col("harvest_year"), F.lit(0)).cast("double")
        return S.polygon_cells(blocks, self.grid).groupBy("row", "col").agg(F.min(age).alias("logged_age"))

    def indices(self) -> DataFrame:
        """Median greenness, moisture and texture of the clear scenes."""
        p = self.input("pixels")
        red, nir, swir = (C.reflectance(F.col(b), F.col("baseline")) for b in ("red", "nir", "swir"))
        p = p.withColumn("ndvi", ndvi_mask(nir, red)).withColumn("ndmi", F.when(F.col("scl").isin(4, 5, 7), C.normalised_difference(nir, swir)))
        green = T.block_stats(p, "ndvi", 3, ("scene",)).groupBy("row", "col").agg(F.median("mean").alias("ndvi"), F.median("std").alias("texture"))
        moist = T.block_stats(p, "ndmi", 3, ("scene",)).groupBy("row", "col").agg(F.median("mean").alias("ndmi"))
        return green.join(moist, ["row", "col"], "full")

    def vegetation(self, reuse: bool = False) -> None:
        v = self.cfg.species["vegetation"]
        if not reuse:
            self.write(self.indices(), "indices", shared=True)
        x, w = v["texture"] if "texture" in v else {}, float(v.get("closure_texture_weight", 0))
        closure = C.canopy_closure(F.col("ndmi"), F.col("texture"), v["ndmi"]["open_max"], v["ndmi"]["closed_min"], w, x.get("smooth_max", 0), x.get("rough_min", 1))
        cells = self.on_area(self.layer("indices")).join(self.logged(), ["row", "col"], "left").withColumn("closure", closure)
        log = v.get("logging", {})
        recovery = float(log.get("recovery_years", 45))
        fit = C.vegetation_score(F.col("ndvi"), F.col("closure"), v["ndvi"], v["openness_preference"], self.cfg.weights.get("hard_filters", {}).get("enforce_ndvi_hard_min", True))
        score = fit * C.clearcut_penalty(F.col("logged_age"), float(log.get("penalty", 1)), recovery)
        cls = C.vegetation_class(F.col("ndvi"), F.col("closure"), v["ndvi"]["hard_min"], F.col("logged_age"), recovery)
        self.write(cells.select("row", "col", score.alias("score"), cls.alias("class"), "ndvi", "closure", "logged_age"), "vegetation")

    def forest(self) -> None:
        f = self.cfg.species["forest"]
        stands = self.input("stands")
        share = F.coalesce("pct", F.lit(0.0)) / 100 * F.coalesce(L.longest_prefix(F.col("code"), f["host_affinity"], float(f.get("default_affinity", 0))), F.lit(0.0))
        host = self.input("stand_species").groupBy("stand_id").agg(F.sum(share).alias("share"), F.min_by("code", "slot").alias("lead"), F.min_by("pct", "slot").alias("lead_pct"))
        own = S.polygon_cells(stands.select("stand_id", "rings"), self.grid).groupBy("row", "col").agg(F.max("stand_id").alias("stand_id"))
        cells = self.area.join(own, ["row", "col"], "left").join(stands.drop("rings"), "stand_id", "left").join(host, "stand_id", "left").join(self.logged(), ["row", "col"], "left")
        known = F.col("stand_id").isNotNull()
        treed = F.coalesce(F.upper(F.trim("level2")) == "T", F.col("lead").isNotNull())
        cells = cells.withColumn("host", F.when(known, F.when(treed, C.clip(F.coalesce("share", F.lit(0.0)), 0, 1)).otherwise(0.0))).withColumn("stand_age", F.when(treed, F.least("age", "logged_age")))
        unknown, hf = float(f.get("missing_attribute_credit", 0.5)), f["host_fraction"]
        knots, sat, low = [tuple(k) for k in f["stand_age_credit"]["knots"]], float(hf["saturation"]), float(hf.get("hard_min", 0))
        bands = {k: f["crown_closure_pct"].get(k) for k in ("hard_min", "optimal_min", "optimal_max", "hard_max")}
        score = C.forest_score(F.col("host"), F.col("stand_age"), F.col("closure"), known, sat, low, knots, bands, unknown, self.cfg.weights.get("hard_filters", {}).get("enforce_host_min", True))
        cls = C.forest_class(F.col("host"), treed, known, F.col("stand_age"), C.age_credit(F.col("stand_age"), knots, unknown), sat, low)
        self.write(cells.select("row", "col", score.alias("score"), cls.alias("class"), "host", "stand_age", "closure", "logged_age", L.tree_label(L.tree_code(F.col("lead")), F.col("lead_pct")).alias("leading_species")), "forest")

    def moisture(self) -> None:
        m = self.cfg.species["moisture"]
        lines = self.input("streams", False)
        water = self.input("water", False)
        none = self.spark.createDataFrame([], "row int, col int, stream_order int, poly_code int")
        kinds = F.when(F.col("kind") == "lakes", 1).when(F.col("kind") == "rivers", 2).otherwise(3)
        if lines is not None:
            order = F.least(F.greatest(F.coalesce("stream_order", F.lit(1)), F.lit(1)), F.lit(254)).cast("int")
            none = none.unionByName(S.line_cells(lines, self.grid).select("row", "col", order.alias("stream_order"), F.lit(None).cast("int").alias("poly_code")))
        if water is not None:
            none = none.unionByName(S.polygon_cells(water, self.grid).select("row", "col", F.lit(None).cast("int").alias("stream_order"), kinds.alias("poly_code")))
        wet = none.groupBy("row", "col").agg(F.max("stream_order").alias("stream_order"), F.max("poly_code").alias("poly_code"))
        mask = water_mask(F.col("stream_order"), F.col("poly_code"), int(m.get("min_stream_order", 1)), tuple(m["water_features"]))
        cells = self.grid.cells(self.spark).select("row", "col").join(wet, ["row", "col"], "left").withColumn("water", mask).select("row", "col", "water")
        far = T.distance_to(cells, self.grid.resolution)
        tpi = m.get("tpi")
        ground = self.layer("ground").select("row", "col", "z")
        ground = T.topographic_position(ground, self.grid.resolution, float(tpi["radius_m"])) if tpi else ground.withColumn("tpi", F.lit(None).cast("double"))
        b, w = m.get("blend", {"water": 1.0}), m["water_distance_m"]
        credit = C.moisture_credit(F.col("distance"), F.col("distance").isNull(), F.col("tpi"), w["optimal_max"], w["zero_at"], (tpi or {}).get("wet_at_m", 0), (tpi or {}).get("dry_at_m", 1), float(b.get("water", 0)), float(b.get("tpi", 0)) if tpi else 0.0, float(m.get("min_credit", 0)), w.get("hard_max_m"))
        self.write(self.on_area(far.join(ground, ["row", "col"])).select("row", "col", credit.alias("score"), F.col("distance").alias("water_distance_m"), "tpi"), "moisture")

    def access(self) -> None:
        a = self.cfg.pipeline["access"]
        roads = self.input("roads")
        source = F.coalesce(F.col("source"), F.lit("atlas")) if "source" in roads.columns else F.lit("atlas")
        lines = N.drivable(roads.where(source != "tenure")).unionByName(N.tenure_roads(roads.where(source == "tenure")))
        if lines.isEmpty():
            raise N.NoNetworkError("there is no drivable road")
        x, y = S.to_utm(F.lit(float(a["origin"]["lon"])), F.lit(float(a["origin"]["lat"])), self.zone)
        ox, oy = self.spark.range(1).select(x, y).first()
        ends = N.endpoints(lines)
        nodes = N.junctions(ends)
        edges = N.network(lines, a.get("road_speeds_kmh", N.SPEEDS))
        at = ends.join(nodes, "point").groupBy("node").agg(F.min("x").alias("x"), F.min("y").alias("y")).join(N.largest_component(edges), "node")
        start = N.nearest_node(at, ox, oy).first()["node"]
        if start is None:
            raise N.NoNetworkError("no road joins another")
        times = N.segment_times(lines, nodes, N.shortest_times(edges, start))
        on_road = S.line_cells(lines.join(times, "segment_id"), self.grid).groupBy("row", "col").agg(F.min("minutes").alias("drive"))
        trails = self.input("trails", False)
        trail = S.line_cells(trails, self.grid).select("row", "col").distinct().withColumn("trail", F.lit(True)) if trails is not None else self.spark.createDataFrame([], "row int, col int, trail boolean")
        cells = self.layer("ground").select("row", "col", "slope").join(on_road, ["row", "col"], "left").join(trail, ["row", "col"], "left")
        cost = C.cost_per_metre(F.col("slope"), F.coalesce("trail", F.lit(False)), F.col("drive").isNotNull(), float(a.get("hike_base_speed_kmh", 5)), float(a.get("offtrail_penalty", 1)))
        walk = N.least_cost(cells.select("row", "col", cost.alias("cost"), F.col("drive").isNotNull().alias("source")), self.grid.resolution)
        root = on_road.select(F.col("row").alias("root_row"), F.col("col").alias("root_col"), F.col("drive").alias("drive_minutes"))
        walk = self.on_area(walk.join(root, ["root_row", "root_col"], "left")).withColumn("hike_km", F.col("metres") / 1000)
        hard = self.cfg.weights.get("hard_filters", {})
        score = C.access_score(F.col("drive_minutes"), F.col("hike_km"), self.cfg.weights["access_subweights"], float(a.get("max_drive_minutes", 90)), float(a.get("max_hike_km", 6)), hard.get("enforce_max_drive_minutes", False), hard.get("enforce_max_hike_km", False))
        self.write(walk.select("row", "col", score.alias("score"), "drive_minutes", F.when(F.col("minutes") <= 24 * 60, F.col("minutes")).alias("hike_minutes"), "hike_km"), "access", shared=True)

    def records(self) -> DataFrame:
        """Usable records with their weights."""
        o = self.cfg.species["observations"]
        obs = self.input("observations", False)
        if obs is None:
            obs = self.spark.createDataFrame([], "id long, taxon string, accuracy_m double, obscured boolean, x double, y double")
        obs = usable(obs, float(o.get("max_accuracy_m", o["boost_radius_m"])))
        return obs.withColumn("weight", L.record_weight(F.col("taxon"), o["taxon_name"], o.get("congeners_downweight") or [""]))

    def observations(self) -> None:
        o = self.cfg.species["observations"]
        sigma = max(float(o["boost_radius_m"]) / self.grid.resolution, 1e-6)
        seeds = self.grid.cell_of(self.records()).select("row", "col", "weight")
        spread = T.proximity(seeds, self.area, sigma)
        self.write(spread.select("row", "col", C.observation_score(F.col("spread"), sigma, float(o.get("no_observation_baseline", 0.5))).alias("score")), "observations")

    def landstatus(self) -> None:
        polys = self.input("tenure", False)
        if polys is None:
            own = self.spark.createDataFrame([], "row int, col int, class int")
        else:
            cls, order = tenure_order()
            own = S.polygon_cells(polys, self.grid).groupBy("row", "col").agg(F.max_by(cls, order).alias("class"))
        self.write(self.on_area(own).select("row", "col", F.coalesce("class", F.lit(0)).alias("class")), "landstatus", shared=True)

    def components(self) -> list[str]:
        return ["terrain", self.cfg.habitat_layer, "access", "observations", *self.cfg.optional_layers]

    def suitability(self) -> DataFrame:
        """Every cell of the area with its component scores, tenure class and score."""
        cells = self.area
        for name in self.components():
            cells = cells.join(self.layer(name).select("row", "col", F.col("score").alias(f"score_{name}")), ["row", "col"], "left")
        cells = cells.join(self.layer("landstatus"), ["row", "col"], "left")
        score = C.weighted_mean({k: F.col(f"score_{k}") for k in self.components()}, self.cfg.weights["weights"])
        need = ["terrain", self.cfg.habitat_layer, *self.cfg.optional_layers]
        out = [k for k, v in L.TENURE_CLASSES.items() if v in self.cfg.weights.get("legality", {}).get("exclude_from_ranking", [])]
        score = Z.rejected(score, *(F.col(f"score_{k}") for k in need))
        return cells.withColumn("score", F.when(~F.col("class").isin(*out), score) if out else score)

    def scoring(self) -> None:
        s = self.cfg.pipeline["sites"]
        self.write(self.suitability(), "suitability")
        cells = self.layer("suitability").where("score is not null")
        good = Z.cut(cells, s.get("selection", "percentile"), float(s.get("score_percentile", 98)), float(s.get("min_score", 0)))
        least, most, spacing = self.grid.site_limits(float(s["min_area_ha"]), float(s.get("max_area_ha", 0) or 1e12), float(s.get("separation_m", 600)))
        parts = Z.split_oversized(Z.patches(good.select("row", "col", "score")), most, spacing).withColumn("label", F.struct("label", "part"))
        best = Z.summary(parts, self.grid.cell_ha).where(F.col("cells") >= least)
        self.write(self.attributes(Z.ranked(best.drop("label"), int(s["max_sites"]))), "sites")

    def attributes(self, sites: DataFrame) -> DataFrame:
        """Ranked sites with what the map shows of their best cell. There are few, so they are what is broadcast."""

        def pick(name: str, **columns: Column) -> None:
            nonlocal sites
            sites = self.layer(name).select("row", "col", *(v.alias(k) for k, v in columns.items())).join(F.broadcast(sites), ["row", "col"], "right")

        pick("ground", elevation_m=F.bround("z", 0).cast("int"), slope_deg=F.bround("slope", 1), aspect_deg=F.bround("aspect", 0).cast("int"), aspect_compass=L.compass(F.col("aspect")))
        pick("access", drive_minutes=F.bround("drive_minutes", 1), hike_minutes=F.bround("hike_minutes", 1), hike_km=F.bround("hike_km", 2))
        pick("suitability", **{("score_habitat" if k == self.cfg.habitat_layer else f"score_{k}"): F.bround(f"score_{k}", 3) for k in self.components()}, land_class=F.col("class"))
        if self.cfg.habitat_layer == "forest":
            pick("forest", veg_class=F.element_at(L.literal_map(L.forest_classes(self.cfg.species["forest"])), F.col("class")), host_fraction=F.bround("host", 2), leading_species=F.col("leading_species"), stand_age_years=F.col("stand_age").cast("int"), crown_closure_pct=F.col("closure").cast("int"), years_since_logging=F.col("logged_age").cast("int"))
        else:
            pick("vegetation", veg_class=F.element_at(L.literal_map(L.VEGETATION_CLASSES), F.col("class")), ndvi=F.bround("ndvi", 3), canopy_closure=F.bround("closure", 3), years_since_logging=F.col("logged_age").cast("int"))
        if "moisture" in self.cfg.optional_layers:
            pick("moisture", water_distance_m=F.bround("water_distance_m", 0).cast("int"), moisture_credit=F.bround("score", 3))
        status = F.element_at(L.literal_map(L.TENURE_CLASSES), F.coalesce("land_class", F.lit(0)))
        free = self.cfg.weights.get("legality", {}).get("unflagged_default", "crown_land")
        x, y = self.grid.x(F.col("col")), self.grid.y(F.col("row"))
        lon, lat = S.from_utm(x, y, self.zone)
        sites = sites.withColumn("land_status", status).withColumn("land_status_label", F.element_at(L.literal_map(L.TENURE_LABELS), F.col("land_status"))).withColumn("land_flagged", F.col("land_status") != free).withColumn("on_cutblock", F.col("years_since_logging").isNotNull()).withColumn("sx", x).withColumn("sy", y).withColumn("lon", F.bround(lon, 6)).withColumn("lat", F.bround(lat, 6))
        radius = float(self.cfg.species["observations"]["boost_radius_m"])
        near = S.within(self.records().select("x", "y", "weight"), sites.select("rank", "sx", "sy"), radius, ("x", "y"), ("sx", "sy")).groupBy("rank").agg(F.count(F.lit(1)).alias("inat_nearby"), F.count_if(F.col("weight") >= 1).alias("inat_nearby_exact"))
        sites = sites.join(near, "rank", "left").fillna(0, ["inat_nearby", "inat_nearby_exact"])
        return sites.drop("sx", "sy", "land_class", "cells")

    def overlays(self) -> list[tuple]:
        """Pictures of the map: key, label, layer, column, kind, and of measures the ramp and bounds (None: 2nd and 98th percentile)."""
        f = self.cfg.species.get("forest") or {}
        host = f.get("host_label") or "host-tree"
        out = [
            ("suitability", "Suitability score", "suitability", "score", "continuous", "suitability", 0.0, 1.0),
            ("elevation", "Elevation", "ground", "z", "continuous", "elevation", None, None),
            ("slope", "Slope", "ground", "slope", "continuous", "slope", None, None),
            ("ndvi", "NDVI", "indices", "ndvi", "continuous", "ndvi", 0.0, 1.0),
            ("aspect", "Aspect", "ground", "aspect", "cyclic", "aspect", 0.0, 360.0),
        ]
        if self.cfg.habitat_layer == "forest":
            out += [
                ("forest", "Forest / host trees", "forest", "class", "categorical", L.FOREST_COLOURS, L.forest_classes(f)),
                ("host_fraction", f"{host[:1].upper()}{host[1:]} share", "forest", "host", "continuous", "host", 0.0, 1.0),
                ("stand_age", "Stand age (years)", "forest", "stand_age", "continuous", "ndvi", 0.0, 200.0),
            ]
        else:
            out.append(("vegetation", "Vegetation class", "vegetation", "class", "categorical", L.VEGETATION_COLOURS, L.VEGETATION_CLASSES))
        if "moisture" in self.cfg.optional_layers:
            out.append(("moisture", "Moisture credit", "moisture", "score", "continuous", "water", 0.0, 1.0))
        out.append(("logging_age", "Years since logging", self.cfg.habitat_layer, "logged_age", "continuous", "ndvi", 0.0, 60.0))
        out.append(("land_tenure", "Land tenure", "landstatus", "class", "categorical", L.TENURE_COLOURS, None))
        return out

    @cached_property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east and north of the area in degrees."""
        p = [q for poly in self.cfg.rings() for q in poly[0]]
        return min(q[0] for q in p), min(q[1] for q in p), max(q[0] for q in p), max(q[1] for q in p)

    @cached_property
    def picture(self) -> tuple[DataFrame, int, int]:
        """Pixels of the map's pictures with the place of their centres in the grid, and their numbers of rows and columns: equal
        steps of degrees, as many rows as the grid has."""
        west, south, east, north = self.bounds
        rows = self.grid.rows
        cols = max(round(rows * (east - west) / max(north - south, 1e-9)), 1)
        pixels = S.Grid(0.0, 0.0, 1.0, rows, cols).cells(self.spark)
        lon, lat = F.lit(west) + F.col("x") / cols * (east - west), F.lit(north) + F.col("y") / rows * (north - south)
        x, y = S.to_utm(lon, lat, self.zone)
        u, v = (x - self.grid.left) / self.grid.resolution - 0.5, (F.lit(self.grid.top) - y) / self.grid.resolution - 0.5
        return materialise(pixels.select("row", "col", u.alias("u"), v.alias("v")), "picture"), rows, cols

    def draw(self, web: str) -> dict[str, dict]:
        """Writes the overlays of the layers that are there and hold values; returns what the manifest says of them."""
        pixels, rows, cols = self.picture
        drawn: dict[str, dict] = {}
        for key, label, name, column, kind, colours, *more in self.overlays():
            try:
                cells = self.layer(name).select("row", "col", F.col(column).alias("value"))
            except MissingLayerError:
                continue
            warped = materialise(T.warp(cells, pixels, "value", "nearest" if kind == "categorical" else "bilinear"), "overlay")
            entry = {"label": label, "file": f"{key}.png", "type": kind}
            if kind == "categorical":
                shown = K.categorical(warped, "value", colours)
                entry |= {"legend": Y.legend(colours, more[0])} if more[0] else {"legend_key": key}
            else:
                if kind == "continuous" and warped.where("value is not null").isEmpty():
                    release(warped)
                    continue
                low, high = (exact_percentile(warped, "value", p) if b is None else b for p, b in zip((0.02, 0.98), more))
                shown = K.stretch(warped, "value", low, high)
                shown = shown.select("row", "col", *K.ramp(L.RAMPS[colours], F.col("idx")), "alpha")
                if kind == "continuous":
                    entry |= {"min": low, "max": high}
            save(self.spark, f"{web}/{key}.png", K.image(shown, rows, cols))
            release(warped)
            drawn[key] = entry
        return drawn

    def lonlat(self, points: Column) -> Column:
        return F.transform(points, lambda p: F.array(*(F.bround(c, 6) for c in S.from_utm(p["x"], p["y"], self.zone))))

    def vectors(self, web: str) -> None:
        """roads.geojson, trails.geojson and protected_areas.geojson: what meets the area, simplified. A line is a column ``pts`` of
        points, or a segment from x0, y0 to x1, y1."""
        for name, tolerance, keep in (("roads", 40.0, ("name", "class", "surface")), ("trails", 25.0, ("name", "highway"))):
            df = self.input(name, False)
            if df is None:
                continue
            pts = F.col("pts") if "pts" in df.columns else F.array(point(F.col("x0"), F.col("y0")), point(F.col("x1"), F.col("y1")))
            lines = materialise(df.select(F.monotonically_increasing_id().alias("_k"), *(c for c in keep if c in df.columns), pts.alias("pts")), name)
            near = S.line_cells(S.segments(lines.select("_k", F.array("pts").alias("pts")), "pts"), self.grid).join(self.area, ["row", "col"], "left_semi").select("_k").distinct()
            shown = K.simplified(lines.join(near, "_k", "left_semi"), tolerance).orderBy("_k")
            features = shown.select(K.shape("LineString", self.lonlat(F.col("pts")), [F.col(c) for c in shown.columns if c in keep]).alias("f"))
            self.features(features, f"{web}/{name}.geojson")
        df = self.input("tenure", False)
        if df is not None:
            keep = [c for c in ("name", "designation") if c in df.columns]
            parks = materialise(df.where("layer = 'park'").select(F.monotonically_increasing_id().alias("_k"), *keep, "rings"), "parks")
            closed = F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1)))
            edges = S.line_cells(S.segments(parks.select("_k", closed.alias("rings")), "rings"), self.grid)
            cells = S.polygon_cells(parks.select("_k", "rings"), self.grid).select("_k", "row", "col").union(edges.select("_k", "row", "col"))
            near = cells.join(self.area, ["row", "col"], "left_semi").select("_k").distinct()
            ring = K.simplified(parks.join(near, "_k", "left_semi").select("_k", *keep, F.posexplode(closed).alias("_i", "pts")), 30.0).where("size(pts) >= 4")
            rings = ring.groupBy("_k", *keep).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", self.lonlat(F.col("pts")).alias("p")))), lambda x: x["p"]).alias("rings"), F.min("_i").alias("first"))
            shown = rings.where("first = 0").orderBy("_k")
            self.features(shown.select(K.shape("Polygon", F.col("rings"), [F.col(c) for c in keep]).alias("f")), f"{web}/protected_areas.geojson")

    def features(self, df: DataFrame, path: str) -> None:
        """A file of the features, if there is any."""
        if not df.isEmpty():
            K.write_geojson(df, "f", path)

    def export(self) -> None:
        """Everything the map shows, under <out>/web/<area>/<species>: sites (GeoJSON, GPX, CSV), records, overlays with legends,
        vector layers, the outline and the manifest; and the index of all builds."""
        web = f"{self.out}/web/{self.cfg.aoi_id}/{self.species}"
        sites = self.layer("sites")
        rows = sites.orderBy("rank").select(K.feature(F.col("lon"), F.col("lat"), [F.col(c) for c in sites.columns if c not in ("lon", "lat")]).alias("f"))
        K.write_geojson(rows, "f", f"{web}/sites.geojson")
        save(self.spark, f"{web}/sites.gpx", K.gpx(sites, f"{self.cfg.aoi_id} - {self.species}", F.coalesce("land_status_label", F.lit(""))))
        columns = [c for c in ("rank", "score", "lat", "lon", "elevation_m", "aspect_compass", "slope_deg", "veg_class", "leading_species", "host_fraction", "stand_age_years", "water_distance_m", "years_since_logging", "area_ha", "drive_minutes", "hike_km", "hike_minutes", "land_status_label", "inat_nearby") if c in sites.columns]
        lines = [r[0] for r in sites.orderBy("rank").select(K.csv_line(columns)).collect()]
        save(self.spark, f"{web}/sites.csv", "\n".join([",".join(columns), *lines]) + "\n")
        records = self.grid.cell_of(self.records()).join(self.area, ["row", "col"], "left_semi")
        lon, lat = S.from_utm(F.col("x"), F.col("y"), self.zone)
        shown = [F.col(c) for c in ("id", "taxon", "observed_on", "accuracy_m", "obscured", "url", "weight") if c in records.columns]
        K.write_geojson(records.orderBy("id").select(K.feature(lon, lat, shown).alias("f")), "f", f"{web}/observations.geojson")
        self.vectors(web)
        save(self.spark, f"{web}/aoi.geojson", json.dumps(self.cfg.aoi))
        west, south, east, north = self.bounds
        manifest = Y.manifest(self.cfg, sites) | {"raster_layers": self.draw(web), "image_bounds": [[south, west], [north, east]]}
        if self.cfg.species.get("folk_magic"):
            lore = profile_lore(self.spark, self.cfg.species).select(F.to_json(lore_manifest()).alias("j")).first()["j"]
            manifest["species"]["folk_magic"] = json.loads(lore)
        save(self.spark, f"{web}/manifest.json", json.dumps(manifest, indent=2))
        Y.write_index(self.spark, f"{self.out}/web")

    def run(self, stages: list[str] | None = None, reuse_imagery: bool = False) -> list[str]:
        """The stages, or all, that the profile needs; returns those that ran."""
        todo = [s for s in STAGES if s in (stages or STAGES) and s in self.cfg.stages]
        for s in todo:
            self.vegetation(reuse_imagery) if s == "vegetation" else getattr(self, s)()
        return todo
