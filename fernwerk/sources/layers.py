"""Layer tables by area and species, the map's documents, and copies for the web folder."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernwerk.functions.labels import TENURE_LABELS, habitat_label
from fernwerk.sources.files import load, matching, save
from fernwerk.sources.profiles import Config
from fernwerk.sources.sinks import counts_and_ranges


def write_layer(cells: DataFrame, root: str, name: str, aoi: str, species: str | None = None) -> str:
    """A layer keyed by row and column, under its area, or under its area and species."""
    path = f"{root.rstrip('/')}/{name}/aoi={aoi}" + (f"/species={species}" if species else "/shared")
    cells.write.mode("overwrite").parquet(path)
    return path


def read_layer(spark: SparkSession, root: str, name: str, aoi: str, species: str | None = None, never_shared: bool = False) -> DataFrame | None:
    """The species' own layer, or the area's shared one; None if there is neither."""
    places = [f"species={species}"] if species else []
    if not never_shared:
        places.append("shared")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for place in places:
        path = f"{root.rstrip('/')}/{name}/aoi={aoi}/{place}"
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return spark.read.parquet(path)
    return None


def manifest(cfg: Config, sites: DataFrame) -> dict:
    """What the map needs of one area and species; without sites it has zero counts."""
    c = counts_and_ranges(sites).first().asDict()
    access = cfg.pipeline.get("access", {})
    return {
        "aoi": {"id": cfg.aoi_id},
        "species": {k: cfg.species.get(k) for k in ("id", "common_name", "scientific_name")} | {"habitat_model": cfg.habitat_model, "habitat_label": habitat_label(cfg.species, cfg.habitat_layer), "optional_layers": cfg.optional_layers},
        "origin": access.get("origin"),
        "weights": cfg.weights["weights"],
        "filters": {k: access.get(k) for k in ("max_drive_minutes", "max_hike_km")},
        "counts": {"sites": c["sites"], "flagged": c["flagged"]},
        "ranges": {k: [c[f"{p}_min"], c[f"{p}_max"]] for k, p in (("score", "score"), ("elevation_m", "elevation"), ("drive_minutes", "drive"), ("hike_km", "hike"))},
        "land_status_labels": TENURE_LABELS,
    }


def legend(colours: dict[int, tuple[int, int, int]], names: dict[int, str]) -> list[list[str]]:
    """Pairs of colour and label, of the codes that have both."""
    return [["#%02x%02x%02x" % rgb, names[c]] for c, rgb in colours.items() if c in names]


def write_index(spark: SparkSession, root: str | Path) -> list[dict]:
    """All builds <area>/<species>/manifest.json under root, by name, with their counts; older layouts are left out."""
    found = []
    for p in matching(spark, f"{root}/*/*/manifest.json"):
        aoi, species = p.split("/")[-3:-1]
        m = json.loads(load(spark, p))
        names = m.get("species", {})
        found.append({"id": f"{aoi}/{species}", "label": m.get("aoi", {}).get("label", aoi), "species": names.get("scientific_name"), "common_name": names.get("common_name"), "sites": m["counts"]["sites"]})
    save(spark, f"{root}/index.json", json.dumps({"areas": found}, indent=2))
    return found


def publish(outputs: list[str | Path], web: str | Path) -> list[str]:
    """Copies of the outputs that exist in the web folder."""
    Path(web).mkdir(parents=True, exist_ok=True)
    return [shutil.copy(p, web) for p in outputs if Path(p).exists()]


def points(sites: DataFrame) -> DataFrame:
    """Sites with longitude and latitude to six places."""
    return sites.withColumn("lon", F.bround("lon", 6)).withColumn("lat", F.bround("lat", 6))
