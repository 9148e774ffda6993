"""Occurrence records as a stream: seeds of each cell, by windows of time. An extension; batch and stream share the record rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fernwerk.functions.labels import record_weight
from fernwerk.operators.spatial import Grid


def seeds(records: DataFrame, grid: Grid, target: str, congeners: list[str], window: str = "7 days", late: str = "2 days") -> DataFrame:
    """(window, row, col, weight, records) of records (ts, taxon, x, y, accuracy_m, obscured); later ones than ``late`` are dropped on a stream."""
    usable = records.where(~F.coalesce("obscured", F.lit(False))).withColumn("weight", record_weight(F.col("taxon"), target, congeners))
    cells = grid.cell_of(usable.withWatermark("ts", late))
    return cells.groupBy(F.window("ts", window), "row", "col").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("records"))
