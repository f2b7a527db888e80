"""The engine's own raster format: Parquet by tile, with its grid as JSON beside it."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.schema import DataError, GridSpec, PointCloudError, RasterError, need

TILE = 512


def write_raster(raster: DataFrame, spec: GridSpec, path: str, tile: int = TILE) -> str:
    """Cells clustered by tile, so that file statistics on row and col prune a window's reads."""
    rows = raster.withColumn("tile_row", F.expr(f"row div {tile}L")).withColumn("tile_col", F.expr(f"col div {tile}L"))
    rows.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").drop("tile_row", "tile_col").write.mode("overwrite").parquet(f"{path}/cells")
    spark = raster.sparkSession
    spark.createDataFrame([(json.dumps(spec.as_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/grid")
    return path


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, GridSpec]:
    """Cells and grid; window (first row, first col, rows, cols) is pushed to the scan."""
    spec = GridSpec(**json.loads(spark.read.text(f"{path}/grid").first()["value"]))
    df = spark.read.parquet(f"{path}/cells")
    if window:
        r, c, h, w = window
        df = df.where((F.col("row") >= r) & (F.col("row") < r + h) & (F.col("col") >= c) & (F.col("col") < c + w))
    return df, spec


def verify_cloud(points: DataFrame) -> DataFrame:
    """The cloud, if it has coordinates and points."""
    need(points, "x", "y", "z")
    if points.isEmpty():
        raise PointCloudError("the cloud has no points")
    return points


def verify_raster(raster: DataFrame) -> DataFrame:
    need(raster, "row", "col")
    if raster.isEmpty():
        raise RasterError("the raster has no cells")
    return raster


def verify_file(path: str, *kinds: str) -> str:
    if not os.path.isfile(path):
        raise DataError(f"no file {path}")
    if kinds and path.rpartition(".")[2].lower() not in kinds:
        raise DataError(f"{path} is none of {', '.join(kinds)}")
    return path


def size_text(n: float) -> str:
    """Bytes in the largest unit that leaves at least one."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TB"


def extent_text(spec: GridSpec) -> str:
    left, bottom, right, top = spec.bounds
    return f"{right - left:.2f} x {top - bottom:.2f}, x {left:.2f} to {right:.2f}, y {bottom:.2f} to {top:.2f}"
