"""Surfaces kept up to date while strips arrive: the stateful form of the grid aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aerolith.functions.grid import binned
from aerolith.schema import POINT, GridSpec


def arriving(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """Points of Parquet files as they land in a folder."""
    return spark.readStream.schema(POINT).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def live_cells(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Greatest height and number of points of each cell so far (state: one row a cell)."""
    return binned(points, spec).groupBy("row", "col").agg(F.max("z").alias("z"), F.count("*").alias("n"))


def keep_surface(points: DataFrame, spec: GridSpec, name: str, checkpoint: str) -> StreamingQuery:
    """An in-memory table of the whole surface on the driver, for small areas and tests; `write_changes` is the way beyond."""
    return live_cells(points, spec).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def write_changes(points: DataFrame, spec: GridSpec, folder: str, checkpoint: str) -> StreamingQuery:
    """Changed cells of each batch as Parquet by batch; a repeated batch overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return live_cells(points, spec).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).start()
