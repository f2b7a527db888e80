"""Binning of points and dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.schema import GridSpec, PointCloudError


def grid_of(points: DataFrame, res: float, epsg: int | None = 32632) -> GridSpec:
    """The grid over a cloud's bounds (one aggregate over x and y)."""
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        raise PointCloudError("the cloud has no points")
    return GridSpec.over(*r, res, epsg)


def cell_of(spec: GridSpec, x: Column | str = "x", y: Column | str = "y") -> tuple[Column, Column]:
    """Row and column of a place, clipped to the grid."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))

    def clip(v: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor(v).cast("long"), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))

    return clip((F.lit(spec.max_y) - y) / spec.res_y, spec.height), clip((x - F.lit(spec.min_x)) / spec.res_x, spec.width)


def binned(points: DataFrame, spec: GridSpec) -> DataFrame:
    row, col = cell_of(spec)
    return points.withColumn("row", row).withColumn("col", col)


def cells(points: DataFrame, spec: GridSpec, *aggregates: Column) -> DataFrame:
    """Aggregates of the points in each cell that has some; partial sums before the shuffle."""
    return binned(points, spec).groupBy("row", "col").agg(*aggregates)


def dense(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """All (row, col) of a grid, from one distributed range."""
    n = spec.width * spec.height
    return spark.range(n).select(F.expr(f"id div {spec.width}L").alias("row"), (F.col("id") % spec.width).alias("col"))


def densified(raster: DataFrame, spec: GridSpec) -> DataFrame:
    """The raster with a row for every cell; absent ones are null."""
    return dense(raster.sparkSession, spec).join(raster, ["row", "col"], "left")


def centre(spec: GridSpec) -> tuple[Column, Column]:
    """x and y of a cell's centre."""
    return F.lit(spec.min_x) + (F.col("col") + 0.5) * spec.res_x, F.lit(spec.max_y) - (F.col("row") + 0.5) * spec.res_y


def every(raster: DataFrame, step: int) -> DataFrame:
    """Each step-th cell both ways, renumbered."""
    if step == 1:
        return raster
    return raster.where((F.col("row") % step == 0) & (F.col("col") % step == 0)).withColumn("row", F.expr(f"row div {step}L")).withColumn("col", F.expr(f"col div {step}L"))
