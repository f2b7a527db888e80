"""Transects, residual histograms, zonal statistics, before-and-after grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.grid import cell_of, every
from aerolith.schema import ConfigurationError, EmptyRasterError, GridSpec


def positions(raster: DataFrame, axis: str, count: int, margin: int = 50) -> list[int]:
    """count rows or columns, evenly from margin cells inside the first valid one to as many before the last."""
    lo, hi = raster.where("z IS NOT NULL").agg(F.min(axis), F.max(axis)).first()
    if lo is None:
        raise EmptyRasterError("no valid cell to lay a transect through")
    a, b = lo + margin, hi - margin
    return [int(a + (b - a) * i / (count - 1)) if count > 1 else int(a) for i in range(count)]


def transects(raster: DataFrame, spec: GridSpec, direction: str = "vertical", indices: list[int] | None = None, count: int = 3) -> DataFrame:
    """transect, seq, distance, z along columns (south to north, gaps closed) or rows (west to east, gaps kept)."""
    if direction not in ("vertical", "horizontal"):
        raise ConfigurationError(f"transects are vertical or horizontal, not {direction}")
    axis, along = ("col", "row") if direction == "vertical" else ("row", "col")
    indices = positions(raster, axis, count) if indices is None else indices
    df = raster.where(F.col(axis).isin(indices) & F.col("z").isNotNull())
    order = Window.partitionBy(axis).orderBy(F.desc(along) if direction == "vertical" else F.asc(along))
    seq = F.row_number().over(order) - 1
    if direction == "vertical":
        distance = seq * spec.res_y
    else:
        distance = (F.col("col") - F.min("col").over(Window.partitionBy(axis))) * spec.res_x
    return df.select(F.col(axis).alias("transect"), seq.cast("long").alias("seq"), distance.cast("double").alias("distance"), "z")


def transect_lists(rows: DataFrame) -> DataFrame:
    """One row a transect with its distances and heights as arrays."""
    both = F.sort_array(F.collect_list(F.struct("seq", "distance", "z")))
    return rows.groupBy("transect").agg(both.alias("_p")).select("transect", F.col("_p.distance").alias("distance"), F.col("_p.z").alias("z"))


def line_transect(raster: DataFrame, spec: GridSpec, start: tuple[float, float], end: tuple[float, float], samples: int = 100) -> DataFrame:
    """Heights at evenly spaced places on a line; null beyond the grid and over voids."""
    t = F.col("id") / float(max(1, samples - 1))
    row, col = cell_of(spec, F.lit(start[0]) + t * (end[0] - start[0]), F.lit(start[1]) + t * (end[1] - start[1]))
    left, bottom, right, top = spec.bounds
    x, y = F.lit(start[0]) + t * (end[0] - start[0]), F.lit(start[1]) + t * (end[1] - start[1])
    at = raster.sparkSession.range(samples).select(F.col("id").alias("seq"), (t * math.hypot(end[0] - start[0], end[1] - start[1])).alias("distance"), x.alias("x"), y.alias("y"), row.alias("row"), col.alias("col"), (x.between(left, right) & y.between(bottom, top)).alias("_in"))
    out = at.join(raster.select("row", "col", "z"), ["row", "col"], "left")
    return out.select("seq", "distance", "x", "y", F.when(F.col("_in"), F.col("z")).alias("z"))


def histogram(values: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """bin, low, high, n, density and cumulative share of equal bins between the extremes."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(column).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0).cast("int")
    rows = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"))
    share = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.col("_n")  # at most `bins` rows
    return rows.select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n", F.when(width > 0, F.col("n") / (F.col("_n") * F.when(width > 0, width))).otherwise(0.0).alias("density"), share.alias("cumulative"))


def zonal(raster: DataFrame, spec: GridSpec, chips: DataFrame, step: int = 1) -> DataFrame:
    """For each chip (id, x_min, y_min, x_max, y_max): centre, cells and heights of the cells whose centres lie in it.

    A chip becomes the range of its rows and columns, and an equi-join on (row, col) meets the
    cells, so no pair of chip and cell is made that does not match.
    """
    coarse = spec.coarser(step)
    lo = lambda v, origin, res: F.greatest(F.lit(0), F.ceil((v - origin) / res - 0.5)).cast("long")
    hi = lambda v, origin, res, n: F.least(F.lit(n - 1), F.ceil((v - origin) / res - 0.5) - 1).cast("long")
    c0, c1 = lo(F.col("x_min"), coarse.min_x, coarse.res_x), hi(F.col("x_max"), coarse.min_x, coarse.res_x, coarse.width)
    r0, r1 = lo(-F.col("y_max"), -coarse.max_y, coarse.res_y), hi(-F.col("y_min"), -coarse.max_y, coarse.res_y, coarse.height)
    parts = chips.select("id", ((F.col("x_min") + F.col("x_max")) / 2).alias("cx"), ((F.col("y_min") + F.col("y_max")) / 2).alias("cy"), c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1")).where("c0 <= c1 AND r0 <= r1")
    rows = parts.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("r0", "r1", "c0", "c1")
    met = rows.join(every(raster, step).select("row", "col", "z"), ["row", "col"])
    return met.groupBy("id", "cx", "cy").agg(F.count("z").alias("cells"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"))


def before_after(before: DataFrame, after: DataFrame, step: int = 4) -> DataFrame:
    """Decimated heights of both epochs and after less before."""
    b, a = every(before, step), every(after, step)
    both = b.select("row", "col", F.col("z").alias("before")).join(a.select("row", "col", F.col("z").alias("after")), ["row", "col"])
    return both.withColumn("change", F.col("after") - F.col("before"))
