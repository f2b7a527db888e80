"""Surfaces from point clouds: footprint, surface and terrain models, canopy heights, colour and intensity grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions.graph import filled_holes
from aerolith.functions.grid import binned, cells, centre, dense, densified
from aerolith.functions.knn import idw, nearest, nearest_cells
from aerolith.functions.stencil import dilated_square, gaussian_weights, smooth
from aerolith.plans.storage import settle
from aerolith.schema import GridSpec, need, same_grid


def footprint(points: DataFrame, spec: GridSpec, buffer: float = 3.0, step: int = 2, found: DataFrame | None = None) -> DataFrame:
    """The cells flown over: presence on a coarser grid, widened by the buffer, holes filled.

    found: the cells that hold points, where they are known, so that the cloud is not read again.
    """
    height, width = spec.height // step + 1, spec.width // step + 1
    seen = (binned(points, spec) if found is None else found).select(F.expr(f"row div {step}L").alias("row"), F.expr(f"col div {step}L").alias("col")).distinct()
    coarse = GridSpec(spec.min_x, spec.max_y, spec.res_x * step, spec.res_y * step, width, height, spec.epsg)
    mask = densified(seen.withColumn("inside", F.lit(True)), coarse).withColumn("inside", F.coalesce("inside", F.lit(False)))
    mask = dilated_square(mask, "inside", max(1, math.ceil(buffer / (spec.res_x * step))))
    mask = filled_holes(settle(mask), "inside").where("inside").select(F.col("row").alias("_r"), F.col("col").alias("_c"))
    fine = dense(points.sparkSession, spec).withColumn("_r", F.expr(f"row div {step}L")).withColumn("_c", F.expr(f"col div {step}L"))
    return fine.join(mask, ["_r", "_c"], "left_semi").select("row", "col")


def highest(points: DataFrame, spec: GridSpec) -> DataFrame:
    return cells(points, spec, F.max("z").alias("z"))


def nearest_filled(raster: DataFrame, value: str = "z", out: str = "z", only: DataFrame | None = None) -> DataFrame:
    """A dense raster whose null cells take the number of the nearest cell that has one (ties: least row, then col).

    only: rows and columns of the cells to fill; others stay null.
    """
    raster = settle(raster if only is None else raster.join(only.select("row", "col", F.lit(True).alias("_only")), ["row", "col"], "left"))
    wanted = F.lit(True) if only is None else F.coalesce("_only", F.lit(False))
    fill = nearest_cells(raster, value, wanted).withColumnRenamed(value, "_fill")
    return raster.join(fill, ["row", "col"], "left").withColumn(out, F.coalesce(value, F.col("_fill").cast(raster.schema[value].dataType))).drop("_fill", "_only")


def surface_model(points: DataFrame, spec: GridSpec, buffer: float = 3.0, step: int = 2, sigma: float = 1.0) -> DataFrame:
    """Highest return in each cell; gaps in the footprint from the smoothed nearest-filled surface; null outside."""
    weights = gaussian_weights(sigma)
    top = settle(highest(points, spec))
    inside = settle(footprint(points, spec, buffer, step, top).withColumn("_in", F.lit(True)))
    raw = densified(top, spec).withColumnRenamed("z", "raw").join(inside, ["row", "col"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    # what the smoothing of a gap sees: the footprint and a rim as wide as the filter
    rim = settle(dilated_square(raw.withColumn("_rim", F.col("_in")), "_rim", len(weights) // 2))
    full = nearest_filled(rim, "raw", "_smooth", rim.where("_rim").select("row", "col")).withColumn("_smooth", F.coalesce("_smooth", F.lit(0.0)))
    full = smooth(full, "_smooth", weights, spec.height, spec.width)
    return full.select("row", "col", F.when(F.col("_in"), F.coalesce("raw", "_smooth")).alias("z"))


def ground_points(points: DataFrame, ground: int = 2) -> DataFrame:
    """Points of the ground class; all of them if it has none."""
    need(points, "classification")
    some = points.where(F.col("classification") == ground)
    return points if some.limit(1).isEmpty() else some


def ground_nodes(points: DataFrame, spec: GridSpec, ground: int = 2) -> DataFrame:
    """The first ground point (least pid) of each cell."""
    first = cells(ground_points(points, ground), spec, F.min_by(F.struct("x", "y", "z", "pid"), "pid").alias("p"))
    return first.select("row", "col", "p.pid", "p.x", "p.y", "p.z")


def terrain_model(points: DataFrame, spec: GridSpec, k: int = 8, ground: int = 2, buffer: float = 3.0, step: int = 2, inside: DataFrame | None = None) -> DataFrame:
    """Inverse-distance mean of the k nearest ground nodes at each centre of the footprint."""
    need(points, "classification")
    place, is_ground = F.struct("x", "y", "z", "pid"), F.col("classification") == ground
    found = settle(cells(points, spec, F.min_by(place, "pid").alias("any"), F.min_by(F.when(is_ground, place), F.when(is_ground, F.col("pid"))).alias("ground")))
    some = "any" if found.where("ground IS NOT NULL").isEmpty() else "ground"
    nodes = found.where(F.col(some).isNotNull()).select("row", "col", f"{some}.pid", f"{some}.x", f"{some}.y", f"{some}.z")
    inside = footprint(points, spec, buffer, step, found) if inside is None else inside
    x, y = centre(spec)
    asked = inside.select("row", "col", x.alias("qx"), y.alias("qy"))
    near = nearest(asked, nodes, ["row", "col"], k, spec.res_x, F.col("z"), ["pid"])
    return near.select("row", "col", idw(F.col("near")).alias("z"))


def canopy_height(surface: DataFrame, terrain: DataFrame, low: float = 0.0, high: float = 120.0, grids: tuple[GridSpec, GridSpec] | None = None) -> DataFrame:
    """Surface less terrain, clamped; null where either is."""
    if grids:
        same_grid(*grids)
    diff = F.col("_a") - F.col("_b")
    both = surface.select("row", "col", F.col("z").alias("_a")).join(terrain.select("row", "col", F.col("z").alias("_b")), ["row", "col"])
    return both.select("row", "col", F.when(diff.isNotNull(), F.least(F.greatest(diff, F.lit(low)), F.lit(high))).alias("z"))


def colour_scale(points: DataFrame) -> float:
    """256 for 16-bit colours (any value above 255), else 1; once for the whole cloud."""
    need(points, "red", "green", "blue")
    top = points.agg(F.max(F.greatest("red", "green", "blue"))).first()[0]
    return 256.0 if top is not None and top > 255 else 1.0


def colour_means(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Mean colour of each cell that has points, as whole numbers of 0..255."""
    scale = colour_scale(points)
    mean = lambda c: F.least(F.greatest(F.floor(F.avg(F.col(c) / scale)), F.lit(0)), F.lit(255)).cast("int")
    return cells(points, spec, mean("red").alias("r"), mean("green").alias("g"), mean("blue").alias("b"))


def colour_grid(points: DataFrame, spec: GridSpec, buffer: float = 3.0, step: int = 2) -> DataFrame:
    """Colour means in the footprint; 0 elsewhere and where a cell of it has no points."""
    found = settle(colour_means(points, spec))
    inside = footprint(points, spec, buffer, step, found).withColumn("_in", F.lit(True))
    full = densified(found, spec).join(inside, ["row", "col"], "left")
    return full.select("row", "col", *[F.when(F.col("_in"), F.coalesce(F.col(c), F.lit(0))).otherwise(0).alias(c) for c in "rgb"])


def intensity_means(points: DataFrame, spec: GridSpec) -> DataFrame:
    return cells(need(points, "intensity"), spec, F.avg("intensity").alias("z"))


def intensity_grid(points: DataFrame, spec: GridSpec, buffer: float = 3.0, step: int = 2) -> DataFrame:
    """Mean intensity; 0 in cells of the footprint without points, null outside."""
    found = settle(intensity_means(points, spec))
    inside = footprint(points, spec, buffer, step, found)
    return inside.join(found, ["row", "col"], "left").select("row", "col", F.coalesce("z", F.lit(0.0)).alias("z"))
