"""Point-cloud operators: profile, density, cleaning, strip alignment and merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.grid import binned, cells, densified
from aerolith.functions.quantiles import percentiles
from aerolith.plans.storage import settle
from aerolith.schema import CLASS_NAMES, ConfigurationError, GridSpec, NoOverlapError, need

QUANTILES = (1, 5, 25, 50, 75, 95, 99)


def class_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in CLASS_NAMES.items() for x in (k, v)])
    return F.coalesce(names[code], F.concat(F.lit("Class "), code.cast("string")))


def profile(points: DataFrame, sample_limit: int | None = None) -> DataFrame:
    """One row: count, bounds, area, density and height percentiles (of the first sample_limit points by pid, if given)."""
    need(points, "x", "y", "z")
    base = points.agg(
        F.count("*").alias("total_points"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y", "z") for f in (F.min, F.max)],
        F.avg("z").alias("mean_z"),
    )
    sample = points if sample_limit is None else points.orderBy("pid").limit(sample_limit)
    q = percentiles(sample, "z", [p / 100 for p in QUANTILES]) or [None] * len(QUANTILES)
    area = F.greatest(F.lit(1.0), (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    out = base.withColumn("area", area).withColumn("density", F.col("total_points") / F.col("area"))
    return out.select("*", *[F.round(F.lit(v).cast("double"), 2).alias(f"z_p{p}") for p, v in zip(QUANTILES, q, strict=True)])


def class_counts(points: DataFrame) -> DataFrame:
    counts = need(points, "classification").groupBy("classification").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2)  # one row a class: at most 256
    return counts.select("classification", class_name(F.col("classification")).alias("label"), "n", share.alias("pct"))


def return_counts(points: DataFrame) -> DataFrame:
    return need(points, "return_number").groupBy("return_number").agg(F.count("*").alias("n"))


def density(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Points per square unit, 0 in empty cells."""
    found = cells(points, spec, F.count("*").alias("n"))
    return densified(found, spec).select("row", "col", (F.coalesce("n", F.lit(0)) / spec.cell_area).alias("density"))


def between_heights(points: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        points = points.where(F.col("z") >= low)
    return points if high is None else points.where(F.col("z") <= high)


def clean(points: DataFrame, low: float | None = None, high: float | None = None, shift: float = 0.0, scale: float = 0.001, remove: bool = True) -> DataFrame:
    """Points without height outliers, shifted by whole steps of scale.

    Without both limits they are the 1st and 99th percentile, widened by 2.5 times their distance.
    """
    out = points
    if remove:
        if low is None or high is None:
            p1, p99 = percentiles(points, "z", [0.01, 0.99]) or (0.0, 0.0)
            low, high = p1 - 2.5 * (p99 - p1), p99 + 2.5 * (p99 - p1)
        out = between_heights(out, low, high)
    if abs(shift) > 1e-4:
        out = out.withColumn("z", F.col("z") + F.lit(round(shift / scale) * scale))
    return out


def bounds(points: DataFrame) -> tuple | None:
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if r[0] is None else tuple(r)


def intersection(a: tuple, b: tuple) -> tuple | None:
    """Common part of two (left, bottom, right, top), None if they do not overlap."""
    left, bottom, right, top = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return None if left >= right or bottom >= top else (left, bottom, right, top)


def strip_differences(first: DataFrame, second: DataFrame, res: float = 0.5, raise_if_apart: bool = False) -> DataFrame:
    """row, col, diff: least height in the first strip less that in the second, in cells of their overlap."""
    a, b = bounds(first), bounds(second)
    box = intersection(a, b) if a and b else None
    if box is None:
        if raise_if_apart:
            raise NoOverlapError("the strips do not overlap")
        return first.where("false").select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(0.0).alias("diff"))
    spec = GridSpec.over(*box, res)
    inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    low = lambda df, name: cells(df.where(inside), spec, F.min("z").alias(name))
    return low(first, "_a").join(low(second, "_b"), ["row", "col"]).select("row", "col", (F.col("_a") - F.col("_b")).alias("diff"))


def strip_alignment(diffs: DataFrame, trim: tuple[float, float] = (5, 95)) -> DataFrame:
    """One row: mean, median, deviation of the trimmed differences; counts. All 0 without overlap."""
    diffs = settle(diffs)  # read twice, and far smaller than the strips
    low, high = percentiles(diffs, "diff", [t / 100 for t in trim]) or (0.0, 0.0)
    kept = diffs.where(F.col("diff").between(low, high))
    middle = (percentiles(kept, "diff", [0.5]) or [0.0])[0]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return kept.agg(
        zero(F.avg("diff")).alias("mean_offset"),
        F.lit(float(middle)).alias("median_offset"),
        zero(F.stddev_pop("diff")).alias("std_offset"),
        F.count("*").alias("trimmed_cells"),
        F.lit(diffs.count()).cast("long").alias("sampled_cells"),
    )


def merge_strips(strips: list[DataFrame], shifts: list[float] | None = None) -> DataFrame:
    """All strips one after the other in real coordinates, each with its height shift; strip is its number."""
    if not strips:
        raise ConfigurationError("no strips to merge")
    shifts = shifts or [0.0] * len(strips)
    if len(shifts) != len(strips):
        raise ConfigurationError(f"{len(shifts)} shifts for {len(strips)} strips")
    moved = [s.withColumn("z", F.col("z") + F.lit(dz)) if abs(dz) > 1e-5 else s for s, dz in zip(strips, shifts, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("strip", F.lit(i)) for i, s in enumerate(moved)])


def corridor(points: DataFrame, start: tuple[float, float], end: tuple[float, float], width: float) -> DataFrame:
    """Points within width / 2 of a line, with their distance along it and offset from it."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = (dx * dx + dy * dy) ** 0.5
    if not length:
        raise ConfigurationError("a corridor needs two places")
    px, py = F.col("x") - start[0], F.col("y") - start[1]
    out = points.withColumn("distance", (px * dx + py * dy) / length).withColumn("offset", (py * dx - px * dy) / length)
    box = [min(start[0], end[0]) - width, max(start[0], end[0]) + width, min(start[1], end[1]) - width, max(start[1], end[1]) + width]
    return out.where(F.col("x").between(*box[:2]) & F.col("y").between(*box[2:])).where(F.col("distance").between(0, length) & (F.abs("offset") <= width / 2))


def height_at(points: DataFrame, spec: GridSpec, raster: DataFrame, z: str = "z", out: str = "cell_z") -> DataFrame:
    """The raster's value in each point's cell (null outside the raster's cells)."""
    return binned(points, spec).join(raster.select("row", "col", F.col(z).alias(out)), ["row", "col"], "left")
