"""Orthomosaics, contrast, vegetation indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.grid import densified
from aerolith.operators.surfaces import colour_means, footprint, nearest_filled
from aerolith.plans.storage import settle
from aerolith.schema import ConfigurationError, GridSpec, need

INDICES = ("VARI", "GLI", "TGI", "EXG", "NGRDI")


def orthomosaic(points: DataFrame, spec: GridSpec, buffer: float = 3.0, step: int = 2, alpha: bool = False, contrast: bool = False) -> DataFrame:
    """Colours of the footprint, gaps from the nearest cell; 0 outside; alpha 255 inside."""
    found = settle(colour_means(points, spec))
    inside = settle(footprint(points, spec, buffer, step, found).withColumn("_in", F.lit(True)))
    packed = found.select("row", "col", ((F.col("r") * 256 + F.col("g")) * 256 + F.col("b")).cast("long").alias("_rgb"))
    full = nearest_filled(densified(packed, spec), "_rgb", "_rgb", inside)
    full = full.join(inside, ["row", "col"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    band = lambda shift: F.shiftright("_rgb", shift).bitwiseAND(255).cast("int")
    out = full.select("row", "col", "_in", *[F.when(F.col("_in"), band(s)).otherwise(0).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))])
    if contrast:
        out = stretched(out, ["r", "g", "b"], F.col("_in"))
    return out.select("row", "col", "r", "g", "b", *([F.when(F.col("_in"), 255).otherwise(0).alias("a")] if alpha else []))


def stretched(raster: DataFrame, bands: list[str], mask: Column | None = None, low: float = 2, high: float = 98) -> DataFrame:
    """Each band spread over 0..255 between two percentiles of its positive values in the mask."""
    mask = F.lit(True) if mask is None else mask
    ends = raster.agg(*[F.percentile(F.when(mask & (F.col(b) > 0), F.col(b)), F.array(F.lit(low / 100), F.lit(high / 100))).alias(f"_{b}") for b in bands])
    out = raster.crossJoin(F.broadcast(ends))
    for b in bands:
        lo, hi = F.get(f"_{b}", F.lit(0)), F.get(f"_{b}", F.lit(1))
        spread = F.floor(F.least(F.greatest((F.col(b) - lo) / (hi - lo) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
        out = out.withColumn(b, F.when(mask & (hi > lo), F.try_divide(spread, F.lit(1)).cast("int")).otherwise(F.col(b)))
    return out.drop(*[f"_{b}" for b in bands])


def _guarded(den: Column) -> Column:
    return F.when(F.abs(den) < 1e-4, F.lit(1e-4)).otherwise(den)


def _clipped(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))


def vegetation_index(raster: DataFrame, name: str) -> DataFrame:
    """row, col, value of an index from visible bands; null where all bands are 0."""
    need(raster, "r", "g", "b")
    name = name.upper()
    if name not in INDICES:
        raise ConfigurationError(f"no index {name}; there are {', '.join(INDICES)}")
    top = raster.agg(F.max(F.greatest("r", "g", "b"))).first()[0]
    scale = 255.0 if top is not None and top > 1 else 1.0
    r, g, b = (F.col(c).cast("double") / scale for c in "rgb")
    if name == "VARI":
        v = _clipped((g - r) / _guarded(g + r - b))
    elif name == "GLI":
        v = _clipped((2 * g - r - b) / _guarded(2 * g + r + b))
    elif name == "TGI":
        v = g - 0.39 * r - 0.61 * b
    elif name == "EXG":
        total = F.when(r + g + b < 1e-4, F.lit(1e-4)).otherwise(r + g + b)
        v = 2 * (g / total) - r / total - b / total
    else:
        v = _clipped((g - r) / _guarded(g + r))
    some = (F.col("r") > 0) | (F.col("g") > 0) | (F.col("b") > 0)
    return raster.select("row", "col", F.when(some, v).alias("value"))
