"""Drainage: flow directions, accumulation, streams and the indices built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.quantiles import percentiles
from aerolith.functions.graph import subtree_sizes
from aerolith.functions.stencil import eight, gradient
from aerolith.plans.storage import settle
from aerolith.schema import ComputationError, GridSpec

#: What a stencil sees in a cell without data.
SENTINEL = -9999.0
#: Cells along a tile's side, within which flow is summed at first.
TILE = 128
#: Direction code, neighbour, row step, column step.
DIRECTIONS = [(1, "e", 0, 1), (2, "se", 1, 1), (4, "s", 1, 0), (8, "sw", 1, -1), (16, "w", 0, -1), (32, "nw", -1, -1), (64, "n", -1, 0), (128, "ne", -1, 1)]


def _coded(raster: DataFrame, spec: GridSpec, sentinel: float | None = SENTINEL) -> DataFrame:
    """row, col, z and the code of the steepest strictly lower neighbour."""
    df = eight(raster, sentinel=sentinel)
    far = math.hypot(spec.res_x, spec.res_y)
    drops = []
    for code, name, dr, dc in DIRECTIONS:
        dist = far if dr and dc else (spec.res_y if dr else spec.res_x)
        drops.append(F.struct(((F.col("z") - F.col(name)) / dist).alias("drop"), F.lit(-code).alias("code")))
    # the greatest drop, and of equal ones the greatest -code
    best = F.array_max(F.filter(F.array(*drops), lambda d: d["drop"] > 0))
    return df.select("row", "col", "z", F.coalesce(F.when(F.col("z").isNotNull(), -best["code"]), F.lit(0)).cast("int").alias("code"))


def d8(raster: DataFrame, spec: GridSpec, sentinel: float | None = SENTINEL) -> DataFrame:
    """row, col, code of the steepest strictly lower neighbour (the lowest code of equal ones), 0 for none."""
    return _coded(raster, spec, sentinel).drop("z")


def d_infinity(raster: DataFrame, spec: GridSpec) -> DataFrame:
    """Angle of steepest descent: 0 is east, growing toward the south, in [0, 2 pi)."""
    df = gradient(raster, sentinel=SENTINEL)
    angle = F.pmod(F.atan2(-F.col("gy") / spec.res_y, -F.col("gx") / spec.res_x), F.lit(2 * math.pi)) + 0.0
    return df.select("row", "col", F.when(F.col("z").isNotNull(), angle).alias("angle"))


def _tile_flow(nodes: np.ndarray, to: np.ndarray, width: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within one tile: n with all that drains through each cell, and the position of the cell in which the tile's part of its path ends."""
    order = np.argsort(nodes)
    at = order[np.minimum(np.searchsorted(nodes, to, sorter=order), len(nodes) - 1)]
    step = np.where(nodes[at] == to, at, -1)
    last = np.where(step < 0, np.arange(len(nodes)), step)
    for _ in range(64):
        some = step >= 0
        if not some.any():
            return n, last
        n = n + np.bincount(step[some], n[some], len(n)).astype(np.int64)
        step[some], last = step[step[some]], last[last]
    raise RuntimeError("the links have a cycle")


def _drained(links: DataFrame, width: int) -> DataFrame:
    """(node, n): how many nodes reach each one, itself included; links have node and to, cells that may lie anywhere.

    A tile sums its own cells. Only cells from which flow leaves a tile are linked by pointer doubling, each to the one where
    that flow leaves the next tile; what they bring is then summed along the paths within the tiles.
    """
    tiled = lambda df: df.withColumn("_ti", F.expr(f"node div {width * TILE}L")).withColumn("_tj", F.expr(f"node % {width}L div {TILE}L"))
    links = tiled(links)

    def rim(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, to = pdf["node"].to_numpy(), pdf["to"].fillna(-1).to_numpy().astype(np.int64)
        n, last = _tile_flow(nodes, to, width, np.ones(len(nodes), np.int64))
        row, col = nodes // width, nodes % width
        out = (to >= 0) & ((to // width // TILE != row // TILE) | (to % width // TILE != col // TILE))
        edge = (row % TILE % (TILE - 1) == 0) | (col % TILE % (TILE - 1) == 0) | (col == width - 1) | out
        found = pd.DataFrame({"node": nodes, "to": pd.array(to, "Int64").copy(), "n": n, "end": pd.array(nodes[last], "Int64").copy()})
        found.loc[~out, "to"] = pd.NA
        found.loc[~out[last], "end"] = pd.NA
        return found[edge]

    rims = settle(links.groupBy("_ti", "_tj").applyInPandas(rim, "node long, to long, n long, end long"))
    leaving = rims.where("to IS NOT NULL")
    chain = leaving.select("node", "to", "n").join(rims.select(F.col("node").alias("to"), F.col("end").alias("next")), "to", "left")
    totals = subtree_sizes(chain.select("node", F.col("next").alias("to"), "n"))
    brought = tiled(leaving.select("node", "to").join(totals, "node").groupBy(F.col("to").alias("node")).agg(F.sum("n").alias("more")))

    def summed(_: tuple, pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"node": [], "n": []})
        nodes, to = pdf["node"].to_numpy(), pdf["to"].fillna(-1).to_numpy().astype(np.int64)
        own = 1 + pd.Series(more["more"].to_numpy(), more["node"].to_numpy()).reindex(nodes).fillna(0).to_numpy().astype(np.int64)
        return pd.DataFrame({"node": nodes, "n": _tile_flow(nodes, to, width, own)[0]})

    return links.groupBy("_ti", "_tj").cogroup(brought.groupBy("_ti", "_tj")).applyInPandas(summed, "node long, n long")


def accumulation(raster: DataFrame, spec: GridSpec, codes: DataFrame | None = None, units: str = "cells") -> DataFrame:
    """row, col, acc: cells (or area) that drain through each valid cell, itself included; flow into voids is lost."""
    if units not in ("cells", "m2"):
        raise ComputationError(f"units are cells or m2, not {units}")
    valid = _coded(raster, spec).where("z IS NOT NULL") if codes is None else codes.join(raster.where("z IS NOT NULL").select("row", "col"), ["row", "col"])
    links = settle(valid.select((F.col("row") * spec.width + F.col("col")).alias("node"), "code"))
    step = F.create_map(*[F.lit(x) for code, _, dr, dc in DIRECTIONS for x in (code, dr * spec.width + dc)])
    sizes = _drained(links.select("node", (F.col("node") + step[F.col("code")]).alias("to")), spec.width)
    area = spec.cell_area if units == "m2" else 1
    acc = (F.col("n") * area).cast("double") if units == "m2" else F.col("n")
    return sizes.select(F.expr(f"node div {spec.width}L").alias("row"), (F.col("node") % spec.width).alias("col"), acc.alias("acc"))


def streams(acc: DataFrame, threshold: float = 500) -> DataFrame:
    return acc.select("row", "col", F.when((F.col("acc") >= threshold) & (F.col("acc") >= 0), 1).otherwise(0).alias("stream"))


def _slope_and_area(raster: DataFrame, spec: GridSpec, acc: DataFrame | None) -> DataFrame:
    """gx, gy, tan of slope (t) and specific area (a) of valid cells."""
    acc = accumulation(raster, spec) if acc is None else acc
    df = gradient(raster, sentinel=SENTINEL).where("z IS NOT NULL")
    gx, gy = F.col("gx") / spec.res_x, F.col("gy") / spec.res_y
    df = df.withColumn("gx", gx).withColumn("gy", gy).withColumn("t", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    return df.join(acc, ["row", "col"]).withColumn("a", F.greatest(F.lit(1.0), F.col("acc").cast("double")) * spec.res_x)


def _wetness(epsilon: float) -> Column:
    return F.log(F.col("a") / (F.col("t") + epsilon))


def wetness(raster: DataFrame, spec: GridSpec, acc: DataFrame | None = None, epsilon: float = 0.001) -> DataFrame:
    return _slope_and_area(raster, spec, acc).select("row", "col", _wetness(epsilon).alias("twi"))


def stream_power(raster: DataFrame, spec: GridSpec, acc: DataFrame | None = None) -> DataFrame:
    return _slope_and_area(raster, spec, acc).select("row", "col", (F.col("a") * F.col("t")).alias("spi"))


def sediment_transport(raster: DataFrame, spec: GridSpec, acc: DataFrame | None = None) -> DataFrame:
    sine = F.sin(F.atan("t"))
    value = F.pow(F.col("a") / 22.13, F.lit(0.6)) * F.pow(F.greatest(F.lit(1e-5), sine) / 0.0896, F.lit(1.3))
    return _slope_and_area(raster, spec, acc).select("row", "col", value.alias("sti"))


def landslide(raster: DataFrame, spec: GridSpec, weights: tuple[float, float, float] = (0.50, 0.35, 0.15), acc: DataFrame | None = None) -> DataFrame:
    """Hazard 0..100 from slope, wetness between its 5th and 95th percentile, and curvature; 255 without data."""
    acc = settle(accumulation(raster, spec)) if acc is None else acc
    grad = gradient(raster, sentinel=SENTINEL).withColumn("gx", F.col("gx") / spec.res_x).withColumn("gy", F.col("gy") / spec.res_y)
    # second differences of the gradients, for cells of size 1
    second = gradient(grad.select("row", "col", "z", "gx", "gy"), "gx", out=("gxx", "_u"))
    second = gradient(second, "gy", out=("_w", "gyy")).drop("_u", "_w")
    df = second.join(acc, ["row", "col"], "left").withColumn("t", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).withColumn("a", F.greatest(F.lit(1.0), F.col("acc").cast("double")) * spec.res_x)
    df = settle(df.withColumn("twi", F.when(F.col("z").isNotNull(), _wetness(0.001))))
    lo, hi = percentiles(df.where("twi > -100"), "twi", [0.05, 0.95]) or (0.0, 0.0)
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0))
    steep = clip(F.degrees(F.atan("t")) / 45 * 100)
    wet = clip((F.col("twi") - lo) / max(1e-5, hi - lo) * 100)
    bent = clip((-(F.col("gxx") + F.col("gyy")) + 0.5) * 100)
    hazard = F.floor(clip(steep * weights[0] + wet * weights[1] + bent * weights[2])).cast("int")
    return df.select("row", "col", F.when(F.col("z").isNotNull(), hazard).otherwise(255).alias("hazard"))
