"""Terrain rectification: anomalies replaced by a fitted surface, blended, and applied to points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.graph import least_reachable
from aerolith.functions.grid import binned, every
from aerolith.functions.stencil import dilated_diamond, gaussian_weights, smooth
from aerolith.operators.surfaces import nearest_filled
from aerolith.plans.storage import settle
from aerolith.schema import GridSpec

FIELDS = ["1", "x", "y", "x*y", "x*x", "y*y"]


def default_mask(threshold: float, spec: GridSpec) -> Column:
    """Spikes below the top of the grid and a step in its upper left, as shares of its size."""
    r, c = spec.height, spec.width
    spike = (F.col("z") > threshold) & (F.col("row") > 0.08 * r)
    step = (F.col("col") < 0.45 * c) & (F.col("row") > 0.12 * r) & (F.col("row") < 0.38 * r) & (F.col("z") < threshold - 40)
    return spike | step


def fit_plane(ring: DataFrame, order: int = 2) -> tuple[list[float], tuple[float, float]] | None:
    """Least-squares coefficients over centred coordinates, from one row of moment sums; None under 6 cells."""
    centre = ring.agg(F.avg("col"), F.avg("row"), F.count("*")).first()
    if centre[2] < 6:
        return None
    x0, y0 = centre[0], centre[1]
    x, y = F.col("col") - x0, F.col("row") - y0
    terms = [F.lit(1.0), x, y] + ([x * y, x * x, y * y] if order >= 2 else [])
    n = len(terms)
    sums = ring.agg(*[F.sum(terms[i] * terms[j]) for i in range(n) for j in range(i, n)], *[F.sum(t * F.col("z")) for t in terms]).first()
    a, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = sums[at]
            at += 1
    return [float(v) for v in np.linalg.lstsq(a, np.array(sums[at:], float), rcond=None)[0]], (x0, y0)


def fitted(coefficients: list[float], centre: tuple[float, float]) -> Column:
    x, y = F.col("col") - centre[0], F.col("row") - centre[1]
    terms = [F.lit(1.0), x, y, x * y, x * x, y * y][: len(coefficients)]
    return sum((t * k for t, k in zip(terms, coefficients, strict=True)), F.lit(0.0))


def relaxed(iterations: int):
    """Jacobi relaxation of one patch with its rim: masked cells move to the mean of their neighbours."""

    def patch(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        shape = (pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1)
        z, mask, have = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        r, c = (pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy()
        z[r, c], mask[r, c], have[r, c] = pdf["z"], pdf["mask"], True

        def neighbour(dr: int, dc: int) -> np.ndarray:
            rows, cols = np.clip(np.arange(shape[0]) + dr, 0, shape[0] - 1), np.clip(np.arange(shape[1]) + dc, 0, shape[1] - 1)
            there = have[np.ix_(rows, cols)]
            return np.where(there, z[np.ix_(rows, cols)], z)  # the edge of the grid repeats

        for _ in range(iterations):
            z = np.where(mask, (neighbour(-1, 0) + neighbour(1, 0) + neighbour(0, -1) + neighbour(0, 1)) / 4, z)
        inside = pdf["mask"].to_numpy()
        return pd.DataFrame({"row": pdf["row"][inside], "col": pdf["col"][inside], "infill": z[r, c][inside]})

    return patch


def surface(raster: DataFrame, spec: GridSpec, mask: DataFrame | None = None, step: int = 4, threshold: float = 1035.0, order: int = 2, iterations: int = 150, sigma: float = 6.0) -> DataFrame:
    """row, col of the coarser grid with delta_z to add and its weight w.

    The mask is the given one, or spikes and the step, grown by 8; a quadric fitted to the ring of 6
    around it starts a relaxation inside; the mask, smoothed, weights the result. Mask, growth and ring hold valid
    cells only: a void (null, or -500 and below) has no correction. Patches that hang together are relaxed in a task of their own.
    """
    coarse = spec.coarser(step)
    some = every(raster, step).select("row", "col", F.when(F.col("z") > -500, F.col("z")).alias("_z"))
    src = nearest_filled(some, "_z", "z").withColumn("valid", F.col("_z").isNotNull())
    on = lambda c: F.coalesce(c, F.lit(False)) & F.col("valid")
    if mask is None:
        df = dilated_diamond(src.withColumn("mask", on(default_mask(threshold, coarse))), "mask", 8)
    else:
        df = src.join(mask.select("row", "col", F.lit(True).alias("mask")), ["row", "col"], "left")
    df = settle(df.withColumn("mask", on(F.col("mask"))))
    ringed = settle(dilated_diamond(df.withColumn("ring", F.col("mask")), "ring", 6).withColumn("ring", on(F.col("ring")) & ~F.col("mask")))
    fit = fit_plane(ringed.where("ring"), order)
    if fit is None:
        return df.select("row", "col", F.lit(0.0).alias("delta_z"), F.lit(0.0).alias("w"))
    start = ringed.withColumn("fit", F.when(F.col("mask"), fitted(*fit)).otherwise(F.col("z")))
    number = F.col("row") * coarse.width + F.col("col")
    inside = settle(start.where("mask").select(number.alias("node"), "row", "col"))
    moves = [(0, 1, 1), (1, 0, coarse.width)]
    edges = None
    for dr, dc, d in moves:
        e = inside.where(F.col("col") < coarse.width - 1 if dc else F.lit(True)).select(F.col("node").alias("u"), (F.col("node") + d).alias("v")).join(inside.select(F.col("node").alias("v")), "v")
        edges = e.select("u", "v") if edges is None else edges.unionByName(e.select("u", "v"))
    roots = least_reachable(edges, inside.select("node"))
    member = inside.join(roots, "node").select("row", "col", "root")
    halo = member.select("root", F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])).alias("p")).select("root", "p.row", "p.col").distinct()
    own = member.withColumnRenamed("root", "_own")
    patch = halo.join(start.select("row", "col", F.col("fit").alias("z")), ["row", "col"]).join(own, ["row", "col"], "left").withColumn("mask", F.coalesce(F.col("_own") == F.col("root"), F.lit(False)))
    infill = patch.select("root", "row", "col", "z", "mask").groupBy("root").applyInPandas(relaxed(iterations), "row long, col long, infill double")
    weight = smooth(df.select("row", "col", F.col("mask").cast("double").alias("w")), "w", gaussian_weights(sigma), coarse.height, coarse.width)
    weight = weight.select("row", "col", F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0)).alias("w"))
    out = ringed.join(weight, ["row", "col"]).join(infill, ["row", "col"], "left")
    delta = F.when(F.col("mask"), F.col("w") * (F.col("infill") - F.col("z"))).otherwise(0.0)
    return out.select("row", "col", F.coalesce(delta, F.lit(0.0)).alias("delta_z"), "w")


def apply_surface(points: DataFrame, delta: DataFrame, spec: GridSpec) -> DataFrame:
    """Points with the surface's correction added where it weighs over .001 and moves over .001; corrected tells which."""
    moved = F.coalesce((F.col("w") > 0.001) & (F.abs("delta_z") > 0.001), F.lit(False))
    out = binned(points, spec).join(delta.select("row", "col", "delta_z", "w"), ["row", "col"], "left").withColumn("corrected", moved)
    return out.withColumn("z", F.when(F.col("corrected"), F.col("z") + F.col("delta_z")).otherwise(F.col("z"))).select(*points.columns, "corrected")
