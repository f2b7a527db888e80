"""Neighbourhoods on dense grids: windows along rows, then along columns.

Each helper costs two exchanges of the raster (by row, by column) however many
neighbours it looks at; nothing is multiplied by the size of the stencil.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along() -> WindowSpec:
    return Window.partitionBy("row").orderBy("col")


def down() -> WindowSpec:
    return Window.partitionBy("col").orderBy("row")


def unmasked(z: Column | str, sentinel: float | None) -> Column:
    """Nulls as the sentinel that a stencil is to see, or as they are."""
    z = F.col(z) if isinstance(z, str) else z
    return z if sentinel is None else F.coalesce(z, F.lit(sentinel))


def gradient(raster: DataFrame, z: str = "z", sentinel: float | None = None, keep_mask: bool = True, out: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """Central differences, one-sided at the edges: gx eastward, gy southward, for cells of size 1."""
    v = unmasked(z, sentinel)
    df = raster.withColumn("_v", v)
    df = df.withColumn("_w", F.lag("_v").over(along())).withColumn("_e", F.lead("_v").over(along())).withColumn("_fw", F.lag(F.lit(1)).over(along())).withColumn("_fe", F.lead(F.lit(1)).over(along()))
    df = df.withColumn("_n", F.lag("_v").over(down())).withColumn("_s", F.lead("_v").over(down())).withColumn("_fn", F.lag(F.lit(1)).over(down())).withColumn("_fs", F.lead(F.lit(1)).over(down()))

    def diff(a: str, b: str, fa: str, fb: str) -> Column:
        here, one, two = F.col("_v"), F.col(a), F.col(b)
        return F.when(F.col(fa).isNull() & F.col(fb).isNull(), F.lit(0.0)).when(F.col(fa).isNull(), two - here).when(F.col(fb).isNull(), here - one).otherwise((two - one) / 2)

    df = df.withColumn(out[0], diff("_w", "_e", "_fw", "_fe")).withColumn(out[1], diff("_n", "_s", "_fn", "_fs"))
    return df.drop("_v", "_w", "_e", "_n", "_s", "_fw", "_fe", "_fn", "_fs")


def eight(raster: DataFrame, z: str = "z", sentinel: float | None = None) -> DataFrame:
    """The eight neighbours' values as columns n, ne, e, se, s, sw, w, nw (null beyond the edge)."""
    df = raster.withColumn("_v", unmasked(z, sentinel))
    df = df.withColumn("w", F.lag("_v").over(along())).withColumn("e", F.lead("_v").over(along()))
    df = df.withColumn("_t", F.struct("w", F.col("_v").alias("c"), "e"))
    df = df.withColumn("_u", F.lag("_t").over(down())).withColumn("_d", F.lead("_t").over(down()))
    names = {"nw": "_u.w", "n": "_u.c", "ne": "_u.e", "sw": "_d.w", "s": "_d.c", "se": "_d.e"}
    return df.select(*raster.columns, "w", "e", *[F.col(v).alias(k) for k, v in names.items()])


def _mirror(i: Column, n: int) -> Column:
    """Index reflected at the edges, edge samples twice (period 2n)."""
    m = F.pmod(i, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def weighted(raster: DataFrame, z: str, weights: list[float], axis: str, n: int) -> DataFrame:
    """Weighted sum along an axis of n cells, mirrored at the edges."""
    r = len(weights) // 2
    w = (along() if axis == "col" else down()).rowsBetween(-r, r)
    df = raster.withColumn("_a", F.collect_list(z).over(w))
    first = F.greatest(F.col(axis) - r, F.lit(0))
    total = sum((F.get("_a", (_mirror(F.col(axis) + k - r, n) - first).cast("int")) * weight for k, weight in enumerate(weights)), F.lit(0.0))
    return df.withColumn(z, total).drop("_a")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(raw) for x in raw]


def smooth(raster: DataFrame, z: str, weights: list[float], height: int, width: int) -> DataFrame:
    """A separable filter along both axes."""
    return weighted(weighted(raster, z, weights, "col", width), z, weights, "row", height)


def box3(raster: DataFrame, z: str, out: str) -> DataFrame:
    """Mean of 3 x 3 cells, edge samples mirrored."""
    df = raster.withColumn("_h", (F.coalesce(F.lag(z).over(along()), F.col(z)) + F.col(z) + F.coalesce(F.lead(z).over(along()), F.col(z))) / 3)
    return df.withColumn(out, (F.coalesce(F.lag("_h").over(down()), F.col("_h")) + F.col("_h") + F.coalesce(F.lead("_h").over(down()), F.col("_h"))) / 3).drop("_h")


def median3(raster: DataFrame, z: str, out: str) -> DataFrame:
    """Median of 3 x 3 cells, edge samples mirrored."""
    three = lambda c, w: F.array(F.coalesce(F.lag(c).over(w), F.col(c)), F.col(c), F.coalesce(F.lead(c).over(w), F.col(c)))
    df = raster.withColumn("_r", three(z, along())).withColumn("_g", F.flatten(three("_r", down())))
    return df.withColumn(out, F.get(F.sort_array("_g"), F.lit(4))).drop("_r", "_g")


def dilated_square(raster: DataFrame, mask: str, n: int) -> DataFrame:
    """mask true wherever it is within n cells in both directions (n rounds of 8-neighbour dilation)."""
    df = raster.withColumn(mask, F.max(mask).over(along().rangeBetween(-n, n)))
    return df.withColumn(mask, F.max(mask).over(down().rangeBetween(-n, n)))


def dilated_diamond(raster: DataFrame, mask: str, n: int) -> DataFrame:
    """mask true wherever it is within n steps (n rounds of 4-neighbour dilation).

    Distance along the row first, by the last and next true cell; then the least of
    that plus the row distance over 2n + 1 rows: two windows whatever n is.
    """
    here = F.when(F.col(mask), F.col("col"))
    back = F.max(here).over(along().rangeBetween(-n, 0))
    ahead = F.min(here).over(along().rangeBetween(0, n))
    df = raster.withColumn("_d", F.least(F.col("col") - back, ahead - F.col("col")))
    near = F.min(F.when(F.col("_d").isNotNull(), F.col("_d") + F.col("row"))).over(down().rangeBetween(0, n)) - F.col("row")
    far = F.min(F.when(F.col("_d").isNotNull(), F.col("_d") - F.col("row"))).over(down().rangeBetween(-n, 0)) + F.col("row")
    return df.withColumn(mask, F.coalesce(F.least(near, far) <= n, F.lit(False))).drop("_d")
