"""Exact nearest neighbours: blocks of queries meet the nodes that a proven bound lets near them.

A pyramid of node counts bounds the distance of every query's k-th neighbour with nine cells a
level, so a void costs levels, not cells. Only nodes within a block's bound are sent to it; there
halving boxes of queries throw out nodes until few are left to be compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.plans.storage import settle

#: Fine cells along a block's side: as many as a task's queries span.
SIDE = 32
#: Queries that are compared with all nodes left for their box.
LEAF = 64


def k_nearest(qx: np.ndarray, qy: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, nodes, squared distances) by box: the k nearest nodes, the earlier one first where they tie."""
    todo = [(np.arange(len(qx)), np.arange(len(x)))]
    while todo:
        q, c = todo.pop()
        ax, bx, ay, by = qx[q].min(), qx[q].max(), qy[q].min(), qy[q].max()
        if len(c) > k:
            px, py = x[c], y[c]
            far = np.maximum(np.abs(px - ax), np.abs(px - bx)) ** 2 + np.maximum(np.abs(py - ay), np.abs(py - by)) ** 2
            near = np.maximum(np.maximum(ax - px, px - bx), 0) ** 2 + np.maximum(np.maximum(ay - py, py - by), 0) ** 2
            c = c[near <= np.partition(far, k - 1)[k - 1] * (1 + 1e-9)]
        if len(q) <= LEAF or (ax == bx and ay == by):
            for i in range(0, len(q), LEAF):
                some = q[i : i + LEAF]
                dx, dy = x[c][None, :] - qx[some][:, None], y[c][None, :] - qy[some][:, None]
                d2 = dx * dx + dy * dy
                at = np.argsort(d2, axis=1, kind="stable")[:, :k]
                yield some, c[at], np.take_along_axis(d2, at, axis=1)
            continue
        along = qx[q] if bx - ax >= by - ay else qy[q]
        low = along <= (along.min() + along.max()) / 2
        todo += [(q[low], c), (q[~low], c)]


def _bounds(cells: DataFrame, asked: DataFrame, f: float, k: int) -> DataFrame:
    """(bi, bj, bound): no query of a block has its k-th neighbour farther than the bound.

    A query's cell and the eight around it hold k nodes on some level of the pyramid; the levels above the
    lowest such one are tried only for cells that still lack one.
    """
    open_, found, level = asked, [], 0
    while True:
        up = cells if level == 0 else cells.groupBy(F.shiftright("i", level).alias("i"), F.shiftright("j", level).alias("j")).agg(F.sum("n").alias("n"))
        own = open_.select("i", "j", "bi", "bj", F.shiftright("i", level).alias("ci"), F.shiftright("j", level).alias("cj"))
        step = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
        around = own.select("ci", "cj").distinct().withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
        sums = around.join(up.select((F.col("i")).alias("_i"), F.col("j").alias("_j"), "n"), (F.col("ci") + F.col("di") == F.col("_i")) & (F.col("cj") + F.col("dj") == F.col("_j"))).groupBy("ci", "cj").agg(F.sum("n").alias("n"))
        done = settle(own.join(sums, ["ci", "cj"], "left").select("i", "j", "bi", "bj", (F.coalesce("n", F.lit(0)) >= k).alias("ok")))
        # the farthest corner of the nine cells from a place in the middle one
        found.append(done.where("ok").groupBy("bi", "bj").agg(F.lit(2 * math.sqrt(2) * f * 2**level).alias("bound")))
        open_ = done.where("NOT ok").select("i", "j", "bi", "bj")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found).groupBy("bi", "bj").agg(F.max("bound").alias("bound"))
        level += 1


def nearest(queries: DataFrame, nodes: DataFrame, key: list[str], k: int, bucket: float, value: Column, tie: list[str]) -> DataFrame:
    """key and near, the k nearest nodes of each query in order of (d2, tie), as an array of structs d2, value.

    queries have key, qx, qy; nodes have x, y and the whole-number columns tie. bucket is the least
    width of the cells that nodes are counted in; where nodes are thinner, cells are as wide as hold about k of them.
    Queries are absent if there is no node at all.
    """
    placed = settle(nodes.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), value.cast("double").alias("value"), *tie))
    ends = placed.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not ends[4]:
        return queries.where("false").select(*key, F.lit(None).cast("array<struct<d2:double,value:double>>").alias("near"))
    k = min(k, ends[4])
    f = max(bucket, math.sqrt((ends[1] - ends[0]) * (ends[3] - ends[2]) * k / ends[4]))
    cell = lambda c: F.floor(F.col(c) / f).cast("long")
    block = lambda c: F.expr(f"floor({c} / {SIDE})").cast("long")
    cells = settle(placed.groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n")))
    todo = queries.select(*key, F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy")).withColumn("_i", cell("qx")).withColumn("_j", cell("qy"))
    todo = todo.withColumn("_bi", block("_i")).withColumn("_bj", block("_j")).drop("_i", "_j")
    asked = queries.select(cell("qx").alias("i"), cell("qy").alias("j")).distinct().withColumn("bi", block("i")).withColumn("bj", block("j"))
    bounds = settle(_bounds(cells, settle(asked), f, k))
    # a block asks the cells, on a scale of its own bound, that its widened box meets: at most four by four
    wide = f * SIDE
    scale = F.greatest(F.lit(0), F.ceil(F.log2(F.col("bound") / wide))).cast("int")
    asking = bounds.withColumn("m", scale).withColumn("s", F.lit(wide) * F.pow(F.lit(2.0), F.col("m")))
    span = lambda b: F.sequence(F.floor((F.col(b) * wide - F.col("bound")) / F.col("s")).cast("long"), F.floor(((F.col(b) + 1) * wide + F.col("bound")) / F.col("s")).cast("long"))
    asking = asking.withColumn("si", F.explode(span("bi"))).withColumn("sj", F.explode(span("bj")))
    scales = [r["m"] for r in asking.select("m").distinct().collect()]  # one for each level of the pyramid
    keyed = placed.withColumn("m", F.explode(F.array(*map(F.lit, scales)))).withColumn("_s", F.lit(wide) * F.pow(F.lit(2.0), F.col("m")))
    keyed = keyed.withColumn("si", F.floor(F.col("x") / F.col("_s")).cast("long")).withColumn("sj", F.floor(F.col("y") / F.col("_s")).cast("long")).drop("_s")
    gap = lambda b, p: F.greatest(F.col(b) * wide - F.col(p), F.col(p) - (F.col(b) + 1) * wide, F.lit(0.0))
    sent = keyed.join(asking, ["m", "si", "sj"]).where(gap("bi", "x") * gap("bi", "x") + gap("bj", "y") * gap("bj", "y") <= F.col("bound") * F.col("bound") * (1 + 1e-9))
    sent = sent.select(F.col("bi").alias("_bi"), F.col("bj").alias("_bj"), "x", "y", "value", *tie)

    def answer(_: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({**{n: [] for n in key}, "d2": [], "value": []})
        c = c.sort_values(tie, kind="stable")
        x, y, v = c["x"].to_numpy(), c["y"].to_numpy(), c["value"].to_numpy()
        asks, d2, values = [], [], []
        for some, at, d in k_nearest(q["qx"].to_numpy(), q["qy"].to_numpy(), x, y, k):
            asks.append(some)
            d2 += list(d)
            values += list(v[at])
        out = q.iloc[np.concatenate(asks)][key].reset_index(drop=True)
        return out.assign(d2=d2, value=values)

    kinds = ", ".join(f"{n} {queries.schema[n].dataType.simpleString()}" for n in key)
    found = todo.groupBy("_bi", "_bj").cogroup(sent.groupBy("_bi", "_bj")).applyInPandas(answer, f"{kinds}, d2 array<double>, value array<double>")
    return found.select(*key, F.zip_with("d2", "value", lambda d, v: F.struct(d.alias("d2"), v.alias("value"))).alias("near"))


def idw(near: Column, least: float = 1e-4) -> Column:
    """Mean of the neighbours' values, weighted by the inverse square of distances of at least `least`."""
    w = lambda s: 1.0 / F.greatest(s["d2"], F.lit(least * least))
    total = lambda f: F.aggregate(near, F.lit(0.0), lambda a, s: a + f(s))
    return total(lambda s: s["value"] * w(s)) / total(w)


def _envelope(f: list) -> tuple[list[int], list[int]]:
    """For a column of squared row distances (None: no source in the row), the rows that are nearest, and from where on.

    The lower envelope of the parabolas (r - q)**2 + f[q]: each row enters and leaves it once.
    """
    rows, starts = [], []
    for u, g in enumerate(f):
        if g is None:
            continue
        while rows:
            q = rows[-1]
            # the first place at which u is strictly nearer, so the lesser row keeps ties
            at = (g + u * u - f[q] - q * q) // (2 * (u - q)) + 1
            if at > starts[-1]:
                break
            rows.pop()
            starts.pop()
        else:
            at = 0
        rows.append(u)
        starts.append(max(at, 0))
    return rows, starts


def nearest_cells(raster: DataFrame, value: str, wanted: Column) -> DataFrame:
    """row, col and value of the nearest cell that has one, for the null cells that are wanted (ties: least row, then col).

    Two passes over a dense grid, linear in its cells: the nearest along each row by windows, then each
    column's lower envelope in a task. A column is in memory at a time.
    """
    along = Window.partitionBy("row").orderBy("col")
    source = F.when(F.col(value).isNotNull(), F.struct("col", F.col(value).alias("v")))
    left = F.last(source, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(source, ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    df = raster.select("row", "col", left.alias("a"), right.alias("b"), (wanted & F.col(value).isNull()).alias("open"))
    nearer = F.when(F.col("b").isNull() | (F.col("col") - F.col("a.col") <= F.col("b.col") - F.col("col")), F.col("a")).otherwise(F.col("b"))
    df = df.select("row", "col", "open", nearer.alias("s")).select("row", "col", "open", F.abs(F.col("s.col") - F.col("col")).cast("double").alias("g"), F.col("s.v").cast("double").alias("v"))

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["open"].to_numpy()
        if not asked.any():
            return pdf.iloc[:0][["row", "col", "v"]]
        pdf = pdf.sort_values("row")
        row, g, asked = pdf["row"].to_numpy(), pdf["g"].to_numpy(), pdf["open"].to_numpy()
        first, f = row[0], [None] * int(row[-1] - row[0] + 1)
        for r, d in zip((row - first).tolist(), g.tolist(), strict=True):
            f[r] = None if d != d else int(d) ** 2
        rows, starts = _envelope(f)
        if not rows:
            return pdf.iloc[:0][["row", "col", "v"]]
        at = np.array(rows)[np.searchsorted(np.array(starts), row[asked] - first, side="right") - 1] + first
        return pd.DataFrame({"row": row[asked], "col": pdf["col"].iloc[0], "v": pdf["v"].to_numpy()[np.searchsorted(row, at)]})

    return df.groupBy("col").applyInPandas(column, "row long, col long, v double").withColumnRenamed("v", value)
