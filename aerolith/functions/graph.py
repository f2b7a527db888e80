"""Graph kernels as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.plans.storage import settle


def subtree_sizes(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, n): how many nodes reach each node of a forest along (node, to), itself included; with n in the links, the sum of theirs.

    Pointer doubling: after round k a node knows the nodes within 2**k steps above it and
    its own 2**k-th successor, so the longest path costs its logarithm in rounds. Each
    round sums by successor before the shuffle and joins two tables of one row a node.
    """
    state = settle(links.select("node", "to", F.col("n") if "n" in links.columns else F.lit(1).cast("long").alias("n")))
    for _ in range(most_rounds):
        if state.where("to IS NOT NULL").isEmpty():
            return state.select("node", "n")
        gains = state.where("to IS NOT NULL").groupBy(F.col("to").alias("node")).agg(F.sum("n").alias("gain"))
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("next"))
        state = settle(state.join(gains, "node", "left").join(ahead, "to", "left").select("node", F.col("next").alias("to"), (F.col("n") + F.coalesce("gain", F.lit(0))).alias("n")))
    raise RuntimeError("the links have a cycle")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (u, v): (node, root), root being the least node.

    Alternates the large-star and small-star steps until the edges stay as they
    are. Only minima are gathered for a node, never its list of neighbours.
    """
    ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = settle(ordered(edges.where("u <> v")).distinct())
    measured = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    shape = edges.agg(*measured).first()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ordered(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = ordered(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(*measured).first()
        if now == shape:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        shape = now
    raise RuntimeError("components did not settle")


def least_reachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) for all nodes: the least node of its component; lone nodes are their own."""
    return nodes.join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def filled_holes(raster: DataFrame, mask: str) -> DataFrame:
    """mask also true where background does not reach the border through 4-neighbours.

    Background is cut into runs along rows; runs that touch in adjacent rows are linked, so the
    graph has a node a run, not a cell.
    """
    along = Window.partitionBy("row").orderBy("col")
    df = raster.withColumn("_new", F.when(F.col(mask) != F.coalesce(F.lag(mask).over(along), ~F.col(mask)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(along)).drop("_new")
    size = raster.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    runs = df.where(~F.col(mask)).groupBy("row", "_run").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    runs = settle(runs.withColumn("node", F.concat_ws(",", F.lpad(F.col("row").cast("string"), 12, "0"), F.lpad(F.col("a").cast("string"), 12, "0"))))
    border = (F.col("row").isin(size["r0"], size["r1"])) | (F.col("a") == size["c0"]) | (F.col("b") == size["c1"])
    below = runs.select((F.col("row") - 1).alias("row"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("v"))
    edges = runs.join(below, "row").where("a <= b2 AND a2 <= b").select(F.col("node").alias("u"), "v")
    roots = least_reachable(edges, runs)
    inside = roots.join(runs.withColumn("_edge", border), "node")
    closed = inside.groupBy("root").agg(F.max("_edge").alias("open")).where("NOT open").join(inside, "root").select("row", "_run", F.lit(True).alias("_hole"))
    return df.join(closed, ["row", "_run"], "left").withColumn(mask, F.col(mask) | F.coalesce("_hole", F.lit(False))).drop("_run", "_hole")
