"""Mixing sources to target weights: hash order in each source, prefix sums, an exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import digest60, fresh, lane_of, lanes, running, settle

SEED = "mix "
CAP = 3


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Targets for (source, source_size): weights 1, 2, 3 by turns in code-point order, null last.

    The targets share the sum of all sizes by weight; one stops at cap times its
    source's size and the rest is shared again by weight. In closed form: with
    sources in order of cap * size / weight, those stop that lie below the level at
    which the others' shares meet what is left.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))
    limit = F.col("source_size").cast("double") * cap
    w = w.withColumn("_limit", limit).withColumn("_ratio", limit / F.col("weight"))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    w = w.withColumn("_level", (F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    # the first source whose own level is below its ratio sets the level of all that follow
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(all_rows)["_level"]
    share = F.coalesce(level * F.col("weight"), F.col("_limit"))
    return w.withColumn("target", F.least(share, F.col("_limit"))).select("source", "source_size", "weight", "target")


def mix(df: DataFrame, key: str, source: str, size: Column, cap: float = CAP, seed: str = SEED, carry: list[Column] | None = None) -> DataFrame:
    """How much of every row the mix takes.

    Returns key, source, size, source_size, target, epochs (full passes over the source),
    before (size of the rows of the source that come earlier in hash order), taken
    (size taken, repeats counted; the row at the cut gives just what is missing, so each
    source's taken sizes sum to its target rounded down) and copies (whole rows: the
    row at the cut counts when half of it lies inside). Null keys and sources are keys and a
    source like any other; rows of size 0 take 0; repeated rows count as often as they
    stand; an empty table gives an empty result.
    """
    base = df.select(df[key].alias("key"), df[source].alias("source"), size.alias("size"), *(carry or []))
    base = settle(base.withColumn("_key", digest60(F.col("key"), seed)).withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    per_lane = lanes(base.count())
    base = base.withColumn("_lane", lane_of(F.col("_key"), per_lane, 60))
    sizes = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, cap).withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source", "weight")
    tie = ["_key", "key", "size"]
    rows = running(base, ["_src"], "_lane", tie, F.col("size"), "before").join(targets, "_src")
    budget = F.floor(F.col("target") + 1e-6)
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 1e-6) AS BIGINT) div greatest(source_size, 1)")).otherwise(0).cast("long"))
    rows = rows.withColumn("_left", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("_left") - F.col("before"), F.col("size")))
    rows = rows.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    rows = rows.withColumn("copies", (F.col("epochs") + ((F.col("size") > 0) & (2 * part >= F.col("size"))).cast("long")).cast("int"))
    return rows.drop("_src", "_key", "_lane", "_left")


def mixed_rows(df: DataFrame, row: Column, key: str, source: str, size: Column, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The rows of df as often as the mix takes them whole, none where it takes less than half of one.

    row is a hash that tells rows apart; rows that it does not are copies of one another and
    are each taken as the mix says.
    """
    (h,) = fresh(df, "_row")
    taken = mix(df, key, source, size, cap, seed, [row.alias("row")])
    # equal rows: all that the mix takes of them, on one of them
    often = taken.where("copies > 0").groupBy("row").agg(F.sum("copies").cast("int").alias("n")).withColumnRenamed("row", h)
    one = df.withColumn(h, row)
    (n, at) = fresh(one, "_n", "_at")
    one = one.join(often.withColumnRenamed("n", n), h).withColumn(at, F.row_number().over(Window.partitionBy(h).orderBy(key)))
    return one.where(F.col(at) == 1).withColumn(at, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*df.columns)
