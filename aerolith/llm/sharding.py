"""Hilbert-curve ordering: metadata cells along a space-filling curve, cut into even runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import digest60, fresh, n_partitions, settle

BITS = 5


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for state * 2**n + cell, for one level of an n-dimensional Hilbert curve.

    A state is an entry corner and a direction; levels are related by the
    reflected Gray code. Built from that rule for any n.
    """
    full = (1 << n) - 1
    rol = lambda x, k: ((x << (k % n)) | (x >> (n - k % n))) & full
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = {g: i for i, g in enumerate(gray)}
    entry = lambda i: 0 if i == 0 else gray[2 * ((i - 1) // 2)]
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # trailing ones
    turn = lambda i: 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n
    states, todo, digits, following = {(0, 0): 0}, [(0, 0)], [], []
    for e, d in todo:  # grows while it is read
        for cell in range(1 << n):
            w = rank[rol(cell ^ e, n - (d + 1) % n)]
            to = (e ^ rol(entry(w), d + 1), (d + turn(w) + 1) % n)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            digits.append(w)
            following.append(states[to])
    return digits, following


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Index along the curve of integer coordinates in [0, 2**bits)."""
    n = len(coords)
    digits, following = curve_table(n)
    table_d, table_s = F.array(*map(F.lit, digits)), F.array(*map(F.lit, following))

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for c in coords:
            cell = cell * 2 + F.call_function("getbit", c.cast("long"), level).cast("int")
        at = acc["s"] * (1 << n) + cell
        return F.struct(F.get(table_s, at).alias("s"), (acc["h"] * (1 << n) + F.get(table_d, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["h"])


def quantile_bounds(df: DataFrame, dims: list[str], bits: int = BITS) -> list[list]:
    """For each dimension the values at the exact quantiles i / (2**bits - 1) of its rows, by whole values.

    Values are counted first, so a value that many rows share is one row; the counts are range-sorted and
    summed in two levels. At most 2**bits - 2 bounds a dimension come to the driver.
    """
    spark, bins, kinds = df.sparkSession, 2**bits - 1, dict(df.dtypes)
    text = lambda c: F.col(c).cast("string") if kinds[c] == "string" else F.lit(None).cast("string")
    number = lambda c: F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), text(c).alias("s"), number(c).alias("d")) for k, c in enumerate(dims)])).alias("v")).select("v.*")
    counts = values.where("s IS NOT NULL OR d IS NOT NULL").groupBy("dim", "s", "d").agg(F.count("*").alias("n"))
    by = ["dim", "s", "d"]
    parts = settle(counts.repartitionByRange(n_partitions(spark), *by).withColumn("part", F.spark_partition_id()))
    # a row for each partition and dimension
    sums = parts.groupBy("dim", "part").agg(F.sum("n").alias("m"))
    sums = sums.select("dim", "part", (F.sum("m").over(Window.partitionBy("dim").orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("dim")).alias("all"))
    inside = Window.partitionBy("dim", "part").orderBy("s", "d")
    rows = parts.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(sums), ["dim", "part"])
    at = lambda rank: F.expr(f"({rank}) * {bins}L div all")
    ends = rows.where((at("before + upto") > at("before + upto - n")) & (at("before + upto - n") < bins - 1)).select("dim", "s", "d").collect()
    return [sorted(r["s"] if kinds[c] == "string" else r["d"] for r in ends if r["dim"] == k) for k, c in enumerate(dims)]


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """Each dimension as a bin number in [0, 2**bits), by exact quantiles over all rows; strings in byte order, nulls in bin 0."""
    kinds = dict(df.dtypes)

    def bin_of(c: str, bounds: list) -> Column:
        value = F.col(c) if kinds[c] == "string" else F.col(c).cast("double")
        below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)) if bounds else F.lit(0)
        return F.when(value.isNull(), 0).otherwise(below + 1)

    return [bin_of(c, bounds) for c, bounds in zip(dims, quantile_bounds(df.select(*dims), dims, bits), strict=True)]


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int, keep: list[Column], order: list[str], bits: int = BITS) -> DataFrame:
    """Place every row in a shard along the Hilbert curve of its metadata; shard sizes differ by one row at most.

    Rows in one cell of the curve follow each other in hash order of the first of
    order, so a cell that holds a third of all rows still spreads over the range
    partitions. Returns keep plus curve (long), shard (int) and slot (long, from
    0 without gaps); where keep has such a name, the new column's gets a "_". Null metadata is the lowest bin; equal rows are
    kept, each with its own slot; an empty table gives an empty result.
    """
    spark = df.sparkSession
    coords = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quantised(df, dims, bits))])
    (cell,) = fresh(df, "_cell")
    placed = df.withColumn(cell, coords)
    kept = placed.select(*keep, F.col(cell))
    curve, shard, slot, at, part, rank = fresh(kept, "curve", "shard", "slot", "_at", "_part", "_rank")
    kept = kept.withColumn(curve, hilbert_index([F.col(cell)[f"c{i}"] for i in range(len(dims))], bits)).drop(cell)
    by = [F.col(curve), digest60(F.col(order[0]), "shard "), *map(F.col, order)]
    sorted_rows = kept.repartitionByRange(n_partitions(spark), *by).sortWithinPartitions(*by)
    placed = settle(sorted_rows.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(F.col(part).alias("p")).agg(F.count("*").alias("n"))
    # one row for each partition, whose number is a setting
    offsets = counts.select(F.struct(F.col("p"), F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all")).alias(rank))
    ranked = placed.join(F.broadcast(offsets), F.col(part) == F.col(f"{rank}.p"))
    here, total = F.col(f"{rank}.before") + F.col(at).bitwiseAND((1 << 33) - 1), F.col(f"{rank}.all")
    ranked = ranked.withColumn(rank, F.struct(here.alias("r"), total.alias("n")))
    ranked = ranked.withColumn(shard, F.expr(f"CAST({rank}.r * {n_shards} div {rank}.n AS INT)"))
    return ranked.withColumn(slot, F.expr(f"{rank}.r - ({shard} * {rank}.n + {n_shards - 1}) div {n_shards}")).drop(part, at, rank)


def shard_ledger(placed: DataFrame, dims: list[str]) -> DataFrame:
    """Least and greatest value of each dimension in each shard: what a reader prunes files by."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)])


def write_shards(df: DataFrame, dims: list[str], n_shards: int, order: list[str], path: str, bits: int = BITS) -> None:
    """Write all rows of df, null and repeated keys too, as one folder a shard, in slot order."""
    names = fresh(df, "shard", "slot")
    placed = hilbert_shards(df, dims, n_shards, [F.col(c) for c in df.columns], order, bits)
    placed.repartitionByRange(n_partitions(df.sparkSession), *names).sortWithinPartitions(*names).write.mode("overwrite").partitionBy(names[0]).parquet(path)
