"""Exact percentiles by counting: no task ever holds the distinct values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Values that may come to the driver once the bins of all wanted ranks are narrow.
MOST = 100_000


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """The values at these shares of the sorted column, linearly interpolated between ranks; None without values.

    Each pass counts the values in BINS even bins of every range that still holds a wanted rank and goes
    on with the bins that hold one, until few values are left, which are then looked at. Nulls do
    not count.
    """
    x = F.col(column).cast("double")
    lo, hi, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n:
        return None
    places = [s * (n - 1) for s in shares]
    wanted = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    # ranges (lo, hi) of values with the ranks that lie in them, counted from the range's least value
    ranges, found = {(lo, hi): ([(r, r) for r in wanted], n)}, {}
    while ranges:
        for a, b in [r for r in ranges if r[0] == r[1]]:
            found |= {r: a for r, _ in ranges.pop((a, b))[0]}
        if not ranges:
            break
        order = sorted(ranges)  # they do not overlap
        # each value once and one range by its place: conditions on a computed column, or filters on it, would compute it once a range
        of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("i"))
        placed = df.select(x.alias("x")).withColumn("i", sum(((F.col("x") >= a).cast("int") for a, _ in order), F.lit(-1)))
        inside = F.col("x") <= of([b for _, b in order])
        if sum(m for _, m in ranges.values()) <= MOST:
            values = sorted((r["v"], r["m"]) for r in placed.groupBy(F.when(inside, F.col("x")).alias("v")).agg(F.count("x").alias("m")).collect() if r["v"] is not None)
            for a, b in order:
                here = [v for v, m in values if a <= v <= b for _ in range(m)]
                found |= {r: here[k] for r, k in ranges[a, b][0]}
            break
        at = F.floor((F.col("x") - of([a for a, _ in order])) / of([max((b - a) / BINS, 5e-324) for a, b in order]))
        placed = placed.select("x", "i", F.when(inside, F.least(at, F.lit(BINS - 1)).cast("long")).alias("b"))
        rows = [r for r in placed.groupBy("i", "b").agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect() if r["b"] is not None]
        narrower: dict = {}
        for i, key in enumerate(order):
            left = list(ranges[key][0])
            before = 0
            for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["b"]):
                mine = [(rank, k - before) for rank, k in left if before <= k < before + r["m"]]
                if mine:
                    narrower[r["lo"], r["hi"]] = (mine, r["m"])
                before += r["m"]
        ranges = narrower
    return [found[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * found[math.floor(p)] + (p - math.floor(p)) * found[math.ceil(p)] for p in places]
