"""Packing: optimal length buckets from the global histogram, token-budget batches inside each."""

from __future__ import annotations

from array import array
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import lane_of, lanes, running, settle, spread

BUCKETS = 32
TOKENS = 65_536


def best_bounds(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """At most k upper bounds that minimise sum(count * (bound - length)); exact dynamic program in whole numbers.

    With c[i] rows in the first i lengths, the best cost of buckets that end at j is the least of
    best[i] - lengths[j] * c[i + 1] over i < j, plus lengths[j] * c[j + 1]: lines in lengths[j] whose
    slopes fall, so a layer is one walk along their lower envelope, O(k n) in all.
    """
    n = len(lengths)
    if n <= k:
        return [int(x) for x in lengths]
    lengths, c = [int(x) for x in lengths], [0, *accumulate(int(x) for x in counts)]
    best = [x * m for x, m in zip(lengths, c[1:], strict=True)]  # one bucket; what the lengths themselves sum to is the same for all cuts
    back = []
    for _ in range(1, k):
        new, arg, line, at = best[:1], array("q", [0]), [], 0
        for j in range(1, n):
            i = j - 1
            s, b = c[i + 1], best[i]
            # a line is of no use if its neighbours meet below it
            while len(line) > 1:
                (s1, b1, _), (s2, b2, _) = line[-2], line[-1]
                if (b - b1) * (s2 - s1) > (b2 - b1) * (s - s1):
                    break
                line.pop()
            line.append((s, b, i))
            at, x = min(at, len(line) - 1), lengths[j]
            while at + 1 < len(line) and line[at + 1][1] - x * line[at + 1][0] < line[at][1] - x * line[at][0]:
                at += 1
            new.append(line[at][1] - x * line[at][0] + x * c[j + 1])
            arg.append(line[at][2])
        back.append(arg)
        best = new
    out, j = [], n - 1
    for arg in reversed(back):
        out.append(lengths[j])
        if j == 0:
            return sorted(set(out))
        j = arg[j]
    return sorted({*out, lengths[j]})


def pack(df: DataFrame, key: str, length: Column, n_buckets: int = BUCKETS, tokens: int = TOKENS, seed: int = 10) -> DataFrame:
    """Give every row a length bucket and a batch whose padded size keeps the token budget.

    Returns key, length, bucket, bucket_len (what its batch pads to), batch (in the
    bucket, from 0), place (in the batch), padding and padded. A row longer than the budget is
    a batch by itself, never cut. Rows go to batches in hash order. Length 0 (null and
    empty texts) is a length like any other; repeated rows all get places; an
    empty table gives an empty result. Only the histogram goes to the driver, a row for each distinct
    length: of T tokens in all there are at most sqrt(2 T).
    """
    base = settle(df.select(df[key].alias("key"), length.cast("long").alias("length")).withColumn("_key", spread(F.col("key"), seed)))
    found = base.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toPandas()
    n_rows = int(found["n"].sum())
    bounds = best_bounds(found["length"].tolist(), found["n"].tolist(), n_buckets) or [0]
    ends = F.array(*[F.lit(x).cast("long") for x in bounds])
    bucket = F.size(F.filter(ends, lambda b: b < F.col("length")))
    rows = base.withColumn("bucket", bucket).withColumn("bucket_len", F.get(ends, F.col("bucket")))
    rows = rows.withColumn("_lane", lane_of(F.col("_key"), lanes(n_rows)))
    rows = running(rows, ["bucket"], "_lane", ["_key", "key", "length"], F.lit(1), "_rank")
    fit = F.expr(f"greatest(1, {tokens} div greatest(bucket_len, 1))")
    return (
        rows.withColumn("_fit", fit)
        .withColumn("batch", F.expr("_rank div _fit"))
        .withColumn("place", (F.col("_rank") % F.col("_fit")).cast("int"))
        .withColumn("padding", F.col("bucket_len") - F.col("length"))
        .drop("_key", "_lane", "_rank", "_fit")
    )
