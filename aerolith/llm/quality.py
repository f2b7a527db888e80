"""Quality classifier by importance resampling: target against raw hashed n-gram models, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import WordHash, fresh, lean, mixed, settle, spread

BITS = 16
#: Most labelled rows that the target model and the cut are fitted on, the least by hash.
LABELLED = 20_000
SMOOTH = 0.5
#: Nats between the medians of good and bad labelled rows, to which log weights are scaled before the noise: most
#: good texts lie one to five nats above the cut, among which Gumbel noise (deviation 1.3) decides.
GAP = 10.0
#: N-grams of ratio 1 that every text counts as having besides its own: a short one is rejected on evidence only.
PRIOR = 20
#: A good text rejected costs as much as so many bad ones kept.
KEEP = 4
SEED = 1


def ngram_buckets(text: bytes | None, hashes: WordHash, bits: int = BITS) -> np.ndarray:
    """Buckets of all word unigrams and bigrams of the text."""
    h = hashes.of(text)
    if not len(h):
        return np.empty(0, np.int64)
    pairs = h[:-1] * np.uint64(0x100000001B3) + h[1:] + np.uint64(1)
    return (mixed(np.concatenate([h, pairs])) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    hashes, n = WordHash(), 1 << bits
    raw, good = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for pdf in batches:
        for text, is_good in zip(pdf["_text"], pdf["_good"], strict=True):
            c = np.bincount(ngram_buckets(text, hashes, bits), minlength=n) if text and len(text) > 200_000 else None
            if c is None:
                at = ngram_buckets(text, hashes, bits)
                np.add.at(raw, at, 1)
                if is_good:
                    np.add.at(good, at, 1)
            else:
                raw += c
                good += c if is_good else 0
    at = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": at.astype(np.int32), "raw": raw[at], "good": good[at]})


def _scored(batches: Iterator[pd.DataFrame], ratio: np.ndarray, bits: int) -> Iterator[pd.DataFrame]:
    hashes = WordHash()
    for pdf in batches:
        n, s = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
        for i, text in enumerate(pdf["_text"]):
            at = ngram_buckets(text, hashes, bits)
            n[i] = len(at)
            s[i] = ratio[at].sum(dtype=np.float64) / (len(at) + PRIOR)
        out = pdf.drop(columns=["_text"])
        yield out.assign(n_features=n, ratio=s)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the best sum of both classes' accuracy, the good one's KEEP-fold; of equal ones, the middle of the widest gap."""
    if not len(good) or not len(bad):
        return -np.inf
    v = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[v[0]], (v[1:] + v[:-1]) / 2])
    score = KEEP * (1 - np.searchsorted(np.sort(good), cuts) / len(good)) + np.searchsorted(np.sort(bad), cuts) / len(bad)
    best = np.flatnonzero(score >= score.max() - 1e-12)
    gaps = np.concatenate([[0], np.diff(v)])[best]
    return float(cuts[best[int(np.argmax(gaps))]])


def kth_largest(df: DataFrame, value: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest of a long column, exactly: each pass counts bins and goes into one of them."""
    lo, hi, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while hi > lo:
        width = -(-(hi - lo + 1) // bins)
        at = F.expr(f"({value} - ({lo}L)) div {width}L")
        found = sorted(((r["b"], r["n"]) for r in df.where(F.col(value).between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for b, c in found:
            if k <= c:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= c
    return lo


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a key, the same on every run."""
    u = (F.shiftrightunsigned(spread(key, seed), 11).cast("double") + 0.5) * 2.0**-53
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED, bits: int = BITS, gap: float = GAP, seed: int = SEED, k: int | None = None) -> DataFrame:
    """Log importance weight of every row and whether the Gumbel top-k keeps it.

    Raw counts cover all rows. Of the labelled rows at most `labelled` are used (the documented
    bound): two thirds of them for the target model (those with label 1), the others, held
    out, for the cut. The log weight of a row is the mean log ratio of target to raw probability over
    its n-grams and PRIOR neutral ones, scaled so that the labelled classes lie `gap` nats apart and 0 is the
    cut between them. The k largest weights with Gumbel noise are kept (ties with the k-th too), which
    draws k rows without replacement in proportion to their weights; by default k is the number of rows above 0.

    Returns key, _row (hash of key and text, to join back by), n_features, log_weight,
    noisy, kept. Texts without words (null, empty) have nothing to weigh and are rejected.
    Without rows labelled both ways the cut is below all others. Repeated rows share
    their fate; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_good"))
    marks = marks.orderBy(spread(F.col("_key"), seed), "_key").limit(labelled).withColumn("_fit", F.pmod(spread(F.col("_key"), seed + 100), F.lit(3)) > 0)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("binary").alias("_text"), row_hash(docs[key], docs[text]).alias("_row"))
    rows = rows.join(F.broadcast(settle(marks)), rows["key"] == F.col("_key"), "left").drop("_key")
    counts = rows.select("_text", (F.col("_fit") & (F.col("_good") == 1)).alias("_good")).mapInPandas(lambda b: lean(_counted, b, bits), "bucket int, raw long, good long")
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[found["bucket"]], good[found["bucket"]] = found["raw"], found["good"]
    model = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * len(c)))
    ratio = (model(good) - model(raw)).astype(np.float32)
    held = spark.sparkContext.broadcast(ratio)
    kind = rows.schema["key"].dataType.simpleString()
    scored = settle(rows.mapInPandas(lambda b: lean(_scored, b, held.value, bits), f"key {kind}, _row long, _good int, _fit boolean, n_features long, ratio double"))
    fit = scored.where("_good IS NOT NULL AND NOT _fit AND n_features > 0").select("_good", "ratio").toPandas()
    ok, bad = fit.loc[fit["_good"] == 1, "ratio"].to_numpy(), fit.loc[fit["_good"] == 0, "ratio"].to_numpy()
    cut = best_cut(ok, bad)
    scale = gap / max(1e-6, float(np.median(ok) - np.median(bad))) if np.isfinite(cut) else 1.0
    weight = (F.col("ratio") - F.lit(cut if np.isfinite(cut) else -1e6)) * scale
    noisy = scored.withColumn("log_weight", weight).withColumn("noisy", F.col("log_weight") + gumbel(F.col("_row"), seed))
    noisy = noisy.withColumn("_at", F.when(F.col("n_features") > 0, F.round(F.least(F.greatest("noisy", F.lit(-1e9)), F.lit(1e9)) * 2**20).cast("long")))
    k = noisy.where("n_features > 0 AND log_weight >= 0").count() if k is None else k
    least = kth_largest(noisy, "_at", k)
    kept = F.coalesce(F.col("_at") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return noisy.withColumn("kept", kept).drop("_at", "_good", "_fit", "ratio")


def row_hash(key: Column, text: Column) -> Column:
    """Identity of a row for joining a decision back to it."""
    return F.xxhash64(F.coalesce(text, F.lit("")), key.cast("string"), text.isNull())


def kept_rows(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the resampling keeps, with their columns."""
    (h,) = fresh(docs, "_row")
    keys = decided.where("kept").select(F.col("_row").alias(h)).distinct()
    return docs.withColumn(h, row_hash(docs[key], docs[text])).join(keys, h, "left_semi").select(*docs.columns)
