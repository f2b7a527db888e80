"""Rule bitmask ledger: every rule once, failure bits and measurements, then policies over the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import words

#: Bit by bit: (name, failing condition over the measurements, SQL that Spark and DuckDB both read).
RULES = [
    ("short", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "10 * n_upper_words > 4 * n_words"),
    ("no_letters", "10 * n_alpha_words < 6 * n_words"),
]
#: Versioned policies: the rules that reject by themselves, and how many of the others may fail.
POLICIES = {
    "v1": (("short", "repeats"), 6),
    "v2": (("short", "repeats", "symbols", "shouting", "no_letters"), 1),
}
BASE = ("short", "repeats")


def bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def measure(df: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the text: key and the measurements that the rules read."""
    body = F.coalesce(df[text], F.lit(""))
    step = df.select(df[key].alias("key"), body.alias("_body"), words(df[text]).alias("_w"))
    lines = F.filter(F.split("_body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(
        "key",
        "_w",
        lines.alias("_lines"),
        F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_w").cast("long").alias("n_words"),
    )
    # the starts of three-word windows, each with the hash of its words, in hash order
    windows = F.when(
        F.size("_w") >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))),
    )
    step = step.select(
        "key",
        "n_words",
        "n_symbols",
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}\p{Lu}[^\p{Ll}]*$"))).cast("long").alias("n_upper_words"),
        F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        windows.alias("_s"),
    )
    same = lambda x, i: F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)) | F.when(i > 0, F.get("_s", i - 1)["h"] == x["h"]).otherwise(False)
    step = step.withColumn("_at", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"]))).drop("_s")
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["p"])).alias("n"), i.alias("p")), lambda a: a["n"])
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def ledger(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, measurements and fail_bits (bit i: rule i of RULES failed).

    A null text measures like an empty one. Window identity is a 64-bit hash of the
    three words. Repeated rows and null keys stay; an empty table gives an empty ledger.
    """
    bits = F.lit(0)
    for i, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), 1 << i).otherwise(0)
    return measure(df, key, text).withColumn("fail_bits", bits.cast("int"))


def verdict(policy: str) -> Column:
    """True where the ledger's bits pass the policy."""
    hard, soft = POLICIES[policy]
    mask = sum(bit(n) for n in hard)
    rest = ((1 << len(RULES)) - 1) & ~mask
    return (F.col("fail_bits").bitwiseAND(mask) == 0) & (F.bit_count(F.col("fail_bits").bitwiseAND(rest)) <= soft)


def ablations(book: DataFrame) -> DataFrame:
    """For each rule: rows that fail it, rows that fail it alone, and bits that ever (and always) come with it."""
    rows = book.groupBy("fail_bits").agg(F.count("*").alias("n"))  # at most 2 ** len(RULES) rows
    out = None
    for i, (name, _) in enumerate(RULES):
        b = 1 << i
        hit = rows.where(F.col("fail_bits").bitwiseAND(b) != 0)
        one = hit.agg(F.lit(name).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("fail_bits") == b, F.col("n"))), F.lit(0)).alias("failed_alone"), F.bit_or("fail_bits").alias("ever_with"), F.bit_and("fail_bits").alias("always_with"))
        out = one if out is None else out.unionByName(one)
    return out
