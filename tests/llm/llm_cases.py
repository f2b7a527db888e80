import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = ["key", "size", "row", "_row", "_h", "taken", "fp", "root", "shard", "slot", "bucket", "_text", "n_words", "kept", "count", "source_size", "_lane", "m", "_curve", "curve", "_cell", "_at", "_part", "_rank", "part", "dim", "length", "payload", "sha", "node", "path"]


def frame(spark, rows):
    """Documents of (doc_id, text, source) with columns that clash with inner names."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def odd_rows():
    """Null, empty and very long texts, ties, repeated rows, null keys and sources."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "run", "Über", "été", "|", "x1", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(30_000)
    same = text(80)
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, long, "b"), (5, same, "a"), (6, same, "b"), (6, same, "b"), (None, same, None), (None, None, None), (7, "word", "c"), (8, "é\n" * 5, "c")]
    return rows + [(10 + i, text(rng.randint(1, 120)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(60)]
