"""What the operators share: tables, the shared folder, word expressions, ranks, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions.graph import components  # noqa: F401  the operators take these from here
from aerolith.plans.storage import settle, shared_dir  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df has not got."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; an empty array for null and for text without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


class WordHash(dict):
    """63-bit hashes of words (bytes); holds at most `most` of them."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words of a UTF-8 text; bytes.split() splits at the six ASCII white-space characters."""
        found = text.split() if text else []
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the usual xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def spread(key: Column, seed: int) -> Column:
    """A pseudo-random long from a key, the same on every run."""
    return F.xxhash64(key, F.lit(seed))


def lanes(n_rows: int, per_lane: int = 512, most: int = 1 << 16) -> int:
    """How many hash lanes keep about per_lane rows in each; with `most` lanes each holds a share of the rows."""
    return min(most, max(8, 1 << max(0, (max(1, n_rows) // per_lane).bit_length())))


def digest60(key: Column, salt: str) -> Column:
    """The first 60 bits of an MD5 of salt and key as a long, which any SQL engine can give; null is like an empty key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def lane_of(key: Column, n_lanes: int, width: int = 64) -> Column:
    """The lane of a hash key of so many bits; lanes are in key order (both as unsigned numbers)."""
    bits = n_lanes.bit_length() - 1
    return F.shiftrightunsigned(key, width - bits) if bits else F.lit(0).cast("long")


def running(df: DataFrame, group: list[str], lane: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of value over the rows before each row, in (lane, order) order within group.

    Two levels: rows are summed inside a lane, lanes inside their group, so a
    group that holds a third of all rows is still spread over all its lanes.
    """
    per_lane = (
        df.groupBy(*group, lane)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_sum")
    )
    inner = Window.partitionBy(*group, lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(per_lane, [*group, lane])
        .withColumn(out, F.col("_within") + F.col("_before"))
        .drop("_within", "_before")
    )


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library hold of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable, batches: Iterator, *args) -> Iterator:
    """What work gives for a task's batches; after them, the waiting Python worker holds no memory that the task has freed."""
    try:
        yield from work(batches, *args)
    finally:
        give_back()


def open_store(uri: str) -> tuple:
    """File system and path of a URI, for any store that Arrow knows; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: under another name first, so a lost task leaves no half file."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder, deleted when the session's file systems close."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return store.makeQualified(place).toString()
