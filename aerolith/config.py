"""Compute profiles as Spark settings, set for a session or for a block of code."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from aerolith.schema import ConfigurationError


@dataclass(frozen=True)
class ComputeConfig:
    """chunk: points in a scan task; block: raster rows in one; share: part of the cluster's cores to plan for."""

    chunk: int = 2_500_000
    block: int = 2048
    share: float = 0.75
    most_cores: int | None = None
    low_memory: bool = False

    def __post_init__(self) -> None:
        if self.chunk <= 0 or self.block <= 0 or not 0 < self.share <= 1:
            raise ConfigurationError("chunk and block are positive, share is in (0, 1]")

    def settings(self, cores: int) -> dict[str, str]:
        n = max(1, int(cores * self.share))
        n = min(n, self.most_cores) if self.most_cores else n
        return {
            "spark.sql.shuffle.partitions": str(max(1, 2 * n)),
            # a point of the narrow schema takes about 40 bytes
            "spark.sql.files.maxPartitionBytes": str(self.chunk * 40),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
        }


#: Points and rows in a task, share of cores.
PROFILES = {
    "maximum": ComputeConfig(5_000_000, 4096, 1.0),
    "balanced": ComputeConfig(2_500_000, 2048, 0.75),
    "low_memory": ComputeConfig(1_000_000, 1024, 1.0, 4, True),
}
_current = PROFILES["balanced"]


def get_config() -> ComputeConfig:
    return _current


def set_config(**changes) -> ComputeConfig:
    global _current
    _current = replace(_current, **changes)
    return _current


def reset_config() -> ComputeConfig:
    return set_profile("balanced")


def set_profile(name: str, spark: SparkSession | None = None) -> ComputeConfig:
    """Take a profile, and set the session up for it if one is given."""
    global _current
    if name not in PROFILES:
        raise ConfigurationError(f"no profile {name}; there are {', '.join(PROFILES)}")
    _current = PROFILES[name]
    if spark is not None:
        apply(spark)
    return _current


def apply(spark: SparkSession) -> None:
    for k, v in _current.settings(spark.sparkContext.defaultParallelism).items():
        spark.conf.set(k, v)


@contextmanager
def compute_context(spark: SparkSession | None = None, profile: str | None = None, **changes) -> Iterator[ComputeConfig]:
    """A profile or changes for one block; session settings and profile come back after it."""
    global _current
    before = _current
    _current = replace(PROFILES[profile] if profile else _current, **changes)
    held: dict[str, str | None] = {}
    if spark is not None:
        for k in _current.settings(1):
            held[k] = spark.conf.get(k, None)
        apply(spark)
    try:
        yield _current
    finally:
        _current = before
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy() -> None:
    """Collect garbage where memory is low."""
    if _current.low_memory:
        gc.collect()


class Timer:
    """Wall-clock seconds of a block."""

    def __enter__(self) -> Timer:
        self.start, self.seconds = time.perf_counter(), 0.0
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self.start


def timed(f, *args, **kwargs) -> tuple:
    """Result of a call and its seconds."""
    with Timer() as t:
        out = f(*args, **kwargs)
    return out, t.seconds
