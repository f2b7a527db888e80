"""Extension points: what a user's own operators look like."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

from aerolith.schema import GridSpec


@runtime_checkable
class Diagnostic(Protocol):
    def run(self, data: DataFrame, **options: Any) -> DataFrame: ...


@runtime_checkable
class SurfaceGenerator(Protocol):
    def generate(self, points: DataFrame, spec: GridSpec, **options: Any) -> DataFrame: ...


@runtime_checkable
class PointFilter(Protocol):
    def apply(self, points: DataFrame) -> DataFrame: ...


@runtime_checkable
class Profiler(Protocol):
    def profile(self, data: DataFrame, **options: Any) -> DataFrame: ...
