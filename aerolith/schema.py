"""Data model: schemas of the tables, grid metadata, typed errors."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINT = T.StructType(
    [
        T.StructField("pid", T.LongType(), False),
        T.StructField("strip", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z")],
        *[T.StructField(c, T.IntegerType()) for c in ("classification", "return_number", "number_of_returns", "intensity", "red", "green", "blue")],
        T.StructField("gps_time", T.DoubleType()),
    ]
)
CELL = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("z", T.DoubleType())])
CONTROL = T.StructType([T.StructField("point_id", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z")], T.StructField("point_type", T.StringType())])

#: Class names of the LAS specification.
CLASS_NAMES = {
    0: "Created, Never Classified",
    1: "Unclassified",
    2: "Ground",
    3: "Low Vegetation",
    4: "Medium Vegetation",
    5: "High Vegetation",
    6: "Building",
    7: "Low Point (Noise)",
    8: "Model Key-point",
    9: "Water",
    12: "Overlap Points",
}


class EngineError(Exception):
    """Root of all errors that the engine raises itself."""


class ConfigurationError(EngineError): ...


class DataError(EngineError): ...


class PointCloudError(DataError): ...


class MissingColumnError(PointCloudError): ...


class NoGroundError(PointCloudError): ...


class NoOverlapError(PointCloudError): ...


class RasterError(DataError): ...


class GridMismatchError(RasterError): ...


class EmptyRasterError(RasterError): ...


class CrsError(DataError): ...


class ControlPointError(DataError): ...


class FormatError(DataError): ...


class ComputationError(EngineError): ...


class ExportError(EngineError): ...


class NotSupportedError(EngineError): ...


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: row 0 is the northernmost, col 0 the westernmost."""

    min_x: float
    max_y: float
    res_x: float
    res_y: float
    width: int
    height: int
    epsg: int | None = 32632
    nodata: float | None = None

    @classmethod
    def over(cls, min_x: float, min_y: float, max_x: float, max_y: float, res: float, epsg: int | None = 32632) -> GridSpec:
        if res <= 0:
            raise ConfigurationError(f"cell size must be positive, not {res}")
        return cls(min_x, max_y, res, res, max(1, math.ceil((max_x - min_x) / res)), max(1, math.ceil((max_y - min_y) / res)), epsg)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top"""
        return self.min_x, self.max_y - self.height * self.res_y, self.min_x + self.width * self.res_x, self.max_y

    @property
    def cell_area(self) -> float:
        return self.res_x * self.res_y

    def coarser(self, step: int) -> GridSpec:
        return GridSpec(self.min_x, self.max_y, self.res_x * step, self.res_y * step, -(-self.width // step), -(-self.height // step), self.epsg, self.nodata)

    def as_dict(self) -> dict:
        return asdict(self)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """df, when it has the columns; an error that names the others if not."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnError(f"the table has no column {', '.join(missing)}")
    return df


def same_grid(a: GridSpec, b: GridSpec) -> None:
    if (a.width, a.height) != (b.width, b.height):
        raise GridMismatchError(f"grids of {a.height} x {a.width} and {b.height} x {b.width} cells")
