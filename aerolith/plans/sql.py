"""Operators from SQL: register a cloud or raster as views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from aerolith.functions.grid import grid_of
from aerolith.operators import points as pc
from aerolith.operators import surfaces, terrain
from aerolith.schema import GridSpec


def register_cloud(points: DataFrame, name: str, res: float = 1.0) -> GridSpec:
    """Views name, name_dsm, name_ground, name_density and name_classes."""
    spec = grid_of(points, res)
    points.createOrReplaceTempView(name)
    surfaces.highest(points, spec).createOrReplaceTempView(f"{name}_dsm")
    surfaces.ground_nodes(points, spec).createOrReplaceTempView(f"{name}_ground")
    pc.density(points, spec).createOrReplaceTempView(f"{name}_density")
    pc.class_counts(points).createOrReplaceTempView(f"{name}_classes")
    return spec


def register_raster(raster: DataFrame, spec: GridSpec, name: str) -> None:
    """Views name, name_slope, name_aspect and name_hillshade."""
    raster.createOrReplaceTempView(name)
    terrain.slope(raster, spec).createOrReplaceTempView(f"{name}_slope")
    terrain.aspect(raster, spec).createOrReplaceTempView(f"{name}_aspect")
    terrain.hillshade(raster, spec).createOrReplaceTempView(f"{name}_hillshade")
