"""Control points and polygons from delimited text, GeoJSON, shapefiles and GeoPackages; features to the same."""

from __future__ import annotations

import csv
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.schema import CONTROL, ControlPointError, NotSupportedError
from aerolith.sources import vector_files

#: Column names that mean the same, in text files; the first found counts.
NAMES = {
    "point_id": ("id", "point_id", "pt_id", "name", "target", "code"),
    "x": ("x", "easting", "east", "lon", "longitude"),
    "y": ("y", "northing", "north", "lat", "latitude"),
    "z": ("z", "elevation", "elev", "height", "ortho_ht", "altitude"),
    "point_type": ("type", "point_type", "class", "role"),
}
#: Properties of features that mean the same.
PROPERTIES = {
    "point_id": ("id", "name", "point_id", "pt_id", "code", "target"),
    "z": ("z", "elev", "elevation", "height", "altitude", "ortho_ht"),
    "point_type": ("type", "class", "point_type", "role"),
}


def point_type(text: Column) -> Column:
    """CHECK for anything that says CHECK or CHK, else GCP."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.when(up.contains("CHECK") | up.contains("CHK"), "CHECK").otherwise("GCP")


def _sniff(head: str) -> tuple[str, list[str]]:
    lines = [x for x in head.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if not lines:
        raise ControlPointError("no rows in the control point file")
    sep = max((",", ";", "\t", " "), key=lambda s: (lines[0].count(s) > 1, lines[0].count(s) if s != " " else 0))
    return sep, next(csv.reader([lines[0]], delimiter=sep, skipinitialspace=True))


def read_control_text(spark: SparkSession, path: str) -> DataFrame:
    """Control points from delimited text: separator and header are found out, # lines and bad rows dropped.

    Without a header the columns are id, x, y, z[, type], or x, y, z. Without a type column the id column
    tells the type, so ids such as CHK_1 are check points.
    """
    said = ~F.trim("value").startswith("#") & (F.trim("value") != "")
    head = "\n".join(r["value"] for r in spark.read.text(path).where(said).limit(5).collect())
    sep, first = _sniff(head)
    named = {c.strip().lower(): i for i, c in enumerate(first)}
    number = lambda s: re.fullmatch(r"\s*[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?\s*", s) is not None
    has_header = any(n in named for n in (*NAMES["x"], *NAMES["z"])) or not any(map(number, first))
    n = len(first)
    rows = spark.read.csv(path, sep=sep, comment="#", header=False, schema=T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(n)]), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if has_header:
        at = {k: next((named[a] for a in names if a in named), 0) for k, names in NAMES.items()}
    elif n >= 4:
        at = {"point_id": 0, "x": 1, "y": 2, "z": 3, "point_type": 4 if n > 4 else 0}
    else:
        at = {"point_id": None, "x": 0, "y": 1, "z": 2, "point_type": None}
    col = lambda k: F.col(f"_{at[k]}") if at[k] is not None else F.lit(None).cast("string")
    x, y, z = (F.expr(f"try_cast(trim(_{at[k]}) AS DOUBLE)") for k in "xyz")
    name = F.coalesce(F.trim(col("point_id")), F.concat(F.lit("GCP_"), (F.monotonically_increasing_id() + 1).cast("string")))
    out = rows.select(name.alias("point_id"), x.alias("x"), y.alias("y"), z.alias("z"), point_type(col("point_type")).alias("point_type"))
    return out.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def _features(spark: SparkSession, path: str, geometry: str, kind: str) -> DataFrame:
    """Column f with geometry and properties of a file's features of one kind."""
    feature = f"struct<geometry:struct<type:string,coordinates:{geometry}>,properties:map<string,string>>"
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("shp", "gpkg"):
        found = vector_files.shapefile(path) if suffix == "shp" else vector_files.geopackage(path)
        rows = [(((name, places), properties),) for name, places, properties in found if name == kind]
        return spark.createDataFrame(rows, f"f {feature}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f")).where((F.col("f.geometry.type") == kind) & F.col("f.geometry.coordinates").isNotNull())


def read_control_features(spark: SparkSession, path: str) -> DataFrame:
    """Control points from points of a GeoJSON, shapefile or GeoPackage; the height is the third coordinate or a property that names one."""
    f = _features(spark, path, "array<double>", "Point")
    low = f.withColumn("p", F.transform_keys("f.properties", lambda k, _: F.lower(k)))
    prop = lambda *names: F.coalesce(*[F.try_element_at("p", F.lit(n)) for n in names])
    at = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    z = F.coalesce(at(2), *[F.expr(f"try_cast(try_element_at(p, '{n}') AS DOUBLE)") for n in PROPERTIES["z"]])
    name = F.coalesce(prop(*PROPERTIES["point_id"]), F.concat(F.lit("GCP_"), (F.monotonically_increasing_id() + 1).cast("string")))
    out = low.select(name.alias("point_id"), at(0).alias("x"), at(1).alias("y"), z.alias("z"), point_type(prop(*PROPERTIES["point_type"])).alias("point_type"))
    if not out.where("z IS NULL").isEmpty():
        raise ControlPointError("control points without height: no third coordinate and none of " + ", ".join(PROPERTIES["z"]))
    return out


def read_control(spark: SparkSession, source) -> DataFrame:
    """Control points from a path, a DataFrame, dicts or tuples (id, x, y, z[, type])."""
    if isinstance(source, DataFrame):
        low = {c.lower(): c for c in source.columns}
        pick = lambda k: next((F.col(low[a]) for a in NAMES[k] if a in low), F.lit(None))
        return source.select(pick("point_id").cast("string").alias("point_id"), *[pick(c).cast("double").alias(c) for c in "xyz"], point_type(pick("point_type").cast("string")).alias("point_type"))
    if isinstance(source, str):
        kind = source.rpartition(".")[2].lower()
        if kind in ("geojson", "json", "shp", "gpkg"):
            return read_control_features(spark, source)
        if kind in ("csv", "txt", "tsv", "dat"):
            return read_control_text(spark, source)
        raise NotSupportedError(f"control points from .{kind} files")
    rows = []
    for i, p in enumerate(source):
        if isinstance(p, dict):
            low = {k.lower(): v for k, v in p.items()}
            get = lambda k: next((low[a] for a in NAMES[k] if a in low), None)  # noqa: E731, B023
            name, x, y, z, kind = (get(k) for k in ("point_id", "x", "y", "z", "point_type"))
        else:
            name, x, y, z, kind = (*p, None)[:5] if len(p) >= 4 else (None, *p, None)
        text = str(kind or "GCP").upper()
        rows.append((str(name if name is not None else f"GCP_{i + 1}"), float(x), float(y), float(z), "CHECK" if "CHECK" in text or "CHK" in text else "GCP"))
    return spark.createDataFrame(rows, CONTROL)


def read_chips(spark: SparkSession, path: str, label: str = "id") -> DataFrame:
    """Boxes of the polygons of a GeoJSON, shapefile or GeoPackage: id, x_min, y_min, x_max, y_max."""
    f = _features(spark, path, "array<array<array<double>>>", "Polygon")
    ring = F.get("f.geometry.coordinates", F.lit(0))
    xs, ys = F.transform(ring, lambda p: F.get(p, F.lit(0))), F.transform(ring, lambda p: F.get(p, F.lit(1)))
    return f.select(F.try_element_at("f.properties", F.lit(label)).alias("id"), F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def line_features(lines: DataFrame) -> DataFrame:
    """A GeoJSON feature (value) for each row with a line of x, y; other columns are its properties."""
    rest = [c for c in lines.columns if c != "line"]
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("line", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def point_features(points: DataFrame) -> DataFrame:
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", *(["z"] if "z" in points.columns else [])).alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_geojson(features: DataFrame, path: str, newline: bool = True) -> str:
    """Features as newline-delimited GeoJSON parts in a folder, or one collection that passes the driver row by row."""
    if newline:
        features.write.mode("overwrite").text(path)
        return path
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(at) as f:
        f.write(b'{"type":"FeatureCollection","features":[')
        for i, r in enumerate(features.toLocalIterator()):
            f.write((b"," if i else b"") + r["value"].encode())
        f.write(b"]}")
    return path


def write_control(points: DataFrame, path: str, epsg: int = 32632) -> str:
    """Points with x, y, z and attributes (as text) as a shapefile or GeoPackage, by suffix; the file is made on the driver, so it is for one survey's control points."""
    suffix = path.rpartition(".")[2].lower()
    if suffix not in ("shp", "gpkg"):
        raise NotSupportedError(f"control points to .{suffix} files")
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    rows = points.select("x", "y", "z", *[F.col(c).cast("string").alias(c) for c in rest]).collect()
    places = [(r["x"], r["y"], r["z"]) for r in rows]
    texts = [{c: r[c] for c in rest if r[c] is not None} for r in rows]
    if suffix == "gpkg":
        files = {path: vector_files.geopackage_bytes(places, texts, epsg)}
    else:
        stem = path[: -len("shp")]
        files = dict(zip((path, stem + "shx", stem + "dbf"), vector_files.shapefile_bytes(places, texts), strict=True))
    from pyarrow import fs

    for name, data in files.items():
        store, at = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
        with store.open_output_stream(at) as f:
            f.write(data)
    return path


def parsed(path: str) -> dict:
    """A GeoJSON file as Python objects (for small files and tests)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
