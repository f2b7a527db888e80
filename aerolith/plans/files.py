"""Registered queries that write survey data in the public file formats and read it back, and of reports.

Their SQL is that of the data before it was written: what comes back must be the same.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith import adapters
from aerolith.operators import control, quality, rectify
from aerolith.plans.registry import _RESID, _sql, DEM, GCP, PTS, oracle_sql, queries, query, raster, rounded  # noqa: F401
from aerolith.plans.storage import workspace
from aerolith.sources import crs, geotiff, las, rasters, vector

PART_POINTS = 2_000_000
_TIME = "pid % 100000 / CAST(4 AS DOUBLE)"


def _las(spark: SparkSession, d: str, point_format: int | None = None) -> DataFrame:
    """The files of the cloud with times, in four parts or in as many as hold about PART_POINTS each."""
    p = adapters.points(spark, d).withColumn("gps_time", F.expr(_TIME))
    return las.write_las(p.repartition(max(4, -(-p.count() // PART_POINTS)), "pid"), workspace(spark, "las"), 32632, point_format)


_LAS_SQL = _sql([f"pts as ({PTS})"], f"select round(x,3) x, round(y,3) y, round(z,3) z, cast(classification as int) classification, cast(return_number as int) return_number, cast(intensity as int) intensity, cast(red as int) red, cast(green as int) green, cast(blue as int) blue, {_TIME} gps_time from pts")


def _las_rows(spark: SparkSession, written: DataFrame) -> DataFrame:
    rows = las.read_las(spark, *[r["file"] for r in written.collect()], records=50_000)  # one name a file
    return rounded(rows.select("x", "y", "z", "classification", "return_number", "intensity", "red", "green", "blue", "gps_time"), 3)


@query(_LAS_SQL)
def las_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _las_rows(spark, _las(spark, d))


@query(_LAS_SQL)
def las_format_7(spark: SparkSession, d: str) -> DataFrame:
    return _las_rows(spark, _las(spark, d, 7))


@query(_sql([f"pts as ({PTS})"], "select count(*) n, 3 as point_format, 32632 as epsg, round(min(x),3) min_x, round(max(x),3) max_x, round(min(y),3) min_y, round(max(y),3) max_y, round(min(z),3) min_z, round(max(z),3) max_z from pts"))
def las_headers(spark: SparkSession, d: str) -> DataFrame:
    found = [las.bounds(r["file"]) for r in _las(spark, d).collect()]
    rows = [(b["points"], b["point_format"], b["epsg"], *b["min"], *b["max"]) for b in found]
    df = spark.createDataFrame(rows, "n long, point_format int, epsg int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    ends = [f(f"{c}{k}").alias(f"{name}_{c}") for c in "xyz" for k, f, name in ((0, F.min, "min"), (1, F.max, "max"))]
    return rounded(df.agg(F.sum("n").alias("n"), F.max("point_format").alias("point_format"), F.max("epsg").alias("epsg"), *ends), 3)


_VOID_SQL = _sql([DEM], 'select r as "row", c as col, case when (r*7+c*13)%97<>0 then z end z from dem')


@query(_VOID_SQL)
def geotiff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    path = geotiff.write_geotiff(adapters.with_voids(df), spec, f"{workspace(spark, 'tif')}.tif", dtype="f8", compression=5)
    return geotiff.read_geotiff(spark, path)[0]


@query(_VOID_SQL)
def geotiff_tiles(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    folder = workspace(spark, "tiles")
    geotiff.write_tiles(adapters.with_voids(df), spec, folder, dtype="f8", tile=256, compression=8).count()
    return geotiff.read_tiles(spark, folder)[0]


@query(_sql([DEM], "select cast(0 as double) min_x, cast(max(r)+1 as double) max_y, cast(1 as double) res_x, cast(max(c)+1 as int) width, cast(max(r)+1 as int) height, 32632 as epsg from dem"))
def geotiff_header(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    s = geotiff.read_layout(geotiff.write_geotiff(df, spec, f"{workspace(spark, 'tif')}.tif")).spec
    return spark.createDataFrame([(s.min_x, s.max_y, s.res_x, s.width, s.height, s.epsg)], "min_x double, max_y double, res_x double, width int, height int, epsg int")


@query(_sql([DEM], 'select r as "row", c as col, z from dem where r between 100 and 299 and c between 10 and 39'))
def raster_window(spark: SparkSession, d: str) -> DataFrame:
    path = rasters.write_raster(*raster(spark, d), workspace(spark, "raster"), tile=64)
    return rasters.read_raster(spark, path, (100, 10, 200, 30))[0]


_GCP_SQL = _sql([f"gcp as ({GCP})"], "select point_id, round(x,6) x, round(y,6) y, round(z,6) z, point_type from gcp")


@query(_GCP_SQL)
def control_text(spark: SparkSession, d: str) -> DataFrame:
    path = f"{workspace(spark, 'control')}.csv"
    adapters.control(spark, d).selectExpr("point_id AS id", "x AS easting", "y AS northing", "z AS elevation", "point_type AS type").coalesce(1).write.csv(path, header=True)
    return rounded(vector.read_control(spark, path))


@query(_GCP_SQL)
def control_geojson(spark: SparkSession, d: str) -> DataFrame:
    path = f"{workspace(spark, 'control')}.geojson"
    vector.write_geojson(vector.point_features(adapters.control(spark, d)), path, newline=False)
    return rounded(vector.read_control(spark, path))


@query(_GCP_SQL)
def control_shapefile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector.read_control(spark, vector.write_control(adapters.control(spark, d), f"{workspace(spark, 'control')}.shp")))


@query(_GCP_SQL)
def control_geopackage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector.read_control(spark, vector.write_control(adapters.control(spark, d), f"{workspace(spark, 'control')}.gpkg")))


@query(_GCP_SQL)
def control_in_memory(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector.read_control(spark, [tuple(r) for r in adapters.control(spark, d).collect()]))


@query(_sql([f"gcp as ({GCP})"], "select point_id id, round(x-1,6) x_min, round(y-2,6) y_min, round(x+1,6) x_max, round(y+2,6) y_max from gcp"))
def chips_file(spark: SparkSession, d: str) -> DataFrame:
    place = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    ring = F.array(place(-1, -2), place(1, -2), place(1, 2), place(-1, 2), place(-1, -2))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    features = adapters.control(spark, d).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("point_id").alias("id")).alias("properties"))).alias("value"))
    path = f"{workspace(spark, 'chips')}.geojson"
    vector.write_geojson(features, path, newline=False)
    return rounded(vector.read_chips(spark, path))


@query("select distinct s_nationkey + 1 as zone, cast(32601 + s_nationkey as int) epsg from supplier")
def crs_resolve(spark: SparkSession, d: str) -> DataFrame:
    zones = [r[0] for r in spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey") + 1).distinct().collect()]
    kinds = ("WGS 84 / UTM zone {0}N", "EPSG:{1}", "{1}")
    rows = [(z, crs.resolve(kinds[z % 3].format(z, 32600 + z))) for z in zones]
    zone = spark.read.parquet(f"{d}/supplier.parquet").schema["s_nationkey"].dataType.simpleString()
    return spark.createDataFrame(rows, "zone long, epsg int").withColumn("zone", F.col("zone").cast(zone))


_STATS = "rmse_z_m double, mean_bias_z_m double, std_dev_z_m double, accuracy_95_nssda_m double, min_delta_z_m double, max_delta_z_m double"


@query(_sql(_RESID, "select 'CLOUD' as kind, count(*) total_points, round(sqrt(avg(delta*delta)),4) rmse_z_m, round(avg(delta),4) mean_bias_z_m, round(stddev_samp(delta),4) std_dev_z_m, round(sqrt(avg(delta*delta))*CAST(1.96 AS DOUBLE),4) accuracy_95_nssda_m, round(min(delta),4) min_delta_z_m, round(max(delta),4) max_delta_z_m from rr"))
def control_report(spark: SparkSession, d: str) -> DataFrame:
    found = control.report(control.cloud_residuals(adapters.points(spark, d), adapters.control(spark, d)), "survey", "CLOUD")
    return spark.createDataFrame([json.loads(found.as_json())], f"kind string, total_points long, {_STATS}")


@query(_sql([f"pts as ({PTS})"], "select pid, round(z, 6) z from pts where z between 251 and 258"))
def pc_remediated(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.points(spark, d)
    return rounded(quality.remediate(p, quality.inspect(p, epsg=32632), low=251.0, high=258.0).select("pid", "z"))


@query(_sql([f"pts as ({PTS})"], "select 'LAS_CRS_MISSING' code, 'assign_crs' parameter, '25833' as \"value\" where (select count(*) from pts) > 0"))
def qc_suggestions(spark: SparkSession, d: str) -> DataFrame:
    audit = quality.inspect(adapters.points(spark, d), epsg=None, expected=25833)
    rows = [(i.code, k, str(v)) for i in audit.issues if i.code == "LAS_CRS_MISSING" for k, v in i.suggested.items()]
    return spark.createDataFrame(rows, "code string, parameter string, value string")


@query(
    _sql(
        [DEM, "m as (select avg(c) x0, avg(r) y0, avg(z) z0 from dem)", "s as (select sum((c-x0)*(c-x0)) xx, sum((c-x0)*(r-y0)) xy, sum((r-y0)*(r-y0)) yy, sum((c-x0)*z) xz, sum((r-y0)*z) yz from dem, m)"],
        "select 'constant' term, round(z0,6)+0 coefficient from m union all select 'col', round((xz*yy-yz*xy)/(xx*yy-xy*xy),6)+0 from s union all select 'row', round((yz*xx-xz*xy)/(xx*yy-xy*xy),6)+0 from s",
    )
)
def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    coefficients, _ = rectify.fit_plane(adapters.dem(spark, d), 1)
    return rounded(spark.createDataFrame(list(zip(("constant", "col", "row"), coefficients, strict=True)), "term string, coefficient double"))
