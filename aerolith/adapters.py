"""Driver tables as survey data. The point SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.schema import GridSpec

POINTS_SQL = """
SELECT pid, CAST(xi AS DOUBLE)*CAST(0.001 AS DOUBLE) + CAST(500000 AS DOUBLE) AS x,
       CAST(yi AS DOUBLE)*CAST(0.001 AS DOUBLE) + CAST(5200000 AS DOUBLE) AS y,
       CAST(zi AS DOUBLE)*CAST(0.001 AS DOUBLE) + CAST(200 AS DOUBLE) AS z,
       classification, return_number, intensity, red, green, blue FROM (
 SELECT *, 50000 + CAST(floor(xi/20.0) AS BIGINT) + CAST(floor(yi*3/100.0) AS BIGINT) + (q*7)%100
           + CASE WHEN classification=2 THEN 0 ELSE 2000+q*200 END AS zi FROM (
  SELECT l_orderkey*1000000000 + pk*10 + l_linenumber AS pid,
   (pk*31 + l_orderkey*7919) % 100003 AS xi,
   (l_partkey*7919 + l_orderkey*104729 + l_linenumber*1299709) % 100003 AS yi, q,
   CASE WHEN l_returnflag<>'R' THEN 2 WHEN l_linestatus='O' THEN 5 ELSE 4 END AS classification,
   1+(l_linenumber%2) AS return_number, 1000+(pk%15000) AS intensity,
   (pk*13)%65536 AS red, (pk*29+l_suppkey)%65536 AS green, (pk*7+l_partkey)%65536 AS blue
  FROM (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT) AS pk, CAST(l_quantity AS BIGINT) AS q FROM {lineitem}) t0) t1) t2
"""
CONTROL_SQL = """
SELECT CAST(s_suppkey AS VARCHAR(20)) AS point_id,
  CAST(500000 AS DOUBLE) + ((s_suppkey*977)%1000)*CAST(0.1 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS x,
  CAST(5200000 AS DOUBLE) + ((s_suppkey*613)%1000)*CAST(0.1 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS y,
  CAST(250.05 AS DOUBLE) + CAST(0.05 AS DOUBLE)*(((s_suppkey*977)%1000)*CAST(0.1 AS DOUBLE)+CAST(0.05 AS DOUBLE))
   + CAST(0.03 AS DOUBLE)*(((s_suppkey*613)%1000)*CAST(0.1 AS DOUBLE)+CAST(0.05 AS DOUBLE))
   - CASE WHEN s_suppkey%10=7 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS z,
  CASE WHEN s_suppkey%5=0 THEN 'CHECK' ELSE 'GCP' END AS point_type
FROM {supplier}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS_SQL, lineitem=_table(spark, sf_dir, "lineitem"))


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTROL_SQL, supplier=_table(spark, sf_dir, "supplier"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense raster: a row for each vector, a column for each component."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "z")).select("row", F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))


def dem_grid(spark: SparkSession, sf_dir: str) -> GridSpec:
    e = _table(spark, sf_dir, "embeddings")
    r = e.agg(F.max("vec_id"), F.max(F.size("embedding"))).first()
    return GridSpec(0.0, float(r[0] + 1), 1.0, 1.0, r[1], r[0] + 1)


def epoch_after(raster: DataFrame) -> DataFrame:
    return raster.withColumn("z", F.col("z") + ((F.col("row") * 31 + F.col("col") * 17) % 11 - 5) * F.lit(0.01))


def with_voids(raster: DataFrame) -> DataFrame:
    return raster.withColumn("z", F.when((F.col("row") * 7 + F.col("col") * 13) % 97 != 0, F.col("z")))


def strips(cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two overlapping strips of ground points, the second 0.15 m higher."""
    ground = cloud.where("classification = 2")
    return ground.where("x < 500060 AND pid % 2 = 0"), ground.where("x > 500040 AND pid % 2 = 1").withColumn("z", F.col("z") + F.lit(0.15))
