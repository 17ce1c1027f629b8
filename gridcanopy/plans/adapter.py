"""The driver's tables seen as lidar: lineitem as points, part as ground, orders and suppliers as files."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Extent, Grid
from ..operators.points import PointFilter

FILTER = PointFilter(classes="~7,9,18", max_scan_angle=30.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pid, lno, file_id, x, y, z, intensity, return_number, number_of_returns, classification, ...)``."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey")
    return li.select(
        key.alias("pid"),
        F.col("l_linenumber").alias("lno"),
        (key % 10).cast("int").alias("file_id"),
        (F.col("l_partkey") * F.lit(0.05)).alias("x"),
        (F.col("l_suppkey") + F.lit(0.5)).alias("y"),
        F.col("l_quantity").alias("z"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("intensity"),
        F.col("l_linenumber").alias("return_number"),
        (F.col("l_linenumber") + key % 3).cast("int").alias("number_of_returns"),
        (key % 20).cast("int").alias("classification"),
        ((F.col("l_discount") * 100 - 5) * 8).alias("scan_angle"),
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)).alias("withheld"),
    )


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FILTER.apply(points(spark, sf_dir), F.col("z").between(-8.0, 100.0))


def kept() -> Column:
    """Whether a point is one of :func:`heights`."""
    classes = ~F.col("classification").isin(7, 9, 18)
    return ~F.col("withheld") & classes & (F.abs("scan_angle") <= 30.0) & F.col("z").between(-8.0, 100.0)


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground of 40 columns; a part in eleven has no data."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.where(F.col("p_size") % 11 != 0).select(
        F.expr("cast(p_partkey div 40 as int)").alias("row"),
        (F.col("p_partkey") % 40).cast("int").alias("col"),
        (F.col("p_retailprice") / 10).alias("value"),
    )


@lru_cache(maxsize=64)
def _bounds(spark: SparkSession, sf_dir: str) -> tuple:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    b = li.agg(F.min("l_partkey"), F.max("l_partkey"), F.min("l_suppkey"), F.max("l_suppkey")).first()
    n = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()
    return (*b, *n)


def extent(spark: SparkSession, sf_dir: str) -> Extent:
    """Bounds of the points, grown to tens of metres as a file catalogue would give them."""
    x0, x1, y0, y1, _ = _bounds(spark, sf_dir)
    raw = Extent(x0 * 0.05, x1 * 0.05, y0 + 0.5, y1 + 0.5)
    return Grid.from_resolution(raw, 10.0).extent


def grid(spark: SparkSession, sf_dir: str, size: float) -> Grid:
    return Grid.from_resolution(extent(spark, sf_dir), size)


def dem_grid(spark: SparkSession, sf_dir: str) -> Grid:
    last = _bounds(spark, sf_dir)[4]
    return Grid(extent(spark, sf_dir), last // 40 + 1, 40)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header box per file: ``(file_id, xmin, xmax, ymin, ymax, n, epsg, z_unit)``."""
    boxes = points(spark, sf_dir).groupBy("file_id").agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.count("*").alias("n")
    )
    inset = F.col("file_id") * 2.0
    return boxes.select(
        "file_id", (F.col("xmin") + inset).alias("xmin"), F.greatest(F.col("xmax") - inset, F.col("xmin") + inset).alias("xmax"),
        "ymin", "ymax", "n", (F.lit(32610) + F.col("file_id") % 2).alias("epsg"), F.when(F.col("file_id") % 3 == 0, "foot").otherwise("metre").alias("z_unit"),
    )


# The same views for an independent SQL engine.
SQL = """
WITH RECURSIVE lim AS (
  SELECT floor(min(l_partkey * CAST(0.05 AS DOUBLE)) / 10) * 10 AS x0, ceil(max(l_partkey * CAST(0.05 AS DOUBLE)) / 10) * 10 AS x1,
         floor(min(l_suppkey + CAST(0.5 AS DOUBLE)) / 10) * 10 AS y0, ceil(max(l_suppkey + CAST(0.5 AS DOUBLE)) / 10) * 10 AS y1
  FROM lineitem),
pts AS (
  SELECT l_orderkey AS pid, l_linenumber AS lno, CAST(l_orderkey % 10 AS INTEGER) AS file_id,
         l_partkey * CAST(0.05 AS DOUBLE) AS x, l_suppkey + CAST(0.5 AS DOUBLE) AS y, l_quantity AS z,
         CAST(floor(l_extendedprice / 100) AS BIGINT) AS intensity, l_linenumber AS return_number,
         CAST(l_linenumber + l_orderkey % 3 AS INTEGER) AS number_of_returns, CAST(l_orderkey % 20 AS INTEGER) AS classification,
         (l_discount * 100 - 5) * 8 AS scan_angle, (l_returnflag = 'R' AND l_tax > CAST(0.07 AS DOUBLE)) AS withheld
  FROM lineitem),
hp AS (
  SELECT * FROM pts WHERE NOT withheld AND classification NOT IN (7, 9, 18) AND abs(scan_angle) <= 30 AND z BETWEEN -8 AND 100),
m AS (
  SELECT *, CAST(least(floor((y1 - y) / 10), (y1 - y0) / 10 - 1) AS INTEGER) AS row, CAST(least(floor((x - x0) / 10), (x1 - x0) / 10 - 1) AS INTEGER) AS col
  FROM hp, lim),
f AS (
  SELECT *, CAST(least(floor(y1 - y), y1 - y0 - 1) AS INTEGER) AS row, CAST(least(floor(x - x0), x1 - x0 - 1) AS INTEGER) AS col
  FROM hp, lim),
csm AS (SELECT row, col, max(z) AS value FROM f GROUP BY row, col),
dem AS (
  SELECT CAST(p_partkey // 40 AS INTEGER) AS row, CAST(p_partkey % 40 AS INTEGER) AS col, p_retailprice / 10 AS value
  FROM part WHERE p_size % 11 <> 0),
dg AS (SELECT x0, x1, y0, y1, CAST(n AS INTEGER) AS nrow, (x1 - x0) / 40 AS xr, (y1 - y0) / n AS yr FROM lim, (SELECT max(p_partkey) // 40 + 1 AS n FROM part)),
files AS (
  SELECT file_id, xmin + file_id * 2.0::DOUBLE AS xmin, greatest(xmax - file_id * 2.0::DOUBLE, xmin + file_id * 2.0::DOUBLE) AS xmax, ymin, ymax, n,
         32610 + file_id % 2 AS epsg, CASE WHEN file_id % 3 = 0 THEN 'foot' ELSE 'metre' END AS z_unit
  FROM (SELECT file_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, count(*) AS n FROM pts GROUP BY file_id))
"""
