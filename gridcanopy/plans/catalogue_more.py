"""Registered queries over boxes, headers, older point formats and steps of a caller's own; :mod:`catalogue` loads them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.lineage import shared_root
from ..operators.ground import overlapping, raster_catalogue
from ..sources.las import read_points, write_las_files
from ..sources.rasters import write_tiles
from . import adapter, lifecycle
from .catalogue import query
from .config import RunConfig


@query("files_overlap", """SELECT a.file_id AS a, b.file_id AS b FROM files a JOIN files b ON a.file_id < b.file_id
    WHERE greatest(a.xmin, b.xmin) < least(a.xmax, b.xmax) AND greatest(a.ymin, b.ymin) < least(a.ymax, b.ymax)""")
def _files_overlap(s, d):
    """Pairs of files whose boxes share area."""
    f = adapter.files(s, d)
    return overlapping(f.withColumnRenamed("file_id", "a"), f.withColumnRenamed("file_id", "b"), Grid.from_resolution(adapter.extent(s, d).buffer(20.0), 10.0), "a", "b").where("a < b")


@query("cell_extents", "SELECT DISTINCT row, col, x0 + col AS xmin, x0 + col + 1 AS xmax, y1 - row - 1 AS ymin, y1 - row AS ymax FROM f")
def _cell_extents(s, d):
    """The boxes of the fine cells that hold points."""
    g = adapter.grid(s, d, 1)
    cells = g.with_cells(adapter.heights(s, d)).select("row", "col").distinct()
    return cells.select("row", "col", *[c.alias(n) for n, c in g.box().items()])


@query("blocks_with_values", "SELECT DISTINCT CAST(row // 16 AS INTEGER) AS tr, CAST(col // 16 AS INTEGER) AS tc, true AS has_value FROM dem")
def _blocks(s, d):
    """Blocks of the ground that have any value."""
    at = adapter.dem(s, d).select(F.expr("cast(row div 16 as int)").alias("tr"), F.expr("cast(col div 16 as int)").alias("tc"), "value")
    return at.groupBy("tr", "tc").agg(F.bool_or(F.col("value").isNotNull()).alias("has_value"))


@query("raster_headers", """, t AS (SELECT DISTINCT row // 16 AS tr, col // 16 AS tc FROM dem)
    SELECT CAST(least(16, nrow - 16 * tr) AS INTEGER) AS nrow, CAST(least(16, 40 - 16 * tc) AS INTEGER) AS ncol, round(x0 + 16 * tc * xr, 6) AS xmin, round(y1 - 16 * tr * yr, 6) AS ymax FROM t, dg""")
def _raster_headers(s, d):
    """Ground tiles written as files, and what their headers say."""
    folder = f"{shared_root(s)}/tif-{uuid.uuid4().hex}"
    write_tiles(adapter.dem(s, d), adapter.dem_grid(s, d), folder, tile=16).write.format("noop").mode("overwrite").save()
    return raster_catalogue(s, [folder]).select("nrow", "ncol", "xmin", "ymax")


@query("las_scan_old", """SELECT return_number, least(number_of_returns, 7) AS number_of_returns, classification, withheld, count(*) AS n, sum(z) AS sz, round(sum(round(scan_angle)), 2) AS sa
    FROM pts GROUP BY ALL""")
def _las_old(s, d):
    """The points in the older format, whose returns, classes and flags share bytes, and scanned back."""
    folder = f"{shared_root(s)}/las-{uuid.uuid4().hex}"
    pts = adapter.points(s, d).withColumns({"number_of_returns": F.least("number_of_returns", F.lit(7)), "scan_angle": F.round("scan_angle").cast("int")})
    write_las_files(pts, folder, point_format=1).write.format("noop").mode("overwrite").save()
    got = read_points(s, folder).groupBy("return_number", "number_of_returns", "classification", "withheld")
    out = got.agg(F.count("*").alias("n"), F.sum("z").alias("sz"), F.round(F.sum("scan_angle"), 2).alias("sa"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("return_number", "number_of_returns", "classification")})


@query("run_added_steps", """SELECT row, col, count(*) AS n, max(intensity) AS brightest, round(avg(z) FILTER (z >= 2), 6) AS mean FROM m WHERE intensity >= 300 GROUP BY row, col""")
def _added(s, d):
    """A run over the points with a filter and a metric of the caller's own."""
    lifecycle.register_filter("bright", lambda c: F.col("intensity") >= 300)
    lifecycle.register_metric("Brightest", lambda c: F.max("intensity"))
    try:
        config = RunConfig(classes="~7,9,18", max_scan_angle=30.0, dem_algo="none", first_returns=False, do_strata=False)
        run = lifecycle.Run(s, config, adapter.points(s, d), None, adapter.grid(s, d, 10))
        made = lifecycle.point_products(run)["point_metrics"]
    finally:
        del lifecycle.FILTERS["bright"], lifecycle.METRICS["Brightest"]
    return made.select("row", "col", F.col("TotalReturnCount").alias("n"), F.col("Brightest").alias("brightest"), F.col("Mean_CanopyHeight").alias("mean"))
