"""Ground from any number of raster files, in any systems: one plan, one scan, one join.

Files are a catalogue, their cells one table keyed by file.  Target cells meet the files whose boxes hold them
through the cells of the target that each box covers; the four source cells about a place come from one
equi-join on file and crossing; of several files the first in order of priority counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import Crs
from ..functions.grid import Extent, Grid
from ..functions.lineage import materialize
from ..functions.units import LinearUnit
from ..sources.files import find_files
from ..sources.rasters import SIDE_FILES, raster_crs, raster_grid, read_rows
from .points import crossings, four_cells

CATALOGUE = "path string, nrow int, ncol int, xmin double, xmax double, ymin double, ymax double, crs_key string, crs_text string"
#: Rows of a file that one task reads, and systems that files may be in at most: each is a branch of an expression.
ROWS_PER_TASK, MAX_SYSTEMS = 512, 256
#: Buckets along a side of a box at most, where boxes meet.
BUCKETS_A_SIDE = 16
#: Points along an edge of a box that is moved to another system.
EDGE_STEPS = 20


def raster_catalogue(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row a raster file, from headers that executors read; files that are no rasters are left out."""
    found = find_files(paths, (".asc", ".tif", ".tiff"), SIDE_FILES)
    if not found:
        return spark.createDataFrame([], CATALOGUE)
    names = spark.createDataFrame([(f,) for f in found], "path string").repartition(len(found) // 64 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.string()]
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    g, crs = raster_grid(path), raster_crs(path)
                except (ValueError, KeyError, OSError):
                    continue
                e = g.extent
                rows.append((path, g.nrow, g.ncol, e.xmin, e.xmax, e.ymin, e.ymax, crs.key, crs.to_wkt() or (str(crs.epsg) if crs.epsg else "")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[p.split()[0] for p in CATALOGUE.split(", ")])

    return names.mapInArrow(run, CATALOGUE)


def overlapping(a: DataFrame, b: DataFrame, buckets: Grid, a_id: str, b_id: str) -> DataFrame:
    """``(a_id, b_id)`` of boxes ``(xmin, xmax, ymin, ymax)`` that share area.

    Buckets come in levels, each of twice the side of the one before.  A box has the level at which it spans
    ``BUCKETS_A_SIDE`` buckets at most, and goes to the buckets it covers at that level and at all coarser ones that
    boxes have; a pair meets at the higher level of its two, and is reported in the one bucket that holds the upper left
    corner of what it shares.  So a box makes some hundred rows at most, whatever its size.  Boxes that reach
    over the buckets' extent are cut to it.
    """
    e = buckets.extent
    top_level = max(0, math.ceil(math.log2(max(buckets.nrow, buckets.ncol))))
    size = lambda level: (F.lit(buckets.xres) * F.pow(F.lit(2.0), level), F.lit(buckets.yres) * F.pow(F.lit(2.0), level))
    x0, x1, y0, y1 = (F.lit(float(v)) for v in (e.xmin, e.xmax, e.ymin, e.ymax))

    def cut(boxes: DataFrame, name: str, p: str) -> DataFrame:
        """Boxes within the extent, with their level."""
        sides = boxes.select(name, F.greatest("xmin", x0).alias(f"{p}x0"), F.least("xmax", x1).alias(f"{p}x1"), F.greatest("ymin", y0).alias(f"{p}y0"), F.least("ymax", y1).alias(f"{p}y1"))
        sides = sides.where(f"{p}x0 < {p}x1 and {p}y0 < {p}y1")
        spans = F.greatest((F.col(f"{p}x1") - F.col(f"{p}x0")) / buckets.xres, (F.col(f"{p}y1") - F.col(f"{p}y0")) / buckets.yres)
        level = F.least(F.lit(top_level), F.greatest(F.lit(0), F.ceil(F.log2(spans / BUCKETS_A_SIDE)))).cast("int")
        return sides.withColumn(f"{p}level", level)

    left, right = cut(a, a_id, "a_"), cut(b, b_id, "b_")
    used = left.select("a_level").union(right.select("b_level")).agg(F.sort_array(F.collect_set("a_level")).alias("used"))  # of some 30 levels

    def dealt(boxes: DataFrame, p: str) -> DataFrame:
        """A row for each bucket that a box covers at its own and coarser levels."""
        at = boxes.join(F.broadcast(used)).withColumn("level", F.explode(F.filter("used", lambda k: k >= F.col(f"{p}level"))))
        w, h = size(F.col("level"))
        first = lambda v, d: F.floor(v / d).cast("int")
        at = at.withColumn("col", F.explode(F.sequence(first(F.col(f"{p}x0") - x0, w), first(F.col(f"{p}x1") - x0, w))))
        return at.withColumn("row", F.explode(F.sequence(first(y1 - F.col(f"{p}y1"), h), first(y1 - F.col(f"{p}y0"), h)))).drop("used")

    x, top = F.greatest("a_x0", "b_x0"), F.least("a_y1", "b_y1")
    share = (x < F.least("a_x1", "b_x1")) & (top > F.greatest("a_y0", "b_y0"))
    w, h = size(F.col("level"))
    here = (F.floor((x - x0) / w).cast("int") == F.col("col")) & (F.floor((y1 - top) / h).cast("int") == F.col("row"))
    highest = F.col("level") == F.greatest("a_level", "b_level")
    return dealt(left, "a_").join(dealt(right, "b_"), ["level", "row", "col"]).where(highest & share & here).select(a_id, b_id)


def moved_boxes(files: DataFrame, systems: list[Crs], to: Crs) -> DataFrame:
    """Add ``bxmin, bxmax, bymin, bymax``: each file's box in another system, around points along its edges.

    ``system`` is the place of a file's system in ``systems``.
    """
    along = F.transform(F.sequence(F.lit(0), F.lit(EDGE_STEPS)), lambda k: k / float(EDGE_STEPS))
    dx, dy = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    sides = [
        F.transform(along, lambda t: point(F.col("xmin") + t * dx, F.col("ymin"))), F.transform(along, lambda t: point(F.col("xmin") + t * dx, F.col("ymax"))),
        F.transform(along, lambda t: point(F.col("xmin"), F.col("ymin") + t * dy)), F.transform(along, lambda t: point(F.col("xmax"), F.col("ymin") + t * dy)),
    ]
    edge = files.select("path", "system", F.explode(F.concat(*sides)).alias("p"))
    x, y = between(systems, to, F.col("p.x"), F.col("p.y"))
    edge = edge.select("path", x.alias("x"), y.alias("y")).groupBy("path")
    boxes = edge.agg(F.min("x").alias("bxmin"), F.max("x").alias("bxmax"), F.min("y").alias("bymin"), F.max("y").alias("bymax"))
    return files.join(boxes, "path")


def between(systems: list[Crs], to: Crs, x: Column, y: Column, back: bool = False) -> tuple[Column, Column]:
    """``x`` and ``y`` from the system numbered ``system`` into ``to``, or the other way."""
    ox, oy = x, y
    for k, crs in enumerate(systems):
        mx, my = to.transform(crs, x, y) if back else crs.transform(to, x, y)
        ox, oy = F.when(F.col("system") == k, mx).otherwise(ox), F.when(F.col("system") == k, my).otherwise(oy)
    return ox, oy


@dataclass
class Ground:
    """Files in order of priority (``fid``) with their boxes in the run's system, and all their cells."""

    files: DataFrame
    cells: DataFrame
    systems: list[Crs]
    to: Crs
    xres: float
    yres: float
    origin: tuple[float, float]

    @classmethod
    def open(cls, spark: SparkSession, paths: list[str], to: Crs, window: Extent, crs: Crs | None = None, z_unit: LinearUnit | None = None, unsaid: LinearUnit = LinearUnit(), points: DataFrame | None = None) -> Ground | None:
        """The files that touch ``window`` (in ``to``); None if none does.

        ``crs`` and ``z_unit`` stand for what files say, ``unsaid`` for units of heights that they do not say.  With ``points``, a catalogue of point files in ``to``,
        only ground that overlaps one of their boxes, grown by the window's margin, is taken.
        Finest cells come first, then paths.
        """
        found = raster_catalogue(spark, paths)
        said = {r["crs_key"]: r["crs_text"] for r in found.select("crs_key", "crs_text").distinct().limit(MAX_SYSTEMS + 1).collect()}
        if len(said) > MAX_SYSTEMS:
            raise ValueError(f"ground files are in over {MAX_SYSTEMS} coordinate systems")
        keys = sorted(said)
        systems = [crs if crs is not None and crs.known else Crs.parse(said[k]) for k in keys]
        stated = z_unit if z_unit is not None and z_unit.metres else None
        systems = [replace(s, z_unit=stated or (s.z_unit if s.z_unit.metres else unsaid)) for s in systems]
        number = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("crs_key")).cast("int") - 1 if keys else F.lit(0)
        placed = moved_boxes(found.withColumn("system", number), systems, to)
        touch = (F.col("bxmax") > window.xmin) & (F.col("bxmin") < window.xmax) & (F.col("bymax") > window.ymin) & (F.col("bymin") < window.ymax)
        area = (F.col("bxmax") - F.col("bxmin")) * (F.col("bymax") - F.col("bymin")) / (F.col("nrow").cast("double") * F.col("ncol"))
        kept = placed.where(touch).withColumn("area", area)
        if points is not None:
            reach = Grid(window, 64, 64)
            boxes = kept.select("path", F.col("bxmin").alias("xmin"), F.col("bxmax").alias("xmax"), F.col("bymin").alias("ymin"), F.col("bymax").alias("ymax"))
            near = overlapping(boxes, points, reach, "path", "file").select("path").distinct()
            kept = kept.join(near, "path", "left_semi")
        files = materialize(kept.orderBy("area", "path").withColumn("fid", F.monotonically_increasing_id()))
        first = files.orderBy("fid").limit(1).collect()
        if not first:
            return None
        f = first[0]
        if systems[f["system"]].same_place(to):
            g = Grid(Extent(f["xmin"], f["xmax"], f["ymin"], f["ymax"]), f["nrow"], f["ncol"])
            size, origin = (g.xres, g.yres), g.origin
        else:
            size, origin = ((f["bxmax"] - f["bxmin"]) / f["ncol"], (f["bymax"] - f["bymin"]) / f["nrow"]), (0.0, 0.0)
        return cls(files, _scan(files, systems, to, window), systems, to, *size, origin)

    @classmethod
    def of_rasters(cls, spark: SparkSession, rasters: list[tuple[DataFrame, Grid]], to: Crs = Crs()) -> Ground:
        """Ground tables that are there already, in the run's system, each with its grid."""
        ordered = sorted(rasters, key=lambda d: d[1].xres * d[1].yres)
        rows, cells = [], None
        for k, (df, g) in enumerate(ordered):
            e = g.extent
            rows.append((k, 0, g.nrow, g.ncol, *(float(v) for v in (e.xmin, e.xmax, e.ymin, e.ymax, e.xmin, e.xmax, e.ymin, e.ymax))))
            part = df.where("value is not null").select(F.lit(k).cast("long").alias("fid"), "row", "col", F.col("value").cast("double").alias("value"))
            cells = part if cells is None else cells.unionByName(part)
        files = spark.createDataFrame(rows, "fid long, system int, nrow int, ncol int, xmin double, xmax double, ymin double, ymax double, bxmin double, bxmax double, bymin double, bymax double")
        g = ordered[0][1]
        return cls(files, cells, [to], to, g.xres, g.yres, g.origin)

    def on(self, target: Grid) -> DataFrame:
        """``(row, col, value)``: bilinear ground at the centres of a grid's cells, by the first file that has one."""
        own = [F.col(c).alias(f"f_{c}") for c in ("xmin", "xmax", "ymin", "ymax")]
        files = self.files.select("fid", "system", "nrow", "ncol", *own, *[F.col(f"b{c}").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])
        at = target.covered(files, "out").drop("xmin", "xmax", "ymin", "ymax")
        x, y = between(self.systems, self.to, target.x(), target.y(), back=True)
        at = at.withColumns({"x": x, "y": y}).where("x between f_xmin and f_xmax and y between f_ymin and f_ymax")
        xres, yres = (F.col("f_xmax") - F.col("f_xmin")) / F.col("ncol"), (F.col("f_ymax") - F.col("f_ymin")) / F.col("nrow")
        at = at.withColumns({"_fx": (F.col("x") - F.col("f_xmin")) / xres - 0.5, "_fy": (F.col("f_ymax") - F.col("y")) / yres - 0.5})
        at = at.select("fid", "row", "col", "_fx", "_fy", F.floor("_fx").cast("int").alias("_c"), F.floor("_fy").cast("int").alias("_r"))
        s = crossings(self.cells, ("fid",))
        value = four_cells(F.col("_fx") - F.col("_c"), F.col("_fy") - F.col("_r"))
        found = at.join(s, ["fid", "_r", "_c"]).select("row", "col", "fid", value.alias("value")).where("value is not null")
        return found.groupBy("row", "col").agg(F.min_by("value", "fid").alias("value"))

    def grid(self, extent: Extent) -> Grid:
        """The finest file's cells over an extent."""
        return Grid.from_resolution(extent, self.xres, self.yres, *self.origin)


def _scan(files: DataFrame, systems: list[Crs], to: Crs, window: Extent) -> DataFrame:
    """``(fid, row, col, value)``: the cells of all files near the window, values in the unit of ``to``.

    A task reads runs of ``ROWS_PER_TASK`` rows, of an ASCII grid the whole file once.
    """
    spark = files.sparkSession
    rows = []
    for k, crs in enumerate(systems):
        rows.append((k, *_moved(spark, window, to, crs), crs.z_unit.factor_to(to.z_unit)))
    near = spark.createDataFrame(rows, "system int, wx0 double, wx1 double, wy0 double, wy1 double, factor double")
    xres, yres = (F.col("xmax") - F.col("xmin")) / F.col("ncol"), (F.col("ymax") - F.col("ymin")) / F.col("nrow")
    clip = lambda c, n: F.greatest(F.lit(0), F.least(c, F.col(n) - 1)).cast("int")
    windowed = files.join(F.broadcast(near), "system").select(  # a row a system
        "fid", "path", "factor",
        clip(F.floor((F.col("ymax") - F.col("wy1")) / yres) - 1, "nrow").alias("r0"), clip(F.floor((F.col("ymax") - F.col("wy0")) / yres) + 1, "nrow").alias("r1"),
        clip(F.floor((F.col("wx0") - F.col("xmin")) / xres) - 1, "ncol").alias("c0"), clip(F.floor((F.col("wx1") - F.col("xmin")) / xres) + 1, "ncol").alias("c1"),
    )
    step = F.when(F.lower("path").endswith(".asc"), F.greatest(F.col("r1") - F.col("r0") + 1, F.lit(1))).otherwise(F.lit(ROWS_PER_TASK))
    runs = windowed.withColumn("a", F.explode(F.sequence(F.col("r0"), F.col("r1"), step))).withColumn("z", F.least(F.col("a") + step - 1, "r1"))
    tasks = materialize(runs.select("fid", "path", "factor", "a", "z", "c0", "c1"))
    n = tasks.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                v = read_rows(t["path"], t["a"], t["z"])[1][:, t["c0"] : t["c1"] + 1] * t["factor"]
                r, c = np.nonzero(~np.isnan(v))
                fid = pa.array(np.full(len(r), t["fid"], np.int64))
                yield pa.RecordBatch.from_arrays([fid, pa.array((r + t["a"]).astype(np.int32)), pa.array((c + t["c0"]).astype(np.int32)), pa.array(v[r, c])], names=["fid", "row", "col", "value"])

    return tasks.repartition(max(1, n), "fid", "a").mapInArrow(run, "fid long, row int, col int, value double")


def _moved(spark: SparkSession, window: Extent, source: Crs, to: Crs) -> tuple[float, float, float, float]:
    """The box around a window's edges in another system."""
    if not source.known or not to.known or source.same_place(to):
        return window.xmin, window.xmax, window.ymin, window.ymax
    c = window.corners()
    edge = [(p[0] + (q[0] - p[0]) * k / EDGE_STEPS, p[1] + (q[1] - p[1]) * k / EDGE_STEPS) for p, q in zip(c, [*c[1:], c[0]]) for k in range(EDGE_STEPS)]
    x, y = source.transform(to, F.col("x"), F.col("y"))
    moved = spark.createDataFrame([tuple(map(float, p)) for p in edge], "x double, y double").select(x.alias("x"), y.alias("y"))
    r = moved.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return tuple(r)


def moved_extent(spark: SparkSession, extent: Extent, source: Crs, to: Crs) -> Extent:
    return Extent(*_moved(spark, extent, source, to))
