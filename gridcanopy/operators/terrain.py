"""Ground grids: mosaics, resampling, mean elevation; slope, curvature and position metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crs import Crs
from ..functions.grid import MAX_TASKS, Grid
from ..functions.lineage import ranked
from .points import bilinear
from .raster import CELL, neighbours, values, zonal

RING = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def priority(dems: DataFrame) -> DataFrame:
    """Add ``priority``: 1 for the finest cells, ties by path.  ``dems`` is a catalogue, not pixels."""
    return ranked(dems, [F.col("xres") * F.col("yres"), F.col("path")], "priority")


def reading_order(files: DataFrame, *ties: str) -> DataFrame:
    """Add ``pos``: point files from north to south, then west to east, then by ``ties``."""
    return ranked(files, [F.desc("ymax"), F.desc("ymin"), F.col("xmin"), F.col("xmax"), *map(F.col, ties)], "pos")


def resample(dem: DataFrame, grid: Grid, target: Grid, move: tuple[Crs, Crs] | None = None) -> DataFrame:
    """Bilinear values at the centres of the target's cells; ``move``: target system, source system.

    Only the target's cells within the source's extent are made; across systems all of them are, so
    callers pass a target that is cropped to the source's box in the target system.
    """
    if move is None and grid == target:
        return values(dem)
    if move is None:
        return _onto([(dem, grid, False)], target)
    spark = dem.sparkSession
    cells = target.dense(spark).withColumns({"x": target.x(), "y": target.y()})
    x, y = move[0].transform(move[1], F.col("x"), F.col("y"))
    cells = cells.withColumns({"x": x, "y": y})
    cells = cells.where(grid.extent.inside())
    return bilinear(cells, dem, grid, "value").where("value is not null").select("row", "col", "value")


def mosaic(dems: list[tuple[DataFrame, Grid]], target: Grid) -> DataFrame:
    """The first raster with a value at each target cell, in list order (finest first)."""
    return _onto([(dem, grid, grid == target) for dem, grid in dems], target)


#: Target cells of a block, and cells of a source along its sides, that a task holds, about.
BLOCK_CELLS, BLOCK_SIDE = 1 << 18, 2048


def _block_sides(grids: list[Grid], target: Grid) -> tuple[int, int]:
    """Rows and columns of blocks that are wide where a source's cells are, so that a source's cell goes to a few blocks only."""
    sides = []
    for t, sizes in ((target.yres, [g.yres for g in grids]), (target.xres, [g.xres for g in grids])):
        sides.append((max(64.0, 2 * max(sizes, default=t) / t), BLOCK_SIDE * min(sizes, default=t) / t))
    grow = math.sqrt(BLOCK_CELLS / (sides[0][0] * sides[1][0]))
    return tuple(max(1, int(min(side * grow, most))) for side, most in sides)


def _onto(rasters: list[tuple[DataFrame, Grid, bool]], target: Grid) -> DataFrame:
    """Bilinear values at the target's centres, of the first raster in the list that has one; a true flag says that a raster has the target's own cells.

    Cells of the sources go to the blocks of the target that look at them; the target's cells are made there and are not
    shuffled.  NaN is no data.
    """
    rows, cols = _block_sides([g for _, g, own in rasters if not own], target)
    e = target.extent
    grids = [(g, own) for _, g, own in rasters]

    def reach(first: Column, last: Column, n: int, side: int) -> Column:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        blocks = F.sequence(F.floor(first / side).cast("int"), F.floor(last / side).cast("int"))
        return F.when(first <= last, blocks)  # explode drops what no cell looks at

    parts = None
    for order, (raster, g, own) in enumerate(rasters):
        cells = values(raster).select(F.lit(order).alias("ord"), "row", "col", F.col("value").cast("double").alias("value"))
        if own:
            r, c = (F.col("row"), F.col("row")), (F.col("col"), F.col("col"))
        else:
            down = lambda y: (F.lit(float(e.ymax)) - y) / target.yres - 0.5
            right = lambda x: (x - F.lit(float(e.xmin))) / target.xres - 0.5
            r = F.ceil(down(g.y() + g.yres) - 1e-6), F.floor(down(g.y() - g.yres) + 1e-6)
            c = F.ceil(right(g.x() - g.xres) - 1e-6), F.floor(right(g.x() + g.xres) + 1e-6)
        part = cells.withColumn("tr", F.explode(reach(*r, target.nrow, rows))).withColumn("tc", F.explode(reach(*c, target.ncol, cols)))
        parts = part if parts is None else parts.unionByName(part)

    def mix(low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
        both = (1 - share) * low + share * high
        return np.where(np.isnan(both), np.where(np.isnan(low), high, low), both)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * rows, key[1].as_py() * cols
        row, col = np.arange(r0, min(r0 + rows, target.nrow)), np.arange(c0, min(c0 + cols, target.ncol))
        x, y = e.xmin + (col + 0.5) * target.xres, e.ymax - (row + 0.5) * target.yres
        order, r, c, v = (t[n].to_numpy() for n in ("ord", "row", "col", "value"))
        out = np.full((len(row), len(col)), np.nan)
        for k, (g, own) in enumerate(grids):
            at = order == k
            if not at.any():
                continue
            if own:
                free = np.isnan(out[r[at] - r0, c[at] - c0])
                out[r[at][free] - r0, c[at][free] - c0] = v[at][free]
                continue
            top, left = r[at].min(), c[at].min()
            h = np.full((r[at].max() - top + 3, c[at].max() - left + 3), np.nan)  # with a frame of no data
            h[r[at] - top + 1, c[at] - left + 1] = v[at]
            fx, fy = (x - g.extent.xmin - g.xres / 2) / g.xres, (g.extent.ymax - y - g.yres / 2) / g.yres
            rr, cc = np.floor(fy).astype(np.int64), np.floor(fx).astype(np.int64)
            place = lambda i, n: np.clip(i, 0, n - 1)
            up, below = place(rr - top + 1, h.shape[0]), place(rr - top + 2, h.shape[0])
            west, east = place(cc - left + 1, h.shape[1]), place(cc - left + 2, h.shape[1])
            tx, ty = (fx - cc)[None, :], (fy - rr)[:, None]
            got = mix(mix(h[np.ix_(up, west)], h[np.ix_(up, east)], tx), mix(h[np.ix_(below, west)], h[np.ix_(below, east)], tx), ty)
            got[(y < g.extent.ymin) | (y > g.extent.ymax), :] = np.nan
            got[:, (x < g.extent.xmin) | (x > g.extent.xmax)] = np.nan
            np.copyto(out, got, where=np.isnan(out))
        r, c = np.nonzero(~np.isnan(out))
        return pa.table({"row": pa.array(row[r].astype(np.int32)), "col": pa.array(col[c].astype(np.int32)), "value": pa.array(out[r, c])})

    tasks = min(MAX_TASKS, target.ncell // (16 * BLOCK_CELLS))  # by what they make, which may be much more than they get
    spread = parts.repartition(tasks, "tr", "tc") if tasks > 1 else parts
    return spread.groupBy("tr", "tc").applyInArrow(run, "row int, col int, value double")


def mean_elevation(dem: DataFrame, grid: Grid, zones: Grid) -> DataFrame:
    return zonal(dem, grid, zones, {"value": F.avg("value")})


def merge_elevation(dems: list[tuple[DataFrame, int]]) -> DataFrame:
    """Cells of overlapping per-file ground grids on one grid, the first file's value staying."""
    parts = None
    for dem, order in dems:
        part = values(dem).withColumn("ord", F.lit(order))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*CELL).agg(F.min_by("value", "ord").alias("value"))


def buffer_elevation(elevation: DataFrame, grid: Grid, dems: list[tuple[DataFrame, Grid]]) -> DataFrame:
    """Fill the cells without elevation from the ground grids, finest first."""
    return _onto([(elevation, grid, True), *((dem, g, False) for dem, g in dems)], grid)


def _complete(elevation: DataFrame, grid: Grid) -> DataFrame:
    nine = neighbours(elevation, grid, RING)
    return nine.where(" and ".join(f"v{k} is not null" for k in range(9)))


def _slope(grid: Grid) -> tuple[Column, Column]:
    """North-south (rising to the south) and east-west (rising to the west) components."""
    nw, n, ne, w, _, e, sw, s, se = (F.col(f"v{k}") for k in range(9))
    ns = ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * grid.yres)
    ew = ((nw + 2 * w + sw) - (ne + 2 * e + se)) / (8 * grid.xres)
    return ns, ew


def _curvature(grid: Grid) -> dict[str, Column]:
    nw, n, ne, w, c, e, sw, s, se = (F.col(f"v{k}") for k in range(9))
    return {
        "D": ((w + e) / 2 - c) / grid.xres**2,
        "E": ((n + s) / 2 - c) / grid.yres**2,
        "F": (ne + sw - nw - se) / (4 * grid.xres * grid.yres),
        "G": (e - w) / (2 * grid.xres),
        "H": (n - s) / (2 * grid.yres),
    }


def topo_metrics(elevation: DataFrame, grid: Grid, radians: bool = False, latitude: float | Crs = 45.0) -> DataFrame:
    """Slope, aspect, curvatures, solar radiation index and ruggedness for cells with all neighbours.

    Aspect is clockwise from north; it and the index are null on level ground, as are profile and
    plan curvature without a gradient.  ``latitude``: degrees, or the system to take each cell's from.
    """
    ns, ew = _slope(grid)
    k = _curvature(grid)
    d, e, f, g, h = (k[n] for n in "DEFGH")
    slope = F.atan(F.sqrt(ns * ns + ew * ew))
    aspect = (
        F.when((ns > 0) & (ew >= 0), F.atan(ew / F.when(ns != 0, ns)))
        .when((ns > 0) & (ew < 0), 2 * math.pi + F.atan(ew / F.when(ns != 0, ns)))
        .when(ns < 0, math.pi + F.atan(ew / F.when(ns != 0, ns)))
        .when(ew > 0, F.lit(math.pi / 2))
        .when(ew < 0, F.lit(3 * math.pi / 2))
    )
    steep = g * g + h * h
    profile = F.try_divide(-200 * (d * g * g + e * h * h + f * g * h), steep)
    plan = F.try_divide(200 * (d * h * h + e * g * g - f * g * h), steep)
    if isinstance(latitude, Crs):
        _, lat = latitude.transform(Crs(4326), grid.x(), grid.y())
        phi = F.radians(lat)
    else:
        phi = F.lit(math.radians(latitude))
    unit = (lambda c: c) if radians else F.degrees
    nine = _complete(elevation, grid).select("row", "col", *[f"v{i}" for i in range(9)], slope.alias("s"), aspect.alias("a"))
    sri = 1 + F.cos(phi) * F.cos("s") + F.sin(phi) * F.sin("s") * F.cos(math.pi - F.col("a"))
    tri = F.sqrt(sum((F.pow(F.col(f"v{i}") - F.col("v4"), F.lit(2.0)) for i in range(9) if i != 4), F.lit(0.0)))
    return nine.select(
        "row", "col", unit(F.col("s")).alias("Slope"), unit(F.col("a")).alias("Aspect"),
        (-200 * (d + e)).alias("Curvature"), profile.alias("ProfileCurvature"), plan.alias("PlanCurvature"),
        sri.alias("SolarRadiationIndex"), tri.alias("TerrainRuggedness"),
    )


def ring_offsets(grid: Grid, radius: float) -> list[tuple[int, int]]:
    """Cells within half a cell of the circle, inside the box of whole cells in the radius."""
    nx, ny, half = int(radius / grid.xres), int(radius / grid.yres), (grid.xres + grid.yres) / 2
    low, high = max(radius - half, 0.0) ** 2, (radius + half) ** 2
    return [(r, c) for r in range(-ny, ny + 1) for c in range(-nx, nx + 1) if low <= (c * grid.xres) ** 2 + (r * grid.yres) ** 2 <= high]


def position_index(elevation: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Elevation less the mean of the ring at ``radius``.

    A ring is a few runs of cells per row of offsets, so each value is sent as the difference of two
    running sums: per row of cells one window of cumulative sums, then two look-ups a run - traffic
    grows with the radius, not with its square.
    """
    runs: list[tuple[int, int, int]] = []
    for r in sorted({r for r, _ in ring_offsets(grid, radius)}):
        cols = sorted(c for rr, c in ring_offsets(grid, radius) if rr == r)
        start = prev = cols[0]
        for c in [*cols[1:], None]:
            if c is None or c != prev + 1:
                runs.append((r, start, prev))
                start = c
            prev = c
    cells = values(elevation)
    # each run's end adds the running sum up to it, its start takes off what came before
    ends = [(r, z, 1) for r, _, z in runs] + [(r, a - 1, -1) for r, a, _ in runs]
    full = grid.dense(elevation.sparkSession).join(cells, CELL, "left")
    w = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    sums = full.select("row", "col", F.sum(F.coalesce("value", F.lit(0.0))).over(w).alias("s"), F.count("value").over(w).alias("n"))
    at = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(sign).alias("sign")) for r, c, sign in ends])
    last = grid.ncol - 1
    # beyond the right edge a run ends in the last cell: that cell answers for all columns past it
    sent = sums.select("row", "col", "s", "n", F.explode(at).alias("o"))
    inner = sent.select((F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col"), "o.sign", "s", "n").where(f"col between 0 and {last}")
    past = sent.where(f"col = {last} and o.c > 0").select(
        (F.col("row") - F.col("o.r")).alias("row"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.lit(last + 1) - F.col("o.c")), F.lit(last))).alias("col"), "o.sign", "s", "n",
    )
    both = inner.unionByName(past).where(f"row between 0 and {grid.nrow - 1}")
    ring = both.groupBy(*CELL).agg(F.sum(F.col("sign") * F.col("s")).alias("s"), F.sum(F.col("sign") * F.col("n")).alias("n"))
    return cells.join(ring.where("n > 0"), CELL).select("row", "col", (F.col("value") - F.col("s") / F.col("n")).alias("value"))
