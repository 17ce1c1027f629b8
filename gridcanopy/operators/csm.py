"""The canopy surface: highest point per fine cell, smoothing, hole filling, zonal summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .raster import CELL, ZONAL, in_blocks, neighbours, shifted, values, zonal


def footprint(diameter: float) -> list[tuple[float, float, float]]:
    """``(dx, dy, dz)`` of the nine samples of a pulse: the centre wins ties, then the four sides."""
    r = diameter / 2
    if r <= 0:
        return [(0.0, 0.0, 0.0)]
    d = r / math.sqrt(2)
    sides = [(r, 0.0), (-r, 0.0), (0.0, r), (0.0, -r)]
    return [(0.0, 0.0, 0.0), *[(x, y, -1e-6) for x, y in sides], *[(x, y, -2e-6) for x in (d, -d) for y in (d, -d)]]


def max_points(points: DataFrame, grid: Grid, diameter: float = 0.4) -> DataFrame:
    """Highest ``z`` per cell over all files at once, each point spread over its footprint."""
    samples = footprint(diameter)
    if len(samples) > 1:
        at = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in samples])
        points = points.select("x", "y", "z", F.explode(at).alias("o")).select(
            (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("z") + F.col("o.dz")).alias("z")
        )
    return grid.with_cells(points).groupBy(*CELL).agg(F.max("z").alias("value"))


def smooth(csm: DataFrame, grid: Grid, window: int = 3) -> DataFrame:
    """Mean of the values in the window, for cells that have one; windows under 3 change nothing."""
    if window < 3:
        return values(csm)
    if window % 2 == 0:
        raise ValueError("a window is an odd number of cells")
    half = window // 2
    return _in_blocks(csm, grid, half, lambda h, row, col, pad: np.where(np.isnan(h[pad:-pad, pad:-pad]), np.nan, _window_mean(h, pad, half)))


DIRECTIONS = ((0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1))


def fill(csm: DataFrame, grid: Grid, needed: int = 6, distance: float = 5.0) -> DataFrame:
    """Values for empty cells that see data or the edge in ``needed`` of eight directions.

    Sight ends after ``distance`` cells (diagonally that over the root of two, rounded down); the
    value is the mean of the first value in each direction, weighted by inverse distance.  A cell
    that sees edges only stays empty.
    """
    straight = int(distance)
    return _in_blocks(csm, grid, max(1, straight), lambda h, row, col, pad: _filled(h, row, col, pad, grid, needed, straight, int(distance / math.sqrt(2))))


def smooth_and_fill(csm: DataFrame, grid: Grid, window: int = 3, needed: int = 6, distance: float = 5.0) -> DataFrame:
    """Smoothed where there was data, filled elsewhere, both from the original values, in one pass over blocks."""
    if window > 1 and window % 2 == 0:
        raise ValueError("a window is an odd number of cells")
    straight, half = int(distance), window // 2 if window >= 3 else 0

    def both(h: np.ndarray, row: np.ndarray, col: np.ndarray, pad: int) -> np.ndarray:
        filled = _filled(h, row, col, pad, grid, needed, straight, int(distance / math.sqrt(2)))
        own = h[pad:-pad, pad:-pad]
        return np.where(np.isnan(own), filled, _window_mean(h, pad, half))

    return _in_blocks(csm, grid, max(1, straight, half), both)


def _in_blocks(csm: DataFrame, grid: Grid, pad: int, kernel) -> DataFrame:
    """``(row, col, value)`` of a kernel over blocks (:func:`in_blocks`) that gives a value or NaN for each cell."""

    def run(h: np.ndarray, row: np.ndarray, col: np.ndarray, pad: int) -> pa.Table:
        out = kernel(h, row, col, pad)
        r, c = np.nonzero(~np.isnan(out))
        return pa.table({"row": pa.array(row[r].astype(np.int32)), "col": pa.array(col[c].astype(np.int32)), "value": pa.array(out[r, c])})

    return in_blocks(csm, grid, pad, run, "row int, col int, value double")


def _window_mean(h: np.ndarray, pad: int, half: int) -> np.ndarray:
    total = np.zeros((h.shape[0] - 2 * pad, h.shape[1] - 2 * pad))
    n = np.zeros(total.shape)
    for dr in range(-half, half + 1):
        for dc in range(-half, half + 1):
            v = shifted(h, pad, dr, dc)
            there = ~np.isnan(v)
            np.add(total, v, out=total, where=there)
            n += there
    return np.divide(total, n, out=np.full(total.shape, np.nan), where=n > 0)


def _filled(h: np.ndarray, row: np.ndarray, col: np.ndarray, pad: int, grid: Grid, needed: int, straight: int, diagonal: int) -> np.ndarray:
    """What :func:`fill` gives the empty cells of a block, NaN elsewhere."""
    empty = np.isnan(h[pad:-pad, pad:-pad])
    hits, top, bottom = np.zeros(empty.shape, int), np.zeros(empty.shape), np.zeros(empty.shape)
    for k, (dr, dc) in enumerate(DIRECTIONS):
        reach = diagonal if k >= 4 else straight
        first, far = np.full(empty.shape, np.nan), np.ones(empty.shape)
        for d in range(reach, 0, -1):  # the nearest is written last
            v = shifted(h, pad, dr * d, dc * d)
            there = ~np.isnan(v)
            np.copyto(first, v, where=there)
            np.copyto(far, d, where=there)
        edge = np.zeros(empty.shape, bool)
        if dr:
            edge |= ((grid.nrow - 1 - row if dr > 0 else row) < reach)[:, None]
        if dc:
            edge |= ((grid.ncol - 1 - col if dc > 0 else col) < reach)[None, :]
        seen = ~np.isnan(first)
        weight = far * (math.sqrt(2) if k >= 4 else 1.0)
        hits += seen | edge
        top += np.where(seen, first / weight, 0.0)
        bottom += np.where(seen, 1 / weight, 0.0)
    good = empty & (hits >= needed) & (bottom > 0)
    return np.divide(top, bottom, out=np.full(empty.shape, np.nan), where=good)


def unchanged(csm: DataFrame, grid: Grid) -> DataFrame:
    return values(csm)


def rumple(csm: DataFrame, grid: Grid, zones: Grid, compat: bool = False) -> DataFrame:
    """Mean ratio of surface to ground area over the triangles between cell centres and crossings.

    A crossing and the four triangles about it belong to the zone of its lower right cell, if all
    four cells lie in that zone.  ``compat`` gives root two on flat ground, otherwise it is one.
    """
    four = neighbours(csm, grid, [(0, 0), (0, -1), (-1, 0), (-1, -1)])
    zr, zc = zones.row(grid.y()), zones.col(grid.x())
    up, left = zones.row(grid.y(F.col("row") - 1)), zones.col(grid.x(F.col("col") - 1))
    four = four.where((F.col("row") > 0) & (F.col("col") > 0)).select("*", zr.alias("zr"), zc.alias("zc")).where((up == F.col("zr")) & (left == F.col("zc")))
    lr, ll, ur, ul = (F.col(f"v{k}") for k in range(4))
    count, total = F.lit(0), F.lit(0.0)
    for v in (lr, ll, ur, ul):
        count, total = count + F.when(v.isNotNull(), 1).otherwise(0), total + F.coalesce(v, F.lit(0.0))
    mid = total / F.nullif(count, F.lit(0))
    flat = 0.5 if compat else 0.25 * grid.xres**2

    def ratio(a: Column, b: Column) -> Column:
        m, d = a - mid, a - b
        return (2.0 / grid.xres) * F.sqrt(F.lit(flat) + m * m + d * d / 2 - d * m)

    triangles = F.array_compact(F.array(ratio(ll, ul), ratio(ll, lr), ratio(ul, ur), ratio(ur, lr)))
    each = four.select("zr", "zc", F.explode(triangles).alias("t"))
    return each.groupBy("zr", "zc").agg(F.avg("t").alias("RumpleCSM")).withColumnsRenamed({"zr": "row", "zc": "col"})


def csm_metrics(csm: DataFrame, grid: Grid, zones: Grid, rise: float = 1.0) -> DataFrame:
    """``(row, col, MaxCSM, MeanCSM, StdDevCSM, RumpleCSM)`` per metric cell; ``rise``: units of the plane in one of heights."""
    basic = zonal(csm, grid, zones, {"MaxCSM": ZONAL["max"](), "MeanCSM": ZONAL["mean"](), "StdDevCSM": ZONAL["sd"]()})
    level = csm if rise == 1.0 else csm.withColumn("value", F.col("value") * rise)
    return basic.join(rumple(level, grid, zones), CELL, "left")


def mean_intensity(points: DataFrame, grid: Grid, cutoff: float | None = 2.0) -> DataFrame:
    """Whole-number mean intensity per fine cell of points at or above the cutoff."""
    high = points if cutoff is None else points.where(F.col("z") >= cutoff)
    sums = grid.with_cells(high).groupBy(*CELL).agg(F.sum("intensity").alias("s"), F.count("intensity").alias("n"))
    return sums.where("n > 0").select("row", "col", F.expr("s div n").alias("value"))
