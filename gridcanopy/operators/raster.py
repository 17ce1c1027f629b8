"""Raster algebra on tidy rasters ``(row, col, value)``; a missing row or a null is no data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Extent, Grid

CELL = ["row", "col"]


def values(raster: DataFrame) -> DataFrame:
    return raster.where("value is not null").select("row", "col", "value")


def _shift(raster: DataFrame, grid: Grid, to: Grid) -> DataFrame:
    """The same cells under the numbering of an aligned grid."""
    dr, dc = grid.offset_to(to)
    if not dr and not dc:
        return raster
    return raster.withColumns({"row": F.col("row") + dr, "col": F.col("col") + dc})


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": divide,
}


def combine(a: DataFrame, b: DataFrame, op: str, grid_a: Grid | None = None, grid_b: Grid | None = None) -> DataFrame:
    """Cell by cell arithmetic; null where either is null, and for a division by zero."""
    if (grid_a or grid_b) and grid_a != grid_b:
        if grid_a is None or grid_b is None or not grid_a.consistent(grid_b) or (grid_a.nrow, grid_a.ncol) != (grid_b.nrow, grid_b.ncol):
            raise ValueError("rasters lie on different grids")
    left, right = values(a), values(b).withColumnRenamed("value", "other")
    return left.join(right, CELL).select("row", "col", OPERATIONS[op](F.col("value"), F.col("other")).alias("value"))


def combine_scalar(a: DataFrame, number: float, op: str, scalar_first: bool = False) -> DataFrame:
    v, n = F.col("value"), F.lit(float(number))
    out = OPERATIONS[op](n, v) if scalar_first else OPERATIONS[op](v, n)
    return values(a).select("row", "col", out.alias("value"))


def mask(a: DataFrame, by: DataFrame) -> DataFrame:
    """The cells of ``a`` where ``by`` has a value."""
    return values(a).join(values(by).select("row", "col"), CELL, "left_semi")


def has_any_value(a: DataFrame) -> bool:
    return not values(a).isEmpty()


def overlay(rasters: list[tuple[DataFrame, Grid]], onto: Grid, how: str = "first") -> DataFrame:
    """Union of aligned rasters on one grid: ``first`` (by list order), ``max``, ``sum`` or ``inside``.

    ``inside`` takes the raster in which the cell lies farther from an edge, of equals the later.
    """
    parts = None
    for order, (raster, grid) in enumerate(rasters):
        edge = F.least(F.col("row"), F.col("col"), F.lit(grid.ncol - 1) - F.col("col"), F.lit(grid.nrow - 1) - F.col("row"))
        part = _shift(values(raster).withColumns({"ord": F.lit(order), "edge": edge}), grid, onto)
        parts = part if parts is None else parts.unionByName(part)
    aggregates = {
        "first": F.min_by("value", "ord"),
        "max": F.max("value"),
        "sum": F.sum("value"),
        "inside": F.max_by("value", F.col("edge").cast("long") * len(rasters) + F.col("ord")),
    }
    return parts.where(f"row between 0 and {onto.nrow - 1} and col between 0 and {onto.ncol - 1}").groupBy(*CELL).agg(aggregates[how].alias("value"))


def overlay_with(rasters: list[tuple[DataFrame, Grid]], onto: Grid, combiner: Column) -> DataFrame:
    """The same with an aggregate column of ``value`` and ``ord`` of the caller's own."""
    parts = None
    for order, (raster, grid) in enumerate(rasters):
        part = _shift(values(raster).withColumn("ord", F.lit(order)), grid, onto)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*CELL).agg(combiner.alias("value"))


def crop(raster: DataFrame, grid: Grid, extent: Extent, how: str = "near") -> tuple[DataFrame, Grid]:
    r0, r1, c0, c1 = grid.rows_cols(extent, how)
    out = raster.where(f"row between {r0} and {r1} and col between {c0} and {c1}")
    return out.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0}), grid.crop(extent, how)


def extend(raster: DataFrame, grid: Grid, extent: Extent, how: str = "out") -> tuple[DataFrame, Grid]:
    """A larger grid; the new cells have no data."""
    to = grid.extend(extent, how)
    return _shift(raster, grid, to), to


def zonal(raster: DataFrame, grid: Grid, zones: Grid, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregate cells into the zones that hold their centres: ``(row, col, <names>)``."""
    cells = values(raster).select(zones.row(grid.y()).alias("zr"), zones.col(grid.x()).alias("zc"), "value", F.col("row").alias("r"), F.col("col").alias("c"))
    out = cells.groupBy("zr", "zc").agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.withColumnsRenamed({"zr": "row", "zc": "col"})


ZONAL = {
    "max": lambda: F.max("value"),
    "mean": lambda: F.avg("value"),
    "sd": lambda: F.stddev_pop("value"),
    "sum": lambda: F.nullif(F.sum("value"), F.lit(0.0)),
    "count": lambda: F.count("value"),
}


#: Cells along the side of a block.
BLOCK = 256


def in_blocks(raster: DataFrame, grid: Grid, pad: int, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, int], pa.Table], schema: str) -> DataFrame:
    """What a kernel makes of blocks with ``pad`` cells around them; a cell goes to its own block and to those it borders.

    The kernel gets a block's values (no data is NaN), the rows and columns of the block itself, and the padding.
    A task holds one block, so its memory does not grow with the raster.
    """
    last_r, last_c = (grid.nrow - 1) // BLOCK, (grid.ncol - 1) // BLOCK
    reach = lambda c, last: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - pad) / BLOCK)).cast("int"), F.least(F.lit(last), F.floor((F.col(c) + pad) / BLOCK)).cast("int"))
    dealt = values(raster).where(f"row between 0 and {grid.nrow - 1} and col between 0 and {grid.ncol - 1}")
    dealt = dealt.select("row", "col", F.col("value").cast("double").alias("value"), F.explode(reach("row", last_r)).alias("tr"))
    dealt = dealt.select("*", F.explode(reach("col", last_c)).alias("tc"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        row, col = np.arange(tr * BLOCK, min((tr + 1) * BLOCK, grid.nrow)), np.arange(tc * BLOCK, min((tc + 1) * BLOCK, grid.ncol))
        h = np.full((len(row) + 2 * pad, len(col) + 2 * pad), np.nan)
        r, c = t["row"].to_numpy() - row[0] + pad, t["col"].to_numpy() - col[0] + pad
        inside = (r < h.shape[0]) & (c < h.shape[1])
        h[r[inside], c[inside]] = t["value"].to_numpy()[inside]
        return kernel(h, row, col, pad)

    return dealt.groupBy("tr", "tc").applyInArrow(run, schema)


def shifted(h: np.ndarray, pad: int, dr: int, dc: int) -> np.ndarray:
    """The values of a padded block that its cells see at an offset."""
    return h[pad + dr : h.shape[0] - pad + dr, pad + dc : h.shape[1] - pad + dc]


def neighbours(raster: DataFrame, grid: Grid, offsets: list[tuple[int, int]]) -> DataFrame:
    """``(row, col, v0, v1, ...)``: the values at each offset from every cell that has one of them, as doubles.

    Cells travel once to their block, and those along its sides to the next; no self join.
    """
    names = [f"v{k}" for k in range(len(offsets))]

    def look(h: np.ndarray, row: np.ndarray, col: np.ndarray, pad: int) -> pa.Table:
        seen = [shifted(h, pad, dr, dc) for dr, dc in offsets]
        r, c = np.nonzero(np.any([~np.isnan(v) for v in seen], 0))
        found = [pa.array(v[r, c], from_pandas=True) for v in seen]  # NaN becomes null
        return pa.table([pa.array(row[r].astype(np.int32)), pa.array(col[c].astype(np.int32)), *found], names=["row", "col", *names])

    pad = max(1, *(abs(v) for o in offsets for v in o))
    return in_blocks(raster, grid, pad, look, ", ".join(["row int", "col int", *(f"{n} double" for n in names)]))


def focal(raster: DataFrame, grid: Grid, size: int, aggregate: Column, own_only: bool = False) -> DataFrame:
    """``aggregate`` of the values in the odd ``size`` square around every cell, truncated at edges.

    A row for each cell with any value in its window; ``own_only``: with a value of its own.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("a focal window has an odd size")
    k = size // 2
    span = F.sequence(F.lit(-k), F.lit(k))
    sent = values(raster).select("row", "col", "value", F.explode(span).alias("dr"))
    sent = sent.select("row", "col", "value", "dr", F.explode(span).alias("dc"))
    sent = sent.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "value", ((F.col("dr") == 0) & (F.col("dc") == 0)).alias("own"))
    sent = sent.where(f"row between 0 and {grid.nrow - 1} and col between 0 and {grid.ncol - 1}")
    out = sent.groupBy(*CELL).agg(aggregate.alias("value"), F.max("own").alias("own"))
    return (out.where("own") if own_only else out).drop("own")
