"""Point filters, ground lookup and normalisation to height above ground."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Extent, Grid
from ..functions.crs import Crs


def parse_classes(text: str | None) -> tuple[frozenset[int], bool]:
    """``a,b,c`` allows these classes, ``~a,b,c`` all others: ``(classes, allow)``."""
    text = (text or "").strip()
    allow = not text.startswith("~")
    classes = frozenset(int(p) for p in text.lstrip("~").split(",") if p.strip())
    if any(not 0 <= c <= 255 for c in classes):
        raise ValueError("classes are 0 to 255")
    return classes, allow and bool(classes)


@dataclass(frozen=True)
class PointFilter:
    """What a scan drops.  One conjunction, cheap tests first; all of it pushes down to Parquet."""

    classes: str = "~7,9,18"
    use_withheld: bool = False
    max_scan_angle: float | None = 90.0
    first_returns: bool = False
    only_returns: bool = False
    box: Extent | None = None

    def conditions(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        if not self.use_withheld:
            out["withheld"] = ~F.col("withheld")
        classes, allow = parse_classes(self.classes)
        if classes:
            hit = F.col("classification").isin(sorted(classes))
            out["classes"] = hit if allow else ~hit
        if self.first_returns:
            out["first"] = F.col("return_number") == 1
        if self.only_returns:
            out["only"] = F.col("number_of_returns") == 1
        angle = self.max_scan_angle
        if angle is not None and angle == angle and 0 < angle < 90:
            out["angle"] = F.abs(F.col("scan_angle")) <= angle
        if self.box:
            out["box"] = self.box.inside()
        return out

    def apply(self, points: DataFrame, *more: Column) -> DataFrame:
        for c in [*self.conditions().values(), *more]:
            points = points.where(c)
        return points


def nearest(points: DataFrame, raster: DataFrame, grid: Grid, name: str = "ground") -> DataFrame:
    """Add the value of the cell that holds each point, null outside or without data."""
    r = raster.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias(name))
    at = points.withColumns({"_row": F.when(grid.extent.inside(), grid.row("y")), "_col": F.when(grid.extent.inside(), grid.col("x"))})
    return at.join(r, (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c")), "left").drop("_row", "_col", "_r", "_c")


def stencil(raster: DataFrame, grid: Grid) -> DataFrame:
    """``(_r, _c, _ul, _ur, _ll, _lr)``: the four cells around every crossing of cell borders."""
    return crossings(raster)


def crossings(raster: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, _r, _c, _ul, _ur, _ll, _lr)``: the four cells around every crossing of cell borders.

    The raster's values meet once at their crossings, so that points need a single join instead of
    four.  Crossing (r, c) has cell (r, c) up left; those along the edges lack two or three cells.
    """
    spots = [(0, 0, "_ul"), (0, -1, "_ur"), (-1, 0, "_ll"), (-1, -1, "_lr")]
    at = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(n).alias("n")) for dr, dc, n in spots])
    sent = raster.where("value is not null").select(*by, "row", "col", "value", F.explode(at).alias("o"))
    sent = sent.select(*by, (F.col("row") + F.col("o.dr")).alias("_r"), (F.col("col") + F.col("o.dc")).alias("_c"), "o.n", "value")
    return sent.groupBy(*by, "_r", "_c").agg(*[F.max(F.when(F.col("n") == n, F.col("value"))).alias(n) for _, _, n in spots])


def four_cells(tx: Column, ty: Column) -> Column:
    """The bilinear mix of a crossing's cells; of two values one may be missing, then the other counts alone."""

    def mix(low: Column, high: Column, share: Column) -> Column:
        return F.coalesce((1 - share) * low + share * high, low, high)

    return mix(mix(F.col("_ul"), F.col("_ur"), tx), mix(F.col("_ll"), F.col("_lr"), tx), ty)


def bilinear(points: DataFrame, raster: DataFrame, grid: Grid, name: str = "ground") -> DataFrame:
    """Add the bilinear value at each point from the four nearest cell centres.

    Of two values one may be missing: then the other counts alone.  Null outside the extent and
    where all four are missing.  One equi-join on the crossing, whatever the raster's size.
    """
    e = grid.extent
    fx = (F.col("x") - F.lit(float(e.xmin)) - F.lit(grid.xres / 2)) / F.lit(float(grid.xres))
    fy = (F.lit(float(e.ymax)) - F.col("y") - F.lit(grid.yres / 2)) / F.lit(float(grid.yres))
    at = points.withColumns({"_fx": F.when(e.inside(), fx), "_fy": F.when(e.inside(), fy)})
    at = at.withColumns({"_col": F.floor("_fx").cast("int"), "_row": F.floor("_fy").cast("int")})
    s = stencil(raster, grid)
    joined = at.join(s, (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c")), "left")

    value = four_cells(F.col("_fx") - F.col("_col"), F.col("_fy") - F.col("_row"))
    return joined.select(*points.columns, value.alias(name))


def normalize(points: DataFrame, dem: DataFrame, grid: Grid, min_ht: float = -8.0, max_ht: float = 100.0, xy_to: tuple[Crs, Crs] | None = None, z_factor: float = 1.0) -> DataFrame:
    """Height above ground for ``z``: points without ground or outside the height range go."""
    points = reproject(points, *xy_to) if xy_to else points
    points = points.withColumn("z", F.col("z") * z_factor) if z_factor != 1.0 else points
    on_ground = bilinear(points, dem, grid)
    high = on_ground.where("ground is not null").withColumn("z", F.col("z") - F.col("ground")).drop("ground")
    return high.where(F.col("z").between(min_ht, max_ht))


def already_normalized(points: DataFrame, min_ht: float = -8.0, max_ht: float = 100.0) -> DataFrame:
    return points.where(F.col("z").between(min_ht, max_ht))


def flat_ground(spark) -> DataFrame:
    """The ground of heights that are normalised already: one cell of zero."""
    return spark.range(1).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0.0).alias("value"))


def reproject(points: DataFrame, source: Crs, to: Crs) -> DataFrame:
    """Move ``x`` and ``y`` and scale ``z``; the same DataFrame if nothing changes."""
    x, y = source.transform(to, F.col("x"), F.col("y"))
    z = source.z_unit.convert(F.col("z"), to.z_unit)
    return points.withColumns({"x": x, "y": y, "z": z})


def append(a: DataFrame, a_crs: Crs, b: DataFrame, b_crs: Crs) -> DataFrame:
    """``b`` after ``a``, in the system of ``a``."""
    return a.unionByName(reproject(b, b_crs, a_crs))
