"""Height metrics per cell: one aggregation for all metrics, both return types and all strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid

BIN = 0.01
STRATA = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 48.0, 64.0)
PERCENTS = (*range(5, 100, 5), 99)
COMMON_PERCENTS = (25, 50, 75, 95)
RETURN_TYPES = {"ALL": None, "FIRST": 1}


def stratum_names(breaks: tuple[float, ...]) -> list[str]:
    text = [f"{b:.2f}".rstrip("0").rstrip(".") for b in breaks]
    return [f"LessThan{text[0]}", *[f"{a}To{b}" for a, b in zip(text, text[1:])], f"GreaterThan{text[-1]}"]


def stratum_index(z: Column, breaks: tuple[float, ...]) -> Column:
    """The first stratum whose upper break exceeds z, else the last."""
    out = F.lit(len(breaks))
    for k in range(len(breaks) - 1, -1, -1):
        out = F.when(z < breaks[k], k).otherwise(out)
    return out


def by_return_type(points: DataFrame, types: tuple[str, ...] = ("ALL", "FIRST")) -> DataFrame:
    """One row for each type a point belongs to, from a single pass over the points."""
    options = []
    for t in types:
        first = RETURN_TYPES[t]
        options.append(F.lit(t) if first is None else F.when(F.col("return_number") == first, F.lit(t)))
    return points.withColumn("return_type", F.explode(F.array_compact(F.array(*options))))


def point_metrics(points: DataFrame, grid: Grid, canopy: float = 2.0, types: tuple[str, ...] = ("ALL", "FIRST"), advanced: bool = False, binned: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """``(return_type, row, col, <metrics>)`` over heights ``z``; ``more``: further aggregates of a cell's points by name.

    ``binned`` takes moments about the exact mean from the middles of 1 cm bins; otherwise from the
    heights.  Metrics of too few canopy returns (moments: 2, percentiles: 4) are null; skewness and
    kurtosis of equal heights are null.  Partial aggregates combine before the one shuffle.
    """
    z = F.col("z")
    high = F.when(z >= canopy, z)
    mid = (F.floor((z - canopy) / BIN) + 0.5) * BIN + canopy if binned else z
    m = F.when(z >= canopy, mid)
    percents = PERCENTS if advanced else COMMON_PERCENTS
    cells = by_return_type(grid.with_cells(points), types)
    sums = cells.groupBy("return_type", "row", "col").agg(
        F.count("*").alias("n"),
        F.count(high).alias("nc"),
        F.avg(high).alias("mean"),
        F.max(high).alias("top"),
        *[F.avg(_power(m - canopy, k)).alias(f"m{k}") for k in (1, 2, 3, 4)],
        F.percentile(high, F.array(*[F.lit(p / 100) for p in percents])).alias("p"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )
    c = F.col("mean") - canopy  # moments about the exact mean, from raw moments above the canopy line
    m1, m2, m3, m4 = (F.col(f"m{k}") for k in (1, 2, 3, 4))
    var = m2 - 2 * c * m1 + c * c
    third = m3 - 3 * c * m2 + 3 * c * c * m1 - c * c * c
    fourth = m4 - 4 * c * m3 + 6 * c * c * m2 - 4 * c * c * c * m1 + c * c * c * c
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    two, spread = F.col("nc") >= 2, var > 1e-12
    out = [
        F.col("mean").alias("Mean_CanopyHeight"),
        F.when(two, sd).alias("StdDev_CanopyHeight"),
        *[F.when(F.col("nc") >= 4, F.col("p")[k]).alias(f"{p:02d}thPercentile_CanopyHeight") for k, p in enumerate(percents)],
        F.col("n").alias("TotalReturnCount"),
        (100.0 * F.col("nc") / F.col("n")).alias("CanopyCover"),
    ]
    if advanced:
        out += [
            F.try_divide(c, F.col("top") - canopy).alias("CanopyReliefRatio"),
            F.when(two & spread, F.col("nc") * third / ((F.col("nc") - 1) * sd * sd * sd)).alias("CanopySkewness"),
            F.when(two & spread, fourth / (var * var)).alias("CanopyKurtosis"),
        ]
    return sums.select("return_type", "row", "col", *out, *[f"`{name}`" for name in more or {}])


def _power(v: Column, k: int) -> Column:
    out = v
    for _ in range(k - 1):
        out = out * v
    return out


def cover_above_mean(points: DataFrame, grid: Grid, canopy: float = 2.0, types: tuple[str, ...] = ("ALL", "FIRST"), binned: bool = False) -> DataFrame:
    """Percent of all returns that are canopy and above the cell's mean canopy height.

    Points are first counted by height, which is what has to be compared with the mean; the window
    then runs over the distinct heights of a cell, not over its points.
    """
    z = F.col("z")
    cells = by_return_type(grid.with_cells(points), types)
    heights = cells.groupBy("return_type", "row", "col", "z").agg(F.count("*").alias("k"))
    w = Window.partitionBy("return_type", "row", "col")
    high = F.when(z >= canopy, F.col("k"))
    mean = F.sum(high * z).over(w) / F.sum(high).over(w)
    mid = (F.floor((z - canopy) / BIN) + 0.5) * BIN + canopy if binned else z
    with_mean = heights.withColumns({"mean": mean, "mid": mid})
    return with_mean.groupBy("return_type", "row", "col").agg(
        F.when(F.count("mean") > 0, 100.0 * F.coalesce(F.sum(F.when((z >= canopy) & (F.col("mid") > F.col("mean")), F.col("k"))), F.lit(0)) / F.sum("k")).alias("CoverAboveMean")
    )


def strata(points: DataFrame, grid: Grid, breaks: tuple[float, ...] = STRATA, types: tuple[str, ...] = ("ALL", "FIRST")) -> DataFrame:
    """``(return_type, row, col, stratum_idx, stratum_name, cover, pct)`` for every stratum of a cell.

    ``cover``: returns of the stratum per return in it or below (null: none); ``pct``: per return.
    """
    cells = by_return_type(grid.with_cells(points), types).withColumn("s", stratum_index(F.col("z"), breaks))
    names = stratum_names(breaks)
    counts = cells.groupBy("return_type", "row", "col").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("s") == k, 1)).alias(f"s{k}") for k in range(len(names))])
    total, rows = F.lit(0), []
    for k, name in enumerate(names):
        own = F.col(f"s{k}")
        total = total + own
        rows.append(
            F.struct(
                F.lit(k).alias("stratum_idx"), F.lit(name).alias("stratum_name"),
                F.try_divide(100.0 * own, total).alias("cover"), (100.0 * own / F.col("n")).alias("pct"),
            )
        )
    return counts.select("return_type", "row", "col", F.explode(F.array(*rows)).alias("r")).select("return_type", "row", "col", "r.*")


def histogram(points: DataFrame, grid: Grid, canopy: float = 2.0, bin_size: float = BIN) -> DataFrame:
    """``(row, col, bin, n)``: the sparse height histogram of canopy returns."""
    high = grid.with_cells(points).where(F.col("z") >= canopy)
    return high.groupBy("row", "col", F.floor((F.col("z") - canopy) / bin_size).alias("bin")).agg(F.count("*").alias("n"))


def binned_percentiles(bins: DataFrame, percents: tuple[int, ...] = COMMON_PERCENTS, canopy: float = 2.0, bin_size: float = BIN) -> DataFrame:
    """Percentiles from a histogram: ``(row, col, p<NN>)`` as the middle of the bin that holds the rank.

    A walk over cumulative counts; heights within a bin are not told apart (at most half a bin off).
    """
    cell = Window.partitionBy("row", "col")
    below = F.sum("n").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    walked = bins.withColumns({"below": F.coalesce(below, F.lit(0)), "total": F.sum("n").over(cell)})
    middle = canopy + (F.col("bin") + 0.5) * bin_size
    rank = lambda p: F.floor((F.col("total") - 1) * (p / 100))
    hit = lambda p: (rank(p) >= F.col("below")) & (rank(p) < F.col("below") + F.col("n"))
    return walked.groupBy("row", "col").agg(*[F.max(F.when(hit(p), middle)).alias(f"p{p:02d}") for p in percents])


def coverage(files: DataFrame, grid: Grid) -> DataFrame:
    """``(row, col, n)``: files whose extent covers each cell."""
    return grid.along(grid.tallies(files)).select("row", "col", "n")
