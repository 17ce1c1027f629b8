"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Extent, Grid, QuadExtent
from ..functions.lineage import materialize, shared_root
from ..functions.crs import Crs
from ..functions.units import LinearUnit
from ..operators import csm as surface
from ..operators import metrics, raster, terrain, trees
from ..operators.points import PointFilter, already_normalized, append, bilinear, nearest, normalize, reproject
from ..sources.las import las_catalogue, read_points, write_las_files
from ..sources.rasters import read_tiles, write_tiles
from ..streaming.ingest import complete_cells, ingest
from . import adapter
from .adapter import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CANOPY = 2.0
STRATA = (0.5, 5.5, 10.5, 20.5)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(f"`{c}`", 6) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` follows the adapter's views."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[name] = SQL + sql
        return f

    return register


# Filters ---------------------------------------------------------------------------------------
_OPEN = PointFilter(classes="", use_withheld=True, max_scan_angle=None)
_FILTERS: dict[str, tuple[Callable[[SparkSession, str], PointFilter], str]] = {
    "filter_class_blacklist": (lambda s, d: PointFilter("~7,9,18", True, None), "classification NOT IN (7, 9, 18)"),
    "filter_class_whitelist": (lambda s, d: PointFilter("1,2,5", True, None), "classification IN (1, 2, 5)"),
    "filter_withheld": (lambda s, d: PointFilter("", False, None), "NOT withheld"),
    "filter_scan_angle": (lambda s, d: PointFilter("", True, 24.5), "abs(scan_angle) <= 24.5"),
    "filter_first_returns": (lambda s, d: PointFilter("", True, None, first_returns=True), "return_number = 1"),
    "filter_only_returns": (lambda s, d: PointFilter("", True, None, only_returns=True), "number_of_returns = 1"),
    "filter_bbox": (lambda s, d: PointFilter("", True, None, box=Extent(1.0, 7.5, 2.5, 8.0)), "x BETWEEN 1 AND 7.5 AND y BETWEEN 2.5 AND 8"),
    "filter_priority": (lambda s, d: PointFilter("~7,9,18", False, 30.0, box=Extent(1.0, 7.5, 2.5, 8.0)), "NOT withheld AND classification NOT IN (7, 9, 18) AND abs(scan_angle) <= 30 AND x BETWEEN 1 AND 7.5 AND y BETWEEN 2.5 AND 8"),
}
for _name, (_make, _where) in _FILTERS.items():
    query(_name, f"SELECT pid, lno, round(x, 6) AS x, round(y, 6) AS y, z FROM pts WHERE {_where}")(
        lambda s, d, make=_make: make(s, d).apply(adapter.points(s, d)).select("pid", "lno", "x", "y", "z")
    )


@query("filter_height", "SELECT pid, lno, z FROM pts WHERE z BETWEEN 5 AND 12")
def _filter_height(s, d):
    return adapter.points(s, d).where(F.col("z").between(5.0, 12.0)).select("pid", "lno", "z")


_QUAD = QuadExtent(((1.0, 1.0), (2.0, 9.0), (9.0, 8.0), (8.0, 0.5)))


@query(
    "quad_contains",
    """SELECT pid, lno, round(x, 6) AS x, round(y, 6) AS y FROM pts WHERE
       1.0 * (y - 1.0) - 8.0 * (x - 1.0) <= 0 AND 7.0 * (y - 9.0) - (-1.0) * (x - 2.0) <= 0
       AND (-1.0) * (y - 8.0) - (-7.5) * (x - 9.0) <= 0 AND (-7.0) * (y - 0.5) - 0.5 * (x - 8.0) <= 0""",
)
def _quad(s, d):
    return adapter.points(s, d).where(_QUAD.inside()).select("pid", "lno", "x", "y")


@query("project_columns", "SELECT round(x, 6) AS x, round(y, 6) AS y, z, intensity, return_number FROM pts")
def _project(s, d):
    return adapter.points(s, d).select("x", "y", "z", "intensity", "return_number")


# Cells and units -------------------------------------------------------------------------------
@query(
    "cell_from_xy",
    "SELECT pid, lno, row, col, CAST(row AS BIGINT) * CAST((x1 - x0) / 10 AS BIGINT) + col AS cell FROM m",
)
def _cell(s, d):
    g = adapter.grid(s, d, 10)
    return g.with_cells(adapter.heights(s, d)).select("pid", "lno", "row", "col", g.cell().alias("cell"))


@query(
    "xy_from_cell",
    """SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, x0 + (c + 0.5) * 10 AS x, y1 - (r + 0.5) * 10 AS y
       FROM lim, generate_series(0, CAST((y1 - y0) / 10 AS BIGINT) - 1) AS a(r), generate_series(0, CAST((x1 - x0) / 10 AS BIGINT) - 1) AS b(c)""",
)
def _xy(s, d):
    g = adapter.grid(s, d, 10)
    return g.dense(s).select("row", "col", g.x().alias("x"), g.y().alias("y"))


@query("unit_convert", "SELECT pid, lno, round(z / 0.3048, 6) AS z_feet, round(z * 1.0, 6) AS z_unknown FROM pts")
def _units(s, d):
    m, ft = LinearUnit.named("m"), LinearUnit.named("feet")
    z = F.col("z")
    return adapter.points(s, d).select("pid", "lno", m.convert(z, ft).alias("z_feet"), LinearUnit().convert(z, ft).alias("z_unknown"))


# Point metrics ---------------------------------------------------------------------------------
def _metrics(s, d, **kw) -> DataFrame:
    return metrics.point_metrics(adapter.heights(s, d), adapter.grid(s, d, 10), CANOPY, **kw)


_GROUP = "FROM m GROUP BY row, col"
_BOTH = "(SELECT 'ALL' AS return_type, * FROM m UNION ALL SELECT 'FIRST' AS return_type, * FROM m WHERE return_number = 1)"
_P = "CASE WHEN count(*) FILTER (z >= 2) >= 4 THEN round(quantile_cont(CASE WHEN z >= 2 THEN z END, CAST({q} AS DOUBLE)), 6) END AS p{n}"


@query(
    "metric_flagship",
    f"""SELECT row, col, count(*) AS n, round(100.0 * count(*) FILTER (z >= 2) / count(*), 6) AS cover, round(avg(z) FILTER (z >= 2), 6) AS mean,
        {', '.join(_P.format(q=q / 100, n=q) for q in (25, 50, 75, 95))} {_GROUP}""",
)
def _flagship(s, d):
    """Count, cover, mean and percentiles of the canopy heights of every cell."""
    out = _metrics(s, d, types=("ALL",))
    names = {"TotalReturnCount": "n", "CanopyCover": "cover", "Mean_CanopyHeight": "mean"} | {f"{q}thPercentile_CanopyHeight": f"p{q}" for q in (25, 50, 75, 95)}
    return out.withColumnsRenamed(names).select("row", "col", *names.values())


@query("metric_count_cover_mean", f"SELECT return_type, row, col, count(*) AS n, round(100.0 * count(*) FILTER (z >= 2) / count(*), 6) AS cover, round(avg(z) FILTER (z >= 2), 6) AS mean FROM {_BOTH} GROUP BY return_type, row, col")
def _ccm(s, d):
    out = _metrics(s, d)
    return out.select("return_type", "row", "col", F.col("TotalReturnCount").alias("n"), F.col("CanopyCover").alias("cover"), F.col("Mean_CanopyHeight").alias("mean"))


@query("metric_stddev", f"SELECT row, col, CASE WHEN count(*) FILTER (z >= 2) >= 2 THEN round(stddev_pop(z) FILTER (z >= 2), 6) END AS sd {_GROUP}")
def _sd(s, d):
    return _metrics(s, d, types=("ALL",)).select("row", "col", F.col("StdDev_CanopyHeight").alias("sd"))


_ALL_P = metrics.PERCENTS


@query("metric_percentiles", f"SELECT row, col, {', '.join(_P.format(q=q / 100, n=q) for q in _ALL_P)} {_GROUP}")
def _percentiles(s, d):
    out = _metrics(s, d, types=("ALL",), advanced=True)
    return out.select("row", "col", *[F.col(f"{q:02d}thPercentile_CanopyHeight").alias(f"p{q}") for q in _ALL_P])


_MOMENTS = "(SELECT row, col, z, avg(z) OVER (PARTITION BY row, col) AS mu FROM m WHERE z >= 2)"


@query(
    "metric_skew_kurt",
    f"""SELECT c.row, c.col,
        CASE WHEN n >= 2 AND v > 1e-12 THEN round(s3 / ((n - 1) * pow(sqrt(v), 3)), 6) END AS skew,
        CASE WHEN n >= 2 AND v > 1e-12 THEN round(s4 / (n * v * v), 6) END AS kurt
        FROM (SELECT DISTINCT row, col FROM m) c LEFT JOIN (
          SELECT row, col, count(*) AS n, avg(pow(z - mu, 2)) AS v, sum(pow(z - mu, 3)) AS s3, sum(pow(z - mu, 4)) AS s4 FROM {_MOMENTS} GROUP BY row, col) k
        ON c.row = k.row AND c.col = k.col""",
)
def _skew(s, d):
    out = _metrics(s, d, types=("ALL",), advanced=True)
    return out.select("row", "col", F.col("CanopySkewness").alias("skew"), F.col("CanopyKurtosis").alias("kurt"))


@query("metric_relief", f"SELECT row, col, round((avg(z) FILTER (z >= 2) - 2) / nullif(max(z) FILTER (z >= 2) - 2, 0), 6) AS relief {_GROUP}")
def _relief(s, d):
    return _metrics(s, d, types=("ALL",), advanced=True).select("row", "col", F.col("CanopyReliefRatio").alias("relief"))


@query(
    "metric_cover_above_mean",
    """SELECT row, col, CASE WHEN count(mu) > 0 THEN round(100.0 * count(*) FILTER (z >= 2 AND z > mu) / count(*), 6) END AS above
       FROM (SELECT row, col, z, avg(CASE WHEN z >= 2 THEN z END) OVER (PARTITION BY row, col) AS mu FROM m) GROUP BY row, col""",
)
def _above(s, d):
    out = metrics.cover_above_mean(adapter.heights(s, d), adapter.grid(s, d, 10), CANOPY, types=("ALL",))
    return out.select("row", "col", F.col("CoverAboveMean").alias("above"))


@query(
    "metric_first_returns",
    f"""SELECT row, col, count(*) AS n, round(avg(z) FILTER (z >= 2), 6) AS mean, {_P.format(q=0.5, n=50)}
        FROM m WHERE return_number = 1 GROUP BY row, col""",
)
def _first(s, d):
    out = _metrics(s, d, types=("FIRST",))
    return out.select("row", "col", F.col("TotalReturnCount").alias("n"), F.col("Mean_CanopyHeight").alias("mean"), F.col("50thPercentile_CanopyHeight").alias("p50"))


_BINNED = "(SELECT row, col, z, avg(z) OVER (PARTITION BY row, col) AS mu, 2 + (floor((z - 2) / CAST(0.01 AS DOUBLE)) + 0.5) * CAST(0.01 AS DOUBLE) AS mid FROM m WHERE z >= 2)"


@query(
    "metric_binned_stddev",
    f"SELECT c.row, c.col, CASE WHEN n >= 2 THEN round(sqrt(v), 6) END AS sd FROM (SELECT DISTINCT row, col FROM m) c LEFT JOIN (SELECT row, col, count(*) AS n, avg(pow(mid - mu, 2)) AS v FROM {_BINNED} GROUP BY row, col) k ON c.row = k.row AND c.col = k.col",
)
def _binned_sd(s, d):
    return _metrics(s, d, types=("ALL",), binned=True).select("row", "col", F.col("StdDev_CanopyHeight").alias("sd"))


def _strata(s, d) -> DataFrame:
    return metrics.strata(adapter.heights(s, d), adapter.grid(s, d, 10), STRATA)


_IDX = "CASE WHEN z < 0.5 THEN 0 WHEN z < 5.5 THEN 1 WHEN z < 10.5 THEN 2 WHEN z < 20.5 THEN 3 ELSE 4 END"
_COUNTS = f"(SELECT return_type, row, col, count(*) AS n, {', '.join(f'count(*) FILTER ({_IDX} = {k}) AS s{k}' for k in range(5))} FROM {_BOTH} GROUP BY return_type, row, col)"


@query("stratum_cover", " UNION ALL ".join(f"SELECT return_type, row, col, {k} AS stratum_idx, round(100.0 * s{k} / nullif({' + '.join(f's{j}' for j in range(k + 1))}, 0), 6) AS cover FROM {_COUNTS}" for k in range(5)))
def _stratum_cover(s, d):
    return _strata(s, d).select("return_type", "row", "col", "stratum_idx", "cover")


@query("stratum_percent", " UNION ALL ".join(f"SELECT return_type, row, col, '{n}' AS stratum_name, round(100.0 * s{k} / n, 6) AS pct FROM {_COUNTS}" for k, n in enumerate(metrics.stratum_names(STRATA))))
def _stratum_pct(s, d):
    return _strata(s, d).select("return_type", "row", "col", "stratum_name", "pct")


@query("histogram_bins", "SELECT row, col, CAST(floor((z - 2) / CAST(0.01 AS DOUBLE)) AS BIGINT) AS bin, count(*) AS n FROM m WHERE z >= 2 GROUP BY ALL")
def _bins(s, d):
    return metrics.histogram(adapter.heights(s, d), adapter.grid(s, d, 10), CANOPY)


@query(
    "histogram_percentiles",
    """, h AS (SELECT row, col, floor((z - 2) / CAST(0.01 AS DOUBLE)) AS bin, count(*) AS n FROM m WHERE z >= 2 GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY row, col) AS total, sum(n) OVER (PARTITION BY row, col ORDER BY bin) - n AS below FROM h)
    SELECT row, col, """
    + ", ".join(f"round(max(CASE WHEN floor((total - 1) * CAST({q / 100} AS DOUBLE)) >= below AND floor((total - 1) * CAST({q / 100} AS DOUBLE)) < below + n THEN 2 + (bin + 0.5) * CAST(0.01 AS DOUBLE) END), 6) AS p{q}" for q in (25, 50, 75, 95))
    + " FROM w GROUP BY row, col",
)
def _bin_percentiles(s, d):
    return metrics.binned_percentiles(metrics.histogram(adapter.heights(s, d), adapter.grid(s, d, 10), CANOPY))


# Catalogues ------------------------------------------------------------------------------------
_COVER = """, g AS (SELECT *, CAST((y1 - y0) / {r} AS BIGINT) AS nr, CAST((x1 - x0) / {r} AS BIGINT) AS nc FROM lim),
  e AS (SELECT f.*, g.*, greatest(floor((xmin - x0) / {r} + 1e-9), 0) AS c0, least(ceil((xmax - x0) / {r} - 1e-9), nc) - 1 AS c1,
        greatest(floor((y1 - ymax) / {r} + 1e-9), 0) AS r0, least(ceil((y1 - ymin) / {r} - 1e-9), nr) - 1 AS r1 FROM files f, g),
  cov AS (SELECT file_id, CAST(a.r AS INTEGER) AS row, CAST(b.c AS INTEGER) AS col, nc, nr FROM e, generate_series(0, nr - 1) AS a(r), generate_series(0, nc - 1) AS b(c)
        WHERE a.r BETWEEN r0 AND r1 AND b.c BETWEEN c0 AND c1)
"""


@query("coverage_count", _COVER.format(r=10) + "SELECT row, col, count(*) AS n FROM cov GROUP BY row, col")
def _coverage(s, d):
    return metrics.coverage(adapter.files(s, d), adapter.grid(s, d, 10))


@query("file_tile_overlap", _COVER.format(r=5) + "SELECT DISTINCT CAST(row AS BIGINT) * nc + col AS tile_id, row, col, 'Col' || lpad(CAST(col + 1 AS VARCHAR), CAST(len(CAST(nc AS VARCHAR)) AS INTEGER), '0') || '_Row' || lpad(CAST(row + 1 AS VARCHAR), CAST(len(CAST(nr AS VARCHAR)) AS INTEGER), '0') AS name FROM cov")
def _tiles(s, d):
    return trees.tiles_of(adapter.files(s, d), adapter.grid(s, d, 5))


@query("full_extent", "SELECT min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM files")
def _full(s, d):
    return adapter.files(s, d).agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))


@query("crs_counts", "SELECT CAST(epsg AS INTEGER) AS epsg, z_unit, count(*) AS n FROM files GROUP BY epsg, z_unit")
def _crs(s, d):
    return adapter.files(s, d).groupBy("epsg", "z_unit").agg(F.count("*").alias("n"))


@query("las_units_agree", "SELECT CASE WHEN count(DISTINCT z_unit) = 1 THEN min(z_unit) END AS z_unit FROM files")
def _agree(s, d):
    return adapter.files(s, d).agg(F.when(F.count_distinct("z_unit") == 1, F.min("z_unit")).alias("z_unit"))


@query("file_order", "SELECT file_id, CAST(row_number() OVER (ORDER BY ymax DESC, ymin DESC, xmin, xmax, file_id) AS INTEGER) AS pos FROM files")
def _order(s, d):
    return terrain.reading_order(adapter.files(s, d), "file_id").select("file_id", "pos")


@query("dem_priority", "SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(row_number() OVER (ORDER BY (1 + s_nationkey % 5) * (1.0 + s_nationkey % 3), CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS priority FROM supplier")
def _dem_priority(s, d):
    sup = s.read.parquet(f"{d}/supplier.parquet")
    cat = sup.select(F.col("s_suppkey").cast("string").alias("path"), (1 + F.col("s_nationkey") % 5).cast("double").alias("xres"), (1.0 + F.col("s_nationkey") % 3).alias("yres"))
    return terrain.priority(cat).select("path", "priority")


def _sql_cover(low: str, high: str) -> str:
    return f""", e AS (SELECT f.*, greatest({low.format('(xmin - x0) / 10')}, 0) AS c0, least({high.format('(xmax - x0) / 10')}, (x1 - x0) / 10) - 1 AS c1,
        greatest({low.format('(y1 - ymax) / 10')}, 0) AS r0, least({high.format('(y1 - ymin) / 10')}, (y1 - y0) / 10) - 1 AS r1, x0, x1, y0, y1 FROM files f, lim)
    SELECT file_id, CAST(a.r AS INTEGER) AS row, CAST(b.c AS INTEGER) AS col FROM e, generate_series(0, CAST((y1 - y0) / 10 AS BIGINT) - 1) AS a(r),
      generate_series(0, CAST((x1 - x0) / 10 AS BIGINT) - 1) AS b(c) WHERE a.r BETWEEN r0 AND r1 AND b.c BETWEEN c0 AND c1"""


@query("cells_snapped_near", _sql_cover("floor({} + 0.5)", "floor({} + 0.5)"))
def _near(s, d):
    """The cells of each file's box, its sides moved to the nearest cell borders."""
    return adapter.grid(s, d, 10).covered(adapter.files(s, d), "near").select("file_id", "row", "col")


@query("cells_snapped_in", _sql_cover("ceil({} - 1e-9)", "floor({} + 1e-9)"))
def _inner(s, d):
    """The cells that lie within each file's box."""
    return adapter.grid(s, d, 10).covered(adapter.files(s, d), "in").select("file_id", "row", "col")


# Points from elsewhere ---------------------------------------------------------------------------
@query("already_normalized", "SELECT pid, lno, z FROM pts WHERE z BETWEEN 5 AND 30")
def _already(s, d):
    return already_normalized(adapter.points(s, d), 5.0, 30.0).select("pid", "lno", "z")


@query("append_units", "SELECT pid, lno, z FROM pts WHERE file_id < 5 UNION ALL SELECT pid, lno, round(z * 0.3048, 6) AS z FROM pts WHERE file_id >= 5")
def _append(s, d):
    """Points in metres, and points in feet after them."""
    p = adapter.points(s, d).select("pid", "lno", "file_id", "x", "y", "z")
    metres, feet = Crs(0, LinearUnit.named("m")), Crs(0, LinearUnit.named("feet"))
    return append(p.where("file_id < 5"), metres, p.where("file_id >= 5"), feet).select("pid", "lno", "z")


@query("reproject_there_and_back", "SELECT pid, lno, round(500000 + x * 10, 3) AS x, round(4200000 + y * 10, 3) AS y FROM pts")
def _there_and_back(s, d):
    """UTM zone 10 to degrees, to zone 11, and back to zone 10."""
    p = adapter.points(s, d).select("pid", "lno", (500000 + F.col("x") * 10).alias("x"), (4200000 + F.col("y") * 10).alias("y"), "z")
    ten, degrees, eleven = Crs(32610), Crs(4326), Crs(32611)
    back = reproject(reproject(reproject(p, ten, degrees), degrees, eleven), eleven, ten)
    return back.select("pid", "lno", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    "ingest_complete_cells",
    _COVER.format(r=10) + """, done AS (SELECT DISTINCT row, col FROM cov)
    SELECT m.row, m.col, count(*) AS n, round(100.0 * count(*) FILTER (z >= 2) / count(*), 6) AS cover, round(avg(z) FILTER (z >= 2), 6) AS mean, max(z) FILTER (z >= 2) AS top
    FROM m SEMI JOIN done ON m.row = done.row AND m.col = done.col GROUP BY m.row, m.col""",
)
def _ingest(s, d):
    """Files read by a stream, sums kept per batch, and the cells all of whose files were read."""
    g, at = adapter.grid(s, d, 10), f"{shared_root(s)}/ingest-{uuid.uuid4().hex}"
    points = adapter.points(s, d).select("file_id", "x", "y", "z", adapter.kept().alias("kept"))
    points.write.parquet(f"{at}/points")
    arriving = s.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/points")
    ingest(arriving, g, at, f"{at}/checkpoint", keep=F.col("kept")).awaitTermination()
    return complete_cells(s, at, adapter.files(s, d), g)


# Canopy surface --------------------------------------------------------------------------------
def _csm(s, d) -> tuple[DataFrame, Grid]:
    g = adapter.grid(s, d, 1)
    return surface.max_points(adapter.heights(s, d), g, 0.0), g


@query("csm_max", "SELECT row, col, value FROM csm")
def _csm_max(s, d):
    return _csm(s, d)[0]


@query("csm_unchanged", "SELECT row, col, value FROM csm")
def _unchanged(s, d):
    return surface.unchanged(*_csm(s, d))


_FP = ", ".join(f"(CAST({x!r} AS DOUBLE), CAST({y!r} AS DOUBLE), CAST({z!r} AS DOUBLE))" for x, y, z in surface.footprint(0.4))


@query(
    "csm_footprint",
    f"""SELECT CAST(least(floor(y1 - y), y1 - y0 - 1) AS INTEGER) AS row, CAST(least(floor(x - x0), x1 - x0 - 1) AS INTEGER) AS col, round(max(z), 6) AS value
        FROM (SELECT x + dx AS x, y + dy AS y, z + dz AS z FROM hp, (VALUES {_FP}) AS o(dx, dy, dz)), lim
        WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2""",
)
def _csm_footprint(s, d):
    return surface.max_points(adapter.heights(s, d), adapter.grid(s, d, 1), 0.4)


def _sql_smooth(k: int) -> str:
    return f"SELECT a.row, a.col, round(avg(b.value), 6) AS value FROM csm a, csm b, generate_series(-{k}, {k}) AS u(i), generate_series(-{k}, {k}) AS v(j) WHERE b.row = a.row + u.i AND b.col = a.col + v.j GROUP BY a.row, a.col"


@query("csm_smooth3", _sql_smooth(1))
def _smooth3(s, d):
    return surface.smooth(*_csm(s, d), 3)


@query("csm_smooth5", _sql_smooth(2))
def _smooth5(s, d):
    return surface.smooth(*_csm(s, d), 5)


_RAYS = ", ".join(f"({k}, {n}, {n * dr}, {n * dc}, CAST({n * (2**0.5 if k >= 4 else 1.0)!r} AS DOUBLE))" for k, (dr, dc) in enumerate(surface.DIRECTIONS) for n in range(1, (3 if k >= 4 else 5) + 1))
_FILL = f""", fg AS (SELECT *, CAST(y1 - y0 AS INTEGER) AS nr, CAST(x1 - x0 AS INTEGER) AS nc FROM lim),
  rays(k, n, dr, dc, w) AS (VALUES {_RAYS}),
  cells AS (SELECT CAST(a.r AS INTEGER) AS row, CAST(b.c AS INTEGER) AS col, nr, nc FROM fg, generate_series(0, nr - 1) AS a(r), generate_series(0, nc - 1) AS b(c)),
  empty AS (SELECT cells.* FROM cells LEFT JOIN csm USING (row, col) WHERE csm.value IS NULL),
  looks AS (SELECT e.row, e.col, k, n, w, v.value, (e.row + dr < 0 OR e.row + dr >= nr OR e.col + dc < 0 OR e.col + dc >= nc) AS edge
        FROM empty e CROSS JOIN rays LEFT JOIN csm v ON v.row = e.row + dr AND v.col = e.col + dc),
  ray AS (SELECT row, col, k, arg_min(value, n) FILTER (value IS NOT NULL) AS value, arg_min(w, n) FILTER (value IS NOT NULL) AS w, bool_or(edge) AS edge FROM looks GROUP BY row, col, k),
  filled AS (SELECT row, col, sum(value / w) / sum(1 / w) AS value FROM ray GROUP BY row, col HAVING count(*) FILTER (value IS NOT NULL OR edge) >= 6 AND count(value) > 0)
"""


@query("csm_fill", _FILL + "SELECT row, col, round(value, 6) AS value FROM filled")
def _fill(s, d):
    return surface.fill(*_csm(s, d))


@query("csm_smooth_fill", _FILL + f"{_sql_smooth(1)} UNION ALL SELECT row, col, round(value, 6) FROM filled")
def _smooth_fill(s, d):
    return surface.smooth_and_fill(*_csm(s, d))


_Z = "(SELECT row // 10 AS row, col // 10 AS col, value FROM csm)"


@query("zonal_max_mean_sd", f"SELECT row, col, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM {_Z} GROUP BY row, col")
def _zonal(s, d):
    c, g = _csm(s, d)
    return raster.zonal(c, g, adapter.grid(s, d, 10), {n: raster.ZONAL[n]() for n in ("max", "mean", "sd")})


@query("zonal_sum_count", f"SELECT row, col, nullif(sum(value), 0) AS sum, count(value) AS count FROM {_Z} GROUP BY row, col")
def _zonal2(s, d):
    c, g = _csm(s, d)
    return raster.zonal(c, g, adapter.grid(s, d, 10), {n: raster.ZONAL[n]() for n in ("sum", "count")})


def _sql_rumple() -> str:
    r = lambda a, b: f"2.0 * sqrt(0.25 + pow({a} - mid, 2) + pow({a} - {b}, 2) / 2 - ({a} - {b}) * ({a} - mid))"
    return f""", spot AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM csm, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dr, dc)),
  four AS (SELECT spot.row, spot.col, a.value AS lr, b.value AS ll, c.value AS ur, e.value AS ul FROM spot
     LEFT JOIN csm a ON a.row = spot.row AND a.col = spot.col LEFT JOIN csm b ON b.row = spot.row AND b.col = spot.col - 1
     LEFT JOIN csm c ON c.row = spot.row - 1 AND c.col = spot.col LEFT JOIN csm e ON e.row = spot.row - 1 AND e.col = spot.col - 1
     WHERE spot.row % 10 > 0 AND spot.col % 10 > 0),
  mids AS (SELECT *, (coalesce(lr, 0) + coalesce(ll, 0) + coalesce(ur, 0) + coalesce(ul, 0)) / ((lr IS NOT NULL)::INT + (ll IS NOT NULL)::INT + (ur IS NOT NULL)::INT + (ul IS NOT NULL)::INT) AS mid FROM four),
  tri AS ({' UNION ALL '.join(f'SELECT row, col, {r(a, b)} AS t FROM mids' for a, b in (('ll', 'ul'), ('ll', 'lr'), ('ul', 'ur'), ('ur', 'lr')))})
  SELECT row // 10 AS row, col // 10 AS col, round(avg(t), 6) AS rumple FROM tri WHERE t IS NOT NULL GROUP BY 1, 2"""


@query("zonal_rumple", _sql_rumple())
def _rumple(s, d):
    c, g = _csm(s, d)
    return surface.rumple(c, g, adapter.grid(s, d, 10)).withColumnRenamed("RumpleCSM", "rumple")


@query("intensity_mean", "SELECT row, col, CAST(sum(intensity) // count(*) AS BIGINT) AS value FROM f WHERE z >= 2 GROUP BY row, col")
def _intensity(s, d):
    return surface.mean_intensity(adapter.heights(s, d), adapter.grid(s, d, 1), CANOPY)


# Raster algebra --------------------------------------------------------------------------------
def _pair(s, d) -> tuple[DataFrame, DataFrame, Grid]:
    """Count less 560 and mean height of each cell, the second with gaps."""
    g = adapter.grid(s, d, 1)
    cells = g.with_cells(adapter.heights(s, d)).groupBy("row", "col")
    a = cells.agg(F.max("z").alias("value"))
    b = cells.agg((F.min("z") - 5).alias("value")).where("(row + col) % 3 <> 0")
    return a, b, g


_AB = ", b AS (SELECT row, col, min(z) - 5 AS value FROM f WHERE true GROUP BY row, col HAVING (row + col) % 3 <> 0)"
for _op, _sql in {"add": "a.value + b.value", "sub": "a.value - b.value", "mul": "a.value * b.value", "div": "a.value / nullif(b.value, 0)"}.items():
    query(f"raster_{_op}", f"{_AB} SELECT a.row, a.col, round({_sql}, 6) AS value FROM csm a JOIN b ON a.row = b.row AND a.col = b.col")(
        lambda s, d, op=_op: raster.combine(*_pair(s, d)[:2], op)
    )


@query("raster_scalar", "SELECT row, col, round(6 / nullif(value, 0), 6) AS a, value - 1 AS b FROM csm")
def _scalar(s, d):
    a = _pair(s, d)[0]
    one = raster.combine_scalar(a, 6, "div", scalar_first=True).withColumnRenamed("value", "a")
    return one.join(raster.combine_scalar(a, 1, "sub").withColumnRenamed("value", "b"), ["row", "col"])


@query("raster_mask", f"{_AB} SELECT a.row, a.col, a.value FROM csm a SEMI JOIN b ON a.row = b.row AND a.col = b.col")
def _mask(s, d):
    return raster.mask(*_pair(s, d)[:2])


@query("raster_crop", "SELECT row - 2 AS row, col - 3 AS col, value FROM csm, lim WHERE row BETWEEN 2 AND 6 AND col BETWEEN 3 AND 7")
def _crop(s, d):
    a, _, g = _pair(s, d)
    e = g.extent
    return raster.crop(a, g, Extent(e.xmin + 3.2, e.xmin + 8.1, e.ymax - 6.9, e.ymax - 2.2))[0]


@query("raster_extend", "SELECT row + 4 AS row, col + 2 AS col, value FROM csm")
def _extend(s, d):
    a, _, g = _pair(s, d)
    e = g.extent
    return raster.extend(a, g, Extent(e.xmin - 1.5, e.xmax, e.ymin, e.ymax + 3.5))[0]


def _overlaid(s, d, how):
    a, b, g = _pair(s, d)
    e = g.extent
    moved = Grid(Extent(e.xmin + 2, e.xmax + 2, e.ymin - 3, e.ymax - 3), g.nrow, g.ncol)
    return raster.overlay([(a, g), (b, moved)], g, how)


_ON = f"""{_AB}, n AS (SELECT CAST(y1 - y0 AS INTEGER) AS nr, CAST(x1 - x0 AS INTEGER) AS nc FROM lim),
  u AS (SELECT row, col, value, 0 AS ord, least(row, col, nc - 1 - col, nr - 1 - row) AS edge FROM csm, n
        UNION ALL SELECT row + 3, col + 2, value, 1, least(row, col, nc - 1 - col, nr - 1 - row) FROM b, n),
  v AS (SELECT u.* FROM u, n WHERE row BETWEEN 0 AND nr - 1 AND col BETWEEN 0 AND nc - 1)
"""
for _how, _agg in {"first": "arg_min(value, ord)", "max": "max(value)", "sum": "sum(value)", "inside": "arg_max(value, edge * 2 + ord)"}.items():
    query(f"overlay_{_how}", f"{_ON} SELECT row, col, {_agg} AS value FROM v GROUP BY row, col")(lambda s, d, how=_how: _overlaid(s, d, how))


# Ground ----------------------------------------------------------------------------------------
_NEAR = "CAST(least(floor((y1 - y) / yr), nrow - 1) AS INTEGER)", "CAST(least(floor((x - x0) / xr), 39) AS INTEGER)"


@query("dem_nearest", f"SELECT p.pid, p.lno, round(d.value, 6) AS ground FROM (SELECT *, {_NEAR[0]} AS r, {_NEAR[1]} AS c FROM pts, dg) p LEFT JOIN dem d ON d.row = p.r AND d.col = p.c")
def _nearest(s, d):
    return nearest(adapter.points(s, d), adapter.dem(s, d), adapter.dem_grid(s, d)).select("pid", "lno", "ground")


def _sql_bilinear(src: str, name: str = "bl", dem: str = "dem", cols: str = "*") -> str:
    """Value at (x, y) of ``src``: four left joins and the rule that a missing value yields to the other."""
    return f"""{name}_a AS (SELECT *, floor((x - x0 - xr / 2) / xr) AS c, floor((y1 - y - yr / 2) / yr) AS r,
    (x - x0 - xr / 2) / xr - floor((x - x0 - xr / 2) / xr) AS tx, (y1 - y - yr / 2) / yr - floor((y1 - y - yr / 2) / yr) AS ty FROM {src}, dg WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
  {name}_b AS (SELECT q.*, coalesce((1 - tx) * ul.value + tx * ur.value, ul.value, ur.value) AS above, coalesce((1 - tx) * ll.value + tx * lr.value, ll.value, lr.value) AS below
    FROM {name}_a q LEFT JOIN {dem} ul ON ul.row = q.r AND ul.col = q.c LEFT JOIN {dem} ur ON ur.row = q.r AND ur.col = q.c + 1
    LEFT JOIN {dem} ll ON ll.row = q.r + 1 AND ll.col = q.c LEFT JOIN {dem} lr ON lr.row = q.r + 1 AND lr.col = q.c + 1),
  {name} AS (SELECT {cols}, coalesce((1 - ty) * above + ty * below, above, below) AS ground FROM {name}_b)"""


@query("dem_bilinear", f", {_sql_bilinear('pts')} SELECT pid, lno, round(ground, 6) AS ground FROM bl")
def _bilinear(s, d):
    return bilinear(adapter.points(s, d), adapter.dem(s, d), adapter.dem_grid(s, d)).select("pid", "lno", "ground")


@query(
    "normalize_heights",
    f""", raw AS (SELECT pid, lno, x, y, z + 90 AS z FROM pts WHERE NOT withheld AND classification NOT IN (7, 9, 18) AND abs(scan_angle) <= 30), {_sql_bilinear('raw')}
    SELECT pid, lno, round(z - ground, 6) AS z FROM bl WHERE ground IS NOT NULL AND z - ground BETWEEN -8 AND 100""",
)
def _normalize(s, d):
    raw = adapter.FILTER.apply(adapter.points(s, d)).withColumn("z", F.col("z") + 90)
    return normalize(raw, adapter.dem(s, d), adapter.dem_grid(s, d)).select("pid", "lno", "z")


_FIVE = "five AS (SELECT CAST(a.r AS INTEGER) AS row, CAST(b.c AS INTEGER) AS col, lim.x0 + (b.c + 0.5) * 5 AS x, lim.y1 - (a.r + 0.5) * 5 AS y FROM lim, generate_series(0, CAST((y1 - y0) / 5 AS BIGINT) - 1) AS a(r), generate_series(0, CAST((x1 - x0) / 5 AS BIGINT) - 1) AS b(c))"


@query("dem_resample", f", {_FIVE}, {_sql_bilinear('five')} SELECT row, col, round(ground, 6) AS value FROM bl WHERE ground IS NOT NULL")
def _resample(s, d):
    return terrain.resample(adapter.dem(s, d), adapter.dem_grid(s, d), adapter.grid(s, d, 5))


@query("dem_mosaic", f", part_dem AS (SELECT * FROM dem WHERE col < 17), {_FIVE}, {_sql_bilinear('five', 'b1', 'part_dem')}, {_sql_bilinear('five', 'b2')} SELECT row, col, round(coalesce(b1.ground + 1, b2.ground), 6) AS value FROM b2 LEFT JOIN (SELECT row, col, ground FROM b1) b1 USING (row, col) WHERE coalesce(b1.ground, b2.ground) IS NOT NULL")
def _mosaic(s, d):
    whole, g = adapter.dem(s, d), adapter.dem_grid(s, d)
    left = whole.where("col < 17").withColumn("value", F.col("value") + 1)
    return terrain.mosaic([(left, g), (whole, g)], adapter.grid(s, d, 5))


_ELEV = "elev AS (SELECT CAST(least(floor((row + 0.5) * yr / 10), (y1 - y0) / 10 - 1) AS INTEGER) AS row, CAST(least(floor((col + 0.5) * xr / 10), (x1 - x0) / 10 - 1) AS INTEGER) AS col, avg(value) AS value FROM dem, dg GROUP BY 1, 2)"


@query("elevation_mean", f", {_ELEV} SELECT row, col, round(value, 6) AS value FROM elev")
def _elevation(s, d):
    return terrain.mean_elevation(adapter.dem(s, d), adapter.dem_grid(s, d), adapter.grid(s, d, 10))


@query("elevation_buffer", f", {_ELEV}, holes AS (SELECT * FROM elev WHERE (row + col) % 2 = 0), ten AS (SELECT CAST(a.r AS INTEGER) AS row, CAST(b.c AS INTEGER) AS col, lim.x0 + (b.c + 0.5) * 10 AS x, lim.y1 - (a.r + 0.5) * 10 AS y FROM lim, generate_series(0, CAST((y1 - y0) / 10 AS BIGINT) - 1) AS a(r), generate_series(0, CAST((x1 - x0) / 10 AS BIGINT) - 1) AS b(c)), gap AS (SELECT * FROM ten ANTI JOIN holes USING (row, col)), {_sql_bilinear('gap')} SELECT row, col, round(value, 6) AS value FROM holes UNION ALL SELECT row, col, round(ground, 6) FROM bl WHERE ground IS NOT NULL")
def _buffered(s, d):
    g = adapter.grid(s, d, 10)
    elev = terrain.mean_elevation(adapter.dem(s, d), adapter.dem_grid(s, d), g).where("(row + col) % 2 = 0")
    return terrain.buffer_elevation(elev, g, [(adapter.dem(s, d), adapter.dem_grid(s, d))])


@query("elevation_merge", "SELECT row, col, round(coalesce(a.value + 1, b.value), 6) AS value FROM dem b LEFT JOIN (SELECT row, col, value FROM dem WHERE (row + col) % 4 = 0) a USING (row, col)")
def _merge(s, d):
    whole = adapter.dem(s, d)
    first = whole.where("(row + col) % 4 = 0").withColumn("value", F.col("value") + 1)
    return terrain.merge_elevation([(first, 0), (whole, 1)])


# Topography ------------------------------------------------------------------------------------
def _topo(s, d, *names) -> DataFrame:
    return terrain.topo_metrics(adapter.dem(s, d), adapter.dem_grid(s, d)).select("row", "col", *names)


_NINE = """, nine AS (SELECT e.row, e.col, nw.value AS nw, n.value AS n, ne.value AS ne, w.value AS w, e.value AS c, ea.value AS e, sw.value AS sw, so.value AS s, se.value AS se, xr, yr
  FROM dem e JOIN dem nw ON nw.row = e.row - 1 AND nw.col = e.col - 1 JOIN dem n ON n.row = e.row - 1 AND n.col = e.col JOIN dem ne ON ne.row = e.row - 1 AND ne.col = e.col + 1
  JOIN dem w ON w.row = e.row AND w.col = e.col - 1 JOIN dem ea ON ea.row = e.row AND ea.col = e.col + 1 JOIN dem sw ON sw.row = e.row + 1 AND sw.col = e.col - 1
  JOIN dem so ON so.row = e.row + 1 AND so.col = e.col JOIN dem se ON se.row = e.row + 1 AND se.col = e.col + 1, dg),
 sl AS (SELECT *, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * yr) AS ns, ((nw + 2 * w + sw) - (ne + 2 * e + se)) / (8 * xr) AS ew,
  ((w + e) / 2 - c) / (xr * xr) AS dd, ((n + s) / 2 - c) / (yr * yr) AS ee, (ne + sw - nw - se) / (4 * xr * yr) AS ff, (e - w) / (2 * xr) AS gg, (n - s) / (2 * yr) AS hh FROM nine),
 asp AS (SELECT *, atan(sqrt(ns * ns + ew * ew)) AS slope, CASE WHEN ns > 0 AND ew >= 0 THEN atan(ew / ns) WHEN ns > 0 THEN 2 * pi() + atan(ew / ns) WHEN ns < 0 THEN pi() + atan(ew / ns)
  WHEN ew > 0 THEN pi() / 2 WHEN ew < 0 THEN 3 * pi() / 2 END AS aspect FROM sl)
"""
_TOPO = {
    "topo_slope": ("Slope", "degrees(slope)"),
    "topo_aspect": ("Aspect", "degrees(aspect)"),
    "topo_curvature": ("Curvature", "-200 * (dd + ee)"),
    "topo_tri": ("TerrainRuggedness", "sqrt(pow(nw - c, 2) + pow(n - c, 2) + pow(ne - c, 2) + pow(w - c, 2) + pow(e - c, 2) + pow(sw - c, 2) + pow(s - c, 2) + pow(se - c, 2))"),
    "topo_sri": ("SolarRadiationIndex", "1 + cos(radians(45)) * cos(slope) + sin(radians(45)) * sin(slope) * cos(pi() - aspect)"),
}
for _name, (_col, _sql) in _TOPO.items():
    query(_name, f"{_NINE} SELECT row, col, round({_sql}, 6) + 0.0 AS {_col} FROM asp")(lambda s, d, c=_col: _topo(s, d, c))


@query("topo_profile_plan", f"{_NINE} SELECT row, col, round(-200 * (dd * gg * gg + ee * hh * hh + ff * gg * hh) / nullif(gg * gg + hh * hh, 0), 6) + 0.0 AS ProfileCurvature, round(200 * (dd * hh * hh + ee * gg * gg - ff * gg * hh) / nullif(gg * gg + hh * hh, 0), 6) + 0.0 AS PlanCurvature FROM asp")
def _profile(s, d):
    return _topo(s, d, "ProfileCurvature", "PlanCurvature")


_TPI_RADIUS = 6.0


@query(
    "topo_tpi",
    f""", o AS (SELECT CAST(a.r AS INTEGER) AS dr, CAST(b.c AS INTEGER) AS dc FROM dg, generate_series(-CAST(floor({_TPI_RADIUS} / yr) AS BIGINT), CAST(floor({_TPI_RADIUS} / yr) AS BIGINT)) AS a(r),
      generate_series(-CAST(floor({_TPI_RADIUS} / xr) AS BIGINT), CAST(floor({_TPI_RADIUS} / xr) AS BIGINT)) AS b(c)
      WHERE pow(b.c * xr, 2) + pow(a.r * yr, 2) BETWEEN pow(greatest({_TPI_RADIUS} - (xr + yr) / 2, 0), 2) AND pow({_TPI_RADIUS} + (xr + yr) / 2, 2))
    SELECT e.row, e.col, round(any_value(e.value) - avg(r.value), 6) + 0.0 AS value FROM dem e, o, dem r WHERE r.row = e.row + dr AND r.col = e.col + dc GROUP BY e.row, e.col""",
)
def _tpi(s, d):
    return terrain.position_index(adapter.dem(s, d), adapter.dem_grid(s, d), _TPI_RADIUS)


# Trees -----------------------------------------------------------------------------------------
_TOPS = """SELECT a.row, a.col, a.value FROM csm a WHERE a.value >= 40 AND NOT EXISTS (
         SELECT 1 FROM csm b WHERE b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (b.row <> a.row OR b.col <> a.col)
         AND (b.value > a.value OR (b.value = a.value AND ((b.row = a.row - 1 AND b.col <= a.col) OR (b.row = a.row AND b.col = a.col - 1) OR (b.row = a.row + 1 AND b.col = a.col - 1)))))"""
# the highest top left is taken and strikes those within reach, until none is left
_THINNED = f""", tops AS ({_TOPS}), step(kept, rest) AS (
    SELECT list(t)[1:0], list(t ORDER BY value DESC, row, col) FROM (SELECT struct_pack(row := row, col := col, value := value) AS t, * FROM tops)
    UNION ALL SELECT list_append(kept, rest[1]), list_filter(rest[2:], lambda t: pow(t.row - rest[1].row, 2) + pow(t.col - rest[1].col, 2) >= 6.25) FROM step WHERE len(rest) > 0),
  thinned AS (SELECT t.row AS row, t.col AS col, t.value AS value FROM (SELECT unnest(kept) AS t FROM step WHERE len(rest) = 0))"""


@query("tao_candidates", _TOPS)
def _candidates(s, d):
    return trees.candidates(*_csm(s, d), 40.0)


def _tops(s, d):
    """Surface, grid and thinned tops, the surface written once."""
    c, g = _csm(s, d)
    c = materialize(c)
    return c, g, trees.identify(c, g, 40.0, 2.5)


def _forest(s, d):
    c, g, tops = _tops(s, d)
    tops = materialize(tops)
    return g, tops, trees.segments(c, tops, g, tile=256, cutoff=2.0, max_height=60.0)


@query("tao_thinned", f"{_THINNED} SELECT row, col, value FROM thinned")
def _thinned(s, d):
    """Greedy min-distance thinning."""
    return _tops(s, d)[2]


@query(
    "tao_unified_ids",
    f"""{_THINNED}, tiled AS (SELECT t.*, CAST(ceil((x1 - x0) / 64) AS BIGINT) AS across, CAST(ceil((x1 - x0) / 64) * ceil((y1 - y0) / 64) AS BIGINT) AS many FROM thinned t, lim),
    placed AS (SELECT row, col, value, many, CAST(row // 64 AS BIGINT) * across + col // 64 AS tile_id FROM tiled)
    SELECT row, col, value, tile_id, tile_id + 1 + many * (row_number() OVER (PARTITION BY tile_id ORDER BY value DESC, row, col) - 1) AS id FROM placed""",
)
def _unified(s, d):
    """Ids that no two tiles share."""
    _, g, tops = _tops(s, d)
    return trees.tree_ids(tops, g, tile=64)


# Files -----------------------------------------------------------------------------------------
@query(
    "las_scan",
    """SELECT return_number, classification, withheld, count(*) AS n, round(sum(round(x, 2)), 4) AS sx, round(sum(y), 4) AS sy, sum(z) AS sz, CAST(sum(least(intensity, 65535)) AS BIGINT) AS si
       FROM pts GROUP BY return_number, classification, withheld""",
)
def _las_scan(s, d):
    """The points written as LAS files and scanned back."""
    folder = f"{shared_root(s)}/las-{uuid.uuid4().hex}"
    pts = adapter.points(s, d).withColumn("number_of_returns", F.least("number_of_returns", F.lit(15)))
    write_las_files(pts, folder).write.format("noop").mode("overwrite").save()
    got = read_points(s, folder).groupBy("return_number", "classification", "withheld")
    out = got.agg(F.count("*").alias("n"), F.round(F.sum(F.round("x", 2)), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"), F.sum("z").alias("sz"), F.sum("intensity").alias("si"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("return_number", "classification")})


@query("las_headers", "SELECT count(*) AS n_points, round(min(x), 2) AS xmin, round(max(x), 2) AS xmax, round(min(y), 2) AS ymin, round(max(y), 2) AS ymax, min(z) AS zmin, max(z) AS zmax FROM pts")
def _las_headers(s, d):
    """Points written as LAS files; what their headers say together."""
    folder = f"{shared_root(s)}/las-{uuid.uuid4().hex}"
    pts = adapter.points(s, d).withColumn("number_of_returns", F.least("number_of_returns", F.lit(15)))
    write_las_files(pts, folder).write.format("noop").mode("overwrite").save()
    box = [f(c).alias(c) for c, f in (("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))]
    found = las_catalogue(s, folder).agg(F.sum("n_points").alias("n_points"), *box, F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax"))
    return found.withColumns({c: F.round(c, 2) for c in ("xmin", "xmax", "ymin", "ymax")})


@query("raster_scan", "SELECT row, col, round(value, 6) AS value FROM dem")
def _raster_scan(s, d):
    """The ground written as GeoTIFF tiles and all of them read back."""
    g = adapter.dem_grid(s, d)
    folder = f"{shared_root(s)}/tif-{uuid.uuid4().hex}"
    tiles = materialize(write_tiles(adapter.dem(s, d), g, folder, tile=16))
    return read_tiles(tiles, g).withColumn("value", F.round("value", 6))


from . import catalogue_files, catalogue_more, catalogue_streams, catalogue_systems  # noqa: E402, F401 - registers its queries here
