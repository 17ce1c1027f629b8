"""Registered queries over coordinate systems and projections; :mod:`catalogue` loads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import Crs, parsed_systems
from ..operators.points import reproject
from . import adapter
from .catalogue import query

# Texts of systems, one a supplier: four spellings of UTM zones on NAD83, some with heights of their own.
_GEO = 'GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4269"]]'
_ZONE = (
    f'PROJCS["UTM",{_GEO},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",%s],'
    'PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1,AUTHORITY["EPSG","9001"]]%s]'
)
_HEIGHTS = 'VERT_CS["NAVD88 height (ftUS)",VERT_DATUM["North American Vertical Datum 1988",2005,AUTHORITY["EPSG","5103"]],UNIT["US survey foot",0.304800609601219,AUTHORITY["EPSG","9003"]],AXIS["Up",UP],AUTHORITY["EPSG","6360"]]'


def system_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s_suppkey, crs_text)``: a code, WKT whose meridian is a hair off and that has no code, a compound WKT, a PROJ string."""
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    zone = F.lit(10) + F.col("s_nationkey") % 10
    meridian = 6 * zone - 183
    hair = F.concat(meridian.cast("string"), F.lit(".0000000"), (F.col("s_suppkey") % 4).cast("string"))
    code = F.lit(26900) + zone
    bare = F.format_string(_ZONE, hair, F.lit(""))
    named = F.format_string(_ZONE, meridian.cast("string"), F.concat(F.lit(',AUTHORITY["EPSG","'), code.cast("string"), F.lit('"]')))
    compound = F.concat(F.lit('COMPD_CS["both",'), named, F.lit(","), F.lit(_HEIGHTS), F.lit("]"))
    proj = F.format_string("+proj=utm +zone=%d +datum=NAD83 +units=m +no_defs", zone)
    kind = F.col("s_suppkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("EPSG:"), code.cast("string"))).when(kind == 1, bare).when(kind == 2, compound).otherwise(proj)
    return sup.select("s_suppkey", text.alias("crs_text"))


_SYSTEMS = """, sup AS (SELECT s_suppkey, 10 + s_nationkey % 10 AS zone, s_suppkey % 4 AS kind FROM supplier)"""


@query("crs_parsed", _SYSTEMS + """
    SELECT s_suppkey, CASE WHEN kind <> 1 THEN 26900 + zone END AS epsg, CASE WHEN kind = 2 THEN 6360 END AS vertical, 'tmerc' AS method, 'metre' AS xy_unit,
      CASE WHEN kind = 2 THEN 'us survey foot' ELSE 'metre' END AS z_unit, true AS readable FROM sup""")
def _parsed(s, d):
    """What each supplier's text defines; a compound text keeps its horizontal code and its unit of heights."""
    texts = system_texts(s, d)
    return texts.join(parsed_systems(texts, "crs_text"), "crs_text").select("s_suppkey", "epsg", "vertical", "method", "xy_unit", "z_unit", "readable")


@query("crs_groups", _SYSTEMS + """
    SELECT min(s_suppkey) AS first, count(*) AS n, max(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS feet FROM sup GROUP BY zone, kind = 2""")
def _groups(s, d):
    """Systems that agree within the tolerances, whatever their spelling, counted together."""
    texts = system_texts(s, d)
    of = texts.join(parsed_systems(texts, "crs_text"), "crs_text")
    return of.groupBy("crs_key").agg(F.min("s_suppkey").alias("first"), F.count("*").alias("n"), F.max((F.col("z_unit") != "metre").cast("int")).alias("feet")).drop("crs_key")


# Projections -------------------------------------------------------------------------------------
# The formulas of the twins, over degrees ``lon`` and ``lat`` of the points.
_PLACES = """, deg AS (SELECT pid, lno, -123.5 + x * CAST(0.0005 AS DOUBLE) AS lon, 45.6 + y * CAST(0.0005 AS DOUBLE) AS lat FROM pts),
    e AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE AS f),
    e2 AS (SELECT a, f, sqrt(f * (2 - f)) AS e, f / (2 - f) AS n, 1200 / 3937::DOUBLE AS ft FROM e)"""
_TM = """, tm AS (SELECT *, 2 * sqrt(n) / (1 + n) AS c, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r,
      n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM e2),
    t1 AS (SELECT pid, lno, tm.*, radians(lon - ({lon0})) AS l, sinh(atanh(sin(radians(lat))) - c * atanh(c * sin(radians(lat)))) AS t FROM {src}, tm),
    t2 AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t1),
    t3 AS (SELECT pid, lno,
      500000 + 0.9996 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x,
      0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y FROM t2)"""
_LCC = """, ang AS (SELECT *, radians(47 + 20 / 60::DOUBLE) AS p1, radians(45 + 50 / 60::DOUBLE) AS p2, radians(45 + 20 / 60::DOUBLE) AS p0 FROM e2),
    mt AS (SELECT *, cos(p1) / sqrt(1 - (e * sin(p1)) ** 2) AS m1, cos(p2) / sqrt(1 - (e * sin(p2)) ** 2) AS m2,
      exp(e * atanh(e * sin(p1)) - atanh(sin(p1))) AS t1, exp(e * atanh(e * sin(p2)) - atanh(sin(p2))) AS t2, exp(e * atanh(e * sin(p0)) - atanh(sin(p0))) AS t0 FROM ang),
    cone AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM (SELECT * EXCLUDE (n) FROM mt)),
    sc AS (SELECT *, a * m1 / (n * t1 ** n) AS af FROM cone)"""


def _degrees(s, d) -> DataFrame:
    """The points' places as degrees."""
    at = {"x": F.lit(-123.5) + F.col("x") * F.lit(0.0005), "y": F.lit(45.6) + F.col("y") * F.lit(0.0005)}
    return adapter.points(s, d).select("pid", "lno", "x", "y", "z").withColumns(at)


def _tenths(df: DataFrame) -> DataFrame:
    """To a tenth of a unit: twins compute with another library's functions."""
    return df.select("pid", "lno", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query("project_utm", _PLACES + _TM.format(lon0=-123, src="deg") + " SELECT pid, lno, round(x, 1) AS x, round(y, 1) AS y FROM t3")
def _utm(s, d):
    """Degrees to UTM zone 10."""
    return _tenths(reproject(_degrees(s, d), Crs(4269), Crs(26910)))


@query("project_state_plane", _PLACES + _LCC + """
    SELECT pid, lno, round((500000 + af * exp(n * (e * atanh(e * sin(radians(lat))) - atanh(sin(radians(lat))))) * sin(n * radians(lon + 120.5))) / ft, 1) AS x,
      round((af * t0 ** n - af * exp(n * (e * atanh(e * sin(radians(lat))) - atanh(sin(radians(lat))))) * cos(n * radians(lon + 120.5))) / ft, 1) AS y FROM deg, sc""")
def _state_plane(s, d):
    """Degrees to Washington South in survey feet, a conformal conic with two parallels."""
    return _tenths(reproject(_degrees(s, d), Crs(4152), Crs(2927)))


@query("project_plane_to_zone", _PLACES + _LCC + """,
    pl AS (SELECT pid, lno, (CAST(pid % 1000 AS DOUBLE) * 50 + 1000000) * ft - 500000 AS dx, af * t0 ** n - (CAST(lno AS DOUBLE) * 500 + 400000) * ft AS dy, n, af, e FROM pts, sc),
    inv AS (SELECT pid, lno, -120.5 + degrees(atan2(dx, dy) / n) AS lon, pi() / 2 - 2 * atan((sqrt(dx * dx + dy * dy) / af) ** (1 / n)) AS chi, e * e AS q FROM pl),
    geo AS (SELECT pid, lno, lon, degrees(chi + (q / 2 + 5 * q ** 2 / 24 + q ** 3 / 12 + 13 * q ** 4 / 360) * sin(2 * chi) + (7 * q ** 2 / 48 + 29 * q ** 3 / 240 + 811 * q ** 4 / 11520) * sin(4 * chi)
      + (7 * q ** 3 / 120 + 81 * q ** 4 / 1120) * sin(6 * chi) + 4279 * q ** 4 / 161280 * sin(8 * chi)) AS lat FROM inv)""" + _TM.format(lon0=-123, src="geo") + """
    SELECT pid, lno, round(x, 1) AS x, round(y, 1) AS y FROM t3""")
def _plane_to_zone(s, d):
    """Washington South in survey feet to UTM zone 10 in metres, by way of degrees."""
    p = adapter.points(s, d).select("pid", "lno", ((F.col("pid") % 1000).cast("double") * 50 + 1000000).alias("x"), (F.col("lno").cast("double") * 500 + 400000).alias("y"), "z")
    return _tenths(reproject(p, Crs(2927), Crs(26910)))
