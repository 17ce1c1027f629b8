"""Registered queries over streams: what comes out when nothing can be added; :mod:`catalogue` loads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.lineage import shared_root
from ..streaming.ingest import cells_of, completed_blocks, completed_ground
from . import adapter
from .catalogue import query


def _through(s, rows: DataFrame, make, at: str) -> DataFrame:
    """What a stream of the rows, written as files, gives."""
    rows.write.parquet(f"{at}/in")
    out = make(s.readStream.schema(rows.schema).parquet(f"{at}/in"))
    sink = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(f"{at}/out")


_STRIPS = """, strip AS (SELECT x, y, CAST(least(floor((y - y0) / (y1 - y0) * 8), 7) AS INTEGER) AS fid FROM pts, lim),
    box AS (SELECT fid, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM strip GROUP BY fid),
    cov AS (SELECT fid, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT box.*, unnest(generate_series(CAST(floor(y1 - by1 + 1e-9) AS BIGINT), CAST(ceil(y1 - by0 - 1e-9) AS BIGINT) - 1)) AS r, x0 FROM box, lim) q,
      generate_series(0, 1000000) AS g(c) WHERE c BETWEEN floor(bx0 - x0 + 1e-9) AND ceil(bx1 - x0 - 1e-9) - 1),
    done AS (SELECT row, col FROM cov GROUP BY row, col HAVING count(*) FILTER (fid IN (3, 6)) = 0)"""


@query(
    "ingest_incomplete_cells",
    _STRIPS + """ SELECT d.row, d.col, count(f.z) AS n, CASE WHEN count(f.z) > 0 THEN round(100.0 * count(*) FILTER (f.z >= 2) / count(f.z), 6) END AS cover,
      round(avg(f.z) FILTER (f.z >= 2), 6) AS mean, max(f.z) FILTER (f.z >= 2) AS top FROM done d LEFT JOIN f ON f.row = d.row AND f.col = d.col GROUP BY d.row, d.col""",
)
def _incomplete(s, d):
    """Points in strips: one strip comes in half, one not at all, and the cells that either covers stay away."""
    g, e = adapter.grid(s, d, 1), adapter.extent(s, d)
    strip = F.least(F.floor((F.col("y") - F.lit(float(e.ymin))) / F.lit(float(e.ymax - e.ymin)) * 8), F.lit(7)).cast("int")
    p = adapter.points(s, d).withColumn("file", strip)
    files = p.groupBy("file").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    there = p.where("file <> 6 and (file <> 3 or lno % 2 = 0)")
    rows = there.select("file", "x", "y", "z", F.lit(False).alias("last"), adapter.kept().alias("kept"))
    nothing = F.lit(None).cast("double")
    ends = files.where("file not in (3, 6)").select("file", nothing.alias("x"), nothing.alias("y"), nothing.alias("z"), F.lit(True).alias("last"), F.lit(None).cast("boolean").alias("kept"))
    at = f"{shared_root(s)}/state-{uuid.uuid4().hex}"
    return cells_of(_through(s, rows.unionByName(ends), lambda x: completed_blocks(x, files, g, keep=F.col("kept")), at))


@query(
    "elevation_complete",
    """, z AS (SELECT *, greatest(nrow // 2, 1) AS zn FROM dg),
    placed AS (SELECT row, col, CAST(least(floor((row + 0.5) * yr / ((y1 - y0) / zn)), zn - 1) AS INTEGER) AS zr, col // 2 AS zc FROM z, generate_series(0, 1000000) AS a(row), generate_series(0, 39) AS b(col) WHERE row < nrow),
    ground AS (SELECT row, col, CASE WHEN (row + col) % 3 < 2 THEN value ELSE value + 1 END AS value FROM dem)
    SELECT zr AS row, CAST(zc AS INTEGER) AS col, round(avg(g.value), 6) AS value, count(*) AS n FROM placed p LEFT JOIN ground g ON p.row = g.row AND p.col = g.col
    GROUP BY zr, zc HAVING count(g.value) = count(*)""",
)
def _elevation_complete(s, d):
    """Two ground files that overlap: zones with a hole stay away, and the first file's value of a cell counts."""
    g = adapter.dem_grid(s, d)
    zones = Grid(g.extent, max(g.nrow // 2, 1), 20)
    dem = adapter.dem(s, d)
    third = (F.col("row") + F.col("col")) % 3
    one = dem.where(third < 2).withColumn("ord", F.lit(0))
    two = dem.where(third >= 1).select("row", "col", (F.col("value") + 1).alias("value"), F.lit(1).alias("ord"))
    at = f"{shared_root(s)}/state-{uuid.uuid4().hex}"
    return _through(s, one.unionByName(two), lambda x: completed_ground(x, g, zones), at)
