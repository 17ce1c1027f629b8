"""A sink of GeoTIFF tiles with a commit: ``df.write.format("raster_tiles")``.

Rows hold ``part`` (a folder below a layer's), ``tr``, ``tc`` (the tile), ``row``, ``col`` and a column for each layer; all layers of
a tile are written by one task.  A task writes under a folder of its own; files get their places when the whole
job commits, so failed, repeated and doubled tasks leave nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.crs import Crs
from ..functions.grid import Extent, Grid
from .files import delete_folder, move_file, write_file
from .rasters import tiff_bytes

KEYS = ("part", "tr", "tc", "row", "col")
TILE = 2048


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are, and where they belong."""

    files: list[tuple[str, str]]


class TileSink(DataSource):
    """Options: ``folder``, ``grid``, ``tile``, ``names`` (JSON: layer to file name), ``crs`` (WKT or code), ``compress``."""

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options, [f.name for f in schema.fields if f.name not in KEYS])


class TileWriter(DataSourceArrowWriter):
    def __init__(self, options, layers: list[str]):
        self.layers, self.folder, self.tile = layers, options["folder"], int(options.get("tile", TILE))
        x0, x1, y0, y1, nrow, ncol = json.loads(options["grid"])
        self.grid = Grid(Extent(x0, x1, y0, y1), nrow, ncol)
        self.names, self.crs = json.loads(options.get("names", "{}")), options.get("crs", "")
        self.compress = options.get("compress", "true").lower() == "true"
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def label(self, tr: int, tc: int) -> str:
        wide, high = len(str(-(-self.grid.ncol // self.tile))), len(str(-(-self.grid.nrow // self.tile)))
        return f"Col{tc + 1:0{wide}d}_Row{tr + 1:0{high}d}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own, g, t = f"{self.staging}/{uuid.uuid4().hex}", self.grid, self.tile
        crs = Crs.parse(self.crs)
        files: list[tuple[str, str]] = []
        held, arrays = None, {}

        def flush():
            if held is None:
                return
            part, tr, tc = held
            nrow, ncol = min(t, g.nrow - tr * t), min(t, g.ncol - tc * t)
            x, y = g.extent.xmin + tc * t * g.xres, g.extent.ymax - tr * t * g.yres
            box = Grid(Extent(x, x + ncol * g.xres, y - nrow * g.yres, y), nrow, ncol)
            for layer, v in arrays.items():
                if np.isnan(v).all():
                    continue
                place = "/".join(p for p in (self.folder, part, layer) if p) + f"/{self.names.get(layer, layer)}_{self.label(tr, tc)}.tif"
                path = f"{own}/{len(files)}.tif"
                write_file(path, tiff_bytes(v[:nrow, :ncol], box, crs, self.compress))
                files.append((path, place))

        for b in iterator:
            if not b.num_rows:
                continue
            c = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            part, tr, tc = c["part"].to_pylist(), c["tr"].to_numpy(), c["tc"].to_numpy()
            change = [k for k in range(1, len(part)) if part[k] != part[k - 1] or tr[k] != tr[k - 1] or tc[k] != tc[k - 1]]
            r, q = c["row"].to_numpy() - tr * t, c["col"].to_numpy() - tc * t
            values = {n: c[n].to_numpy(zero_copy_only=False).astype(float) for n in self.layers}
            for lo, hi in zip([0, *change], [*change, len(part)]):
                key = (part[lo], int(tr[lo]), int(tc[lo]))
                if key != held:
                    flush()
                    held, arrays = key, {n: np.full((t, t), np.nan) for n in self.layers}
                for n in self.layers:
                    arrays[n][r[lo:hi], q[lo:hi]] = values[n][lo:hi]
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        moves = [f for m in messages if m is not None for f in m.files]
        with ThreadPoolExecutor(min(32, len(moves) or 1)) as pool:
            list(pool.map(lambda f: move_file(*f), moves))
        delete_folder(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        delete_folder(self.staging)


def write_layers(df: DataFrame, grid: Grid, folder: str, layers: list[str], parts: list[str] = (), names: dict[str, str] | None = None, crs: Crs = Crs(), tile: int = TILE) -> None:
    """All layers of a raster table ``(row, col, *parts, *layers)`` as tiles, in one job and one shuffle.

    A layer's files are in ``folder/<parts>/<layer>``; a tile without a value in a layer has no file there.
    """
    df.sparkSession.dataSource.register(TileSink)
    part = F.concat_ws("/", *[F.col(f"`{p}`").cast("string") for p in parts]) if parts else F.lit("")
    at = [part.alias("part"), F.expr(f"cast(row div {tile} as int)").alias("tr"), F.expr(f"cast(col div {tile} as int)").alias("tc"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")]
    wide = df.select(*at, *[F.col(f"`{c}`").cast("double").alias(c) for c in layers])
    e = grid.extent
    options = {"folder": folder, "grid": json.dumps([e.xmin, e.xmax, e.ymin, e.ymax, grid.nrow, grid.ncol]), "tile": str(tile), "names": json.dumps(names or {}), "crs": crs.to_wkt() or (str(crs.epsg) if crs.epsg else "")}
    dealt = wide.repartition("part", "tr", "tc").sortWithinPartitions("part", "tr", "tc")
    dealt.write.format("raster_tiles").options(**options).mode("append").save()
