"""Raster files: ESRI ASCII grids and one-band GeoTIFF as tidy rasters; sinks for both and for tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import Crs, from_geo_keys, geo_keys, to_geo_keys
from ..functions.grid import Extent, Grid
from ..functions.units import LinearUnit
from .files import exists, file_size, read_range, write_file
from .las import read_header

NO_DATA = -9999.0
#: Values under this are no data whatever the header says.
NO_DATA_BELOW = -2_000_000.0
#: Files that hold no pixels of their own.
SIDE_FILES = (".aux", ".ovr", ".adf", ".xml")


def no_data(v: np.ndarray, missing: float | None) -> np.ndarray:
    out = np.isnan(v) | (v < NO_DATA_BELOW)
    return out if missing is None else out | (v == missing)


def raster_grid(path: str) -> Grid:
    """The grid of a raster file, from its header."""
    return _ascii_head(path)[0] if path.lower().endswith(".asc") else _tiff_head(path)[0]


def raster_crs(path: str) -> Crs:
    """The system of a raster file: by a GeoTIFF's keys, else by the ``.prj`` file beside it; else unknown."""
    if not path.lower().endswith(".asc"):
        tags = _tiff_head(path)[2]
        crs = from_geo_keys(geo_keys(tags.get(34735, ()), tags.get(34736, ()), tags.get(34737, "")))
        if crs.known:
            return crs
    return prj_crs(path)


def prj_crs(path: str) -> Crs:
    """The system of the ``.prj`` file of the same name, unknown where there is none."""
    beside = path.rpartition(".")[0] + ".prj"
    if not exists(beside):
        return Crs()
    return Crs.parse(read_range(beside, 0, 1 << 20).decode("utf-8", "replace"))


def raster_epsg(path: str) -> int:
    """The EPSG code of a raster file's system; 0 where none is stated."""
    return raster_crs(path).epsg


def crs_of(text: str, z_unit: LinearUnit | None = None) -> Crs:
    """The system that a text states, or that of the point, raster or ``.prj`` file it names."""
    ending = text.lower().rpartition(".")[2] if "." in text and not text.rstrip().endswith("]") else ""
    if ending in ("las", "laz"):
        crs = read_header(text).crs
    elif ending in ("tif", "tiff", "asc"):
        crs = raster_crs(text)
    elif ending in ("prj", "shp"):
        crs = prj_crs(text)
    else:
        return Crs.parse(text, z_unit)
    return replace(crs, z_unit=z_unit) if z_unit is not None and z_unit.metres else crs


def file_extent(path: str) -> Extent:
    """The extent of a point, vector or raster file, from its header."""
    if path.lower().endswith(".shp"):
        from .vectors import shape_extent

        return Extent(*shape_extent(path)[1:], prj_crs(path).epsg or None)
    if path.lower().endswith((".las", ".laz")):
        h = read_header(path)
        return Extent(h.low[0], h.high[0], h.low[1], h.high[1], h.crs.epsg or None)
    return raster_grid(path).extent


def _ascii_head(path: str) -> tuple[Grid, float, int]:
    raw = read_range(path, 0, 4096).decode("ascii", "replace")
    head, at = {}, 0
    for line in raw.splitlines(keepends=True):
        parts = line.split()
        if len(parts) != 2 or not parts[0][:1].isalpha():
            break
        head[parts[0].lower()] = float(parts[1])
        at += len(line)
    nrow, ncol, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    x = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2)
    y = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2)
    return Grid(Extent(x, x + ncol * size, y, y + nrow * size), nrow, ncol), head.get("nodata_value", NO_DATA), at


# Fixed values of the format: bytes and struct code of a tag's type; sample format and bits to numpy.
TIFF_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)
HORIZONTAL, FLOATING = 2, 3
#: Bytes of a strip that :func:`tiff_bytes` writes.
STRIP_BYTES = 1 << 20


def _tiff_head(path: str) -> tuple[Grid, float | None, dict]:
    """Grid, no-data value and tags of a classic or big TIFF file in strips or tiles, plain or deflated."""
    start = read_range(path, 0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError(f"{path} is no TIFF file")
    big = kind == 43
    at = struct.unpack(order + "Q", start[8:16])[0] if big else struct.unpack(order + "I", start[4:8])[0]
    wide, entry, place = (8, 20, "Q") if big else (2, 12, "I")
    count = struct.unpack(order + ("Q" if big else "H"), read_range(path, at, wide))[0]
    block = read_range(path, at + wide, entry * count)
    room = 8 if big else 4
    tags = {}
    for k in range(count):
        tag, code, n = struct.unpack_from(order + "HH" + place, block, entry * k)
        if code not in TIFF_TYPES:
            continue
        value = block[entry * (k + 1) - room : entry * (k + 1)]
        size = n * TIFF_TYPES[code][0]
        data = value[:size] if size <= room else read_range(path, struct.unpack(order + place, value)[0], size)
        text = code == 2
        tags[tag] = data.rstrip(b"\0").decode("ascii", "replace") if text else struct.unpack(f"{order}{n}{TIFF_TYPES[code][1]}", data)
    if tags.get(259, (1,))[0] not in (PLAIN, LZW, *DEFLATE) or tags.get(317, (1,))[0] not in (1, HORIZONTAL, FLOATING) or tags.get(277, (1,))[0] != 1:
        raise ValueError(f"{path}: one band, plain, deflated or LZW, is what is supported")
    ncol, nrow = tags[256][0], tags[257][0]
    if 34264 in tags:  # a matrix from cells to coordinates
        m = tags[34264]
        if m[1] or m[4]:
            raise ValueError(f"{path}: turned rasters are not supported")
        sx, sy, x, y = m[0], -m[5], m[3], m[7]
    else:
        sx, sy, _ = tags[33550]
        i, j, _, x, y, _ = tags[33922][:6]
        x, y = x - i * sx, y + j * sy
    if geo_keys(tags.get(34735, ())).get(1025) == 2:  # the place is that of a cell's centre
        x, y = x - sx / 2, y + sy / 2
    tags["dtype"] = order + SAMPLES[(tags.get(339, (1,))[0], tags[258][0])]
    missing = float(tags[42113]) if tags.get(42113) else None
    return Grid(Extent(x, x + ncol * sx, y - nrow * sy, y), nrow, ncol), missing, tags


def _tiff_block(path: str, tags: dict, at: int, size: int, width: int) -> np.ndarray:
    """One strip or tile as rows of ``width`` samples."""
    raw = read_range(path, at, size)
    packing = tags.get(259, (1,))[0]
    raw = zlib.decompress(raw) if packing in DEFLATE else unpack_lzw(raw) if packing == LZW else raw
    kind = np.dtype(tags["dtype"])
    raw = raw[: len(raw) // (kind.itemsize * width) * kind.itemsize * width]
    predictor = tags.get(317, (1,))[0]
    if predictor == FLOATING:  # bytes of a row by significance, each the difference to the one before
        rows = np.cumsum(np.frombuffer(raw, "u1").reshape(-1, width * kind.itemsize), 1, dtype=np.uint8)
        bytes_of = rows.reshape(-1, kind.itemsize, width).transpose(0, 2, 1)
        return np.ascontiguousarray(bytes_of).view(kind.newbyteorder(">")).reshape(-1, width).astype(float)
    v = np.frombuffer(raw, kind).reshape(-1, width)
    if predictor == HORIZONTAL:
        whole = np.dtype(f"u{kind.itemsize}")
        v = np.cumsum(v.astype(kind.newbyteorder("=")).view(whole), 1, dtype=whole).view(kind.newbyteorder("="))
    return v.astype(float)


def unpack_lzw(raw: bytes) -> bytes:
    """The bytes of an LZW strip: codes of 9 to 12 bits, high bits first; 256 starts anew, 257 ends."""
    singles = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out = list(singles), []
    bits = held = 0
    width, last = 9, b""
    for byte in raw:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(singles), 9, b""
            continue
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            width = min(12, (len(table) + 1).bit_length())
        out.append(word)
        last = word
    return b"".join(out)


def read_rows(path: str, first: int, last: int) -> tuple[Grid, np.ndarray]:
    """Rows ``first`` to ``last`` as doubles, no data as NaN; TIFF reads only the strips or tiles they lie in."""
    if path.lower().endswith(".asc"):
        grid, missing, at = _ascii_head(path)
        body = read_range(path, at, file_size(path) - at)
        v = np.array(body.split(), float).reshape(grid.nrow, grid.ncol)[first : last + 1]
    else:
        grid, missing, tags = _tiff_head(path)
        tiled = 322 in tags
        width, per = (tags[322][0], tags[323][0]) if tiled else (grid.ncol, tags.get(278, (grid.nrow,))[0])
        starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        across = -(-grid.ncol // width)
        bands = []
        for k in range(first // per, last // per + 1):
            row = [_tiff_block(path, tags, starts[n], sizes[n], width) for n in range(k * across, (k + 1) * across)]
            bands.append(np.hstack(row)[:, : grid.ncol])
        v = np.concatenate(bands)[first - first // per * per :][: last - first + 1]
    return grid, np.where(no_data(v, missing), np.nan, v)


def read_raster(spark: SparkSession, path: str, window: Extent | None = None, rows_per_task: int = 512) -> tuple[DataFrame, Grid]:
    """A tidy raster and its grid; with a window only its rows are read and only its cells returned.

    Row and column numbers are those of the returned grid.
    """
    grid = raster_grid(path)
    r0, r1, c0, c1 = grid.rows_cols(window) if window else (0, grid.nrow - 1, 0, grid.ncol - 1)
    blocks = [(r, min(r + rows_per_task - 1, r1)) for r in range(r0, r1 + 1, rows_per_task)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = read_rows(path, a, z)[1][:, c0 : c1 + 1]
                r, c = np.nonzero(~np.isnan(v))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((r + a - r0).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(v[r, c])], names=["row", "col", "value"]
                )

    tasks = spark.createDataFrame(blocks, "a int, z int").repartition(len(blocks), "a")
    return tasks.mapInArrow(run, "row int, col int, value double"), grid.crop(window) if window else grid


def tiff_bytes(values: np.ndarray, grid: Grid, epsg: int | Crs | None = None, compress: bool = False) -> bytes:
    """A GeoTIFF of doubles in strips of about STRIP_BYTES; NaN becomes the no-data value.

    ``epsg``: a code or a system, written as keys of its kind.
    """
    data = np.where(np.isnan(values), NO_DATA, values).astype("<f8")
    per = max(1, min(grid.nrow, STRIP_BYTES // (8 * grid.ncol)))
    strips = [data[k : k + per].tobytes() for k in range(0, grid.nrow, per)]
    strips = [zlib.compress(x) for x in strips] if compress else strips
    missing = str(NO_DATA).encode() + b"\0"
    directory, doubles = to_geo_keys(epsg if isinstance(epsg, Crs) else Crs(epsg or 0))
    keys = struct.pack(f"<{len(directory)}H", *directory)
    scale = struct.pack("<3d", grid.xres, grid.yres, 0)
    tie = struct.pack("<6d", 0, 0, 0, grid.extent.xmin, grid.extent.ymax, 0)
    sizes = [len(x) for x in strips]
    blobs = {33550: (12, 3, scale), 33922: (12, 6, tie), 34735: (3, len(directory), keys), 42113: (2, len(missing), missing)}
    if doubles:
        blobs[34736] = (12, len(doubles), struct.pack(f"<{len(doubles)}d", *doubles))
    short = {256: grid.ncol, 257: grid.nrow, 258: 64, 259: DEFLATE[0] if compress else PLAIN, 262: 1, 277: 1, 278: per, 339: 3}
    n = len(short) + len(blobs) + 2
    body = 8 + 2 + 12 * n + 4 + sum(len(b) + -len(b) % 8 for _, _, b in blobs.values())
    if len(strips) > 1:  # their places and sizes do not fit into the entries
        body += 2 * (4 * len(strips) + 4 * len(strips) % 8)
    starts = np.cumsum([body, *sizes[:-1]]).tolist()
    if len(strips) > 1:
        blobs |= {t: (4, len(strips), struct.pack(f"<{len(strips)}I", *v)) for t, v in ((273, starts), (279, sizes))}
    else:
        short |= {273: starts[0], 279: sizes[0]}
    at = 8 + 2 + 12 * n + 4
    place, tail = {}, b""
    for tag, (_, _, blob) in blobs.items():
        place[tag] = at + len(tail)
        tail += blob + b"\0" * (-len(blob) % 8)
    out = b"II" + struct.pack("<HIH", 42, 8, n)
    for tag in sorted([*short, *blobs]):
        out += struct.pack("<HHII", tag, 4, 1, short[tag]) if tag in short else struct.pack("<HHII", tag, blobs[tag][0], blobs[tag][1], place[tag])
    return out + b"\0" * 4 + tail + b"".join(strips)


def write_tiles(raster: DataFrame, grid: Grid, folder: str, tile: int = 2048, name: str = "raster", epsg: int | Crs | None = None) -> DataFrame:
    """Write GeoTIFF tiles from the executors, one task a tile: the written ``(name, path)`` rows.

    Nothing is collected; a tile holds ``tile`` squared cells at most.  A retried task overwrites.
    """
    import pandas as pd

    across, down = -(-grid.ncol // tile), -(-grid.nrow // tile)
    wide, high = len(str(across)), len(str(down))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        nrow, ncol = min(tile, grid.nrow - tr * tile), min(tile, grid.ncol - tc * tile)
        v = np.full((nrow, ncol), np.nan)
        v[pdf["row"].to_numpy() - tr * tile, pdf["col"].to_numpy() - tc * tile] = pdf["value"].to_numpy()
        e = grid.extent
        box = Extent(e.xmin + tc * tile * grid.xres, e.xmin + (tc * tile + ncol) * grid.xres, e.ymax - (tr * tile + nrow) * grid.yres, e.ymax - tr * tile * grid.yres)
        label = f"Col{tc + 1:0{wide}d}_Row{tr + 1:0{high}d}"
        path = f"{folder}/{name}_{label}.tif"
        write_file(path, tiff_bytes(v, Grid(box, nrow, ncol), epsg))
        return pd.DataFrame({"name": [label], "path": [path]})

    at = raster.where("value is not null").withColumns({"tr": F.expr(f"row div {tile}"), "tc": F.expr(f"col div {tile}")})
    return at.select("row", "col", "value", "tr", "tc").groupBy("tr", "tc").applyInPandas(run, "name string, path string")


def read_tiles(tiles: DataFrame, grid: Grid, rows_per_step: int = 512) -> DataFrame:
    """The cells of all tile files (column ``path``) by their place in ``grid``; one task reads whole tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                own = raster_grid(path)
                r0, c0 = round((grid.extent.ymax - own.extent.ymax) / grid.yres), round((own.extent.xmin - grid.extent.xmin) / grid.xres)
                for first in range(0, own.nrow, rows_per_step):
                    v = read_rows(path, first, min(own.nrow, first + rows_per_step) - 1)[1]
                    r, c = np.nonzero(~np.isnan(v))
                    cols = [pa.array((r + r0 + first).astype(np.int32)), pa.array((c + c0).astype(np.int32)), pa.array(v[r, c])]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "col", "value"])

    return tiles.select("path").mapInArrow(run, "row int, col int, value double")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """The default sink: Parquet, replaced as a whole, partitioned where readers prune."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def layout_polygons(tiles: DataFrame, layout: Grid) -> DataFrame:
    """``(name, id, column, row, wkt)``: tile outlines, counted from one."""
    x0, y1 = layout.x() - layout.xres / 2, layout.y() + layout.yres / 2
    x1, y0 = x0 + layout.xres, y1 - layout.yres
    ring = F.concat_ws(", ", *[F.concat_ws(" ", a, b) for a, b in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))])
    return tiles.select("name", (F.col("tile_id") + 1).alias("id"), (F.col("col") + 1).alias("column"), (F.col("row") + 1).alias("row"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))
