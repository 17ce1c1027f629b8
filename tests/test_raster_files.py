"""GeoTIFF variants, systems in their keys, and the sink of tiles with its commit."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcanopy.functions.crs import Crs
from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.sources import raster_sink, rasters
from gridcanopy.sources.raster_sink import TileWriter, write_layers
from gridcanopy.sources.rasters import raster_crs, raster_grid, read_rows, tiff_bytes, unpack_lzw


def _pack_lzw(data: bytes) -> bytes:
    """Codes of growing width, as a writer of TIFF makes them."""
    table, codes, word = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    n, width = 258, 9
    for k in data:
        c = bytes([k])
        if word + c in table:
            word += c
            continue
        codes.append((table[word], width))
        table[word + c] = n
        n += 1
        width = min(12, n.bit_length())
        if n == 4094:
            codes.append((256, width))
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = c
    codes += [(table[word], width)] if word else []
    n += 1
    codes.append((257, min(12, n.bit_length()) if word else width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def _tiff(values, packing=1, predictor=1, point=False, matrix=None, kind="<f4"):
    """One strip of a raster whose upper left is at (100, 50), cells of 2."""
    v = np.asarray(values, kind)
    raw = v.tobytes()
    if predictor == 3:
        order = np.ascontiguousarray(v.astype(v.dtype.newbyteorder(">"))).view("u1").reshape(v.shape[0], v.shape[1], v.itemsize)
        rows = np.ascontiguousarray(order.transpose(0, 2, 1)).reshape(v.shape[0], -1)
        raw = np.diff(rows, axis=1, prepend=np.zeros((len(rows), 1), "u1")).astype("u1").tobytes()
    elif predictor == 2:
        w = v.view(f"u{v.itemsize}")
        raw = np.diff(w, axis=1, prepend=np.zeros((len(w), 1), w.dtype)).astype(w.dtype).tobytes()
    raw = zlib.compress(raw) if packing == 8 else _pack_lzw(raw) if packing == 5 else raw
    keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 2 if point else 1)
    place = {34264: (12, 16, struct.pack("<16d", *matrix))} if matrix else {33550: (12, 3, struct.pack("<3d", 2, 2, 0)), 33922: (12, 6, struct.pack("<6d", 0, 0, 0, 100, 50, 0))}
    blobs = place | {34735: (3, 12, keys)}
    sample = {"f": 3, "u": 1, "i": 2}[v.dtype.kind]
    short = {256: v.shape[1], 257: v.shape[0], 258: 8 * v.itemsize, 259: packing, 277: 1, 278: v.shape[0], 279: len(raw), 317: predictor, 339: sample, 273: 0}
    n = len(short) + len(blobs)
    at, tail, where = 8 + 2 + 12 * n + 4, b"", {}
    for tag, (_, _, blob) in blobs.items():
        where[tag] = at + len(tail)
        tail += blob
    short[273] = at + len(tail)
    out = b"II" + struct.pack("<HIH", 42, 8, n)
    for tag in sorted([*short, *blobs]):
        out += struct.pack("<HHII", tag, 4, 1, short[tag]) if tag in short else struct.pack("<HHII", tag, blobs[tag][0], blobs[tag][1], where[tag])
    return out + b"\0" * 4 + tail + raw


@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("predictor,kind", [(1, "<f4"), (3, "<f4"), (3, "<f8"), (2, "<i2"), (1, "u1")])
def test_packings_and_predictors(tmp_path, packing, predictor, kind):
    rng = np.random.default_rng(packing)
    v = np.round(rng.uniform(0, 200, (60, 90))).astype(kind) if np.dtype(kind).kind != "f" else rng.normal(100, 5, (60, 90)).astype(kind)
    (tmp_path / "a.tif").write_bytes(_tiff(v, packing, predictor, kind=kind))
    np.testing.assert_array_equal(read_rows(f"{tmp_path}/a.tif", 0, 59)[1], v.astype(float))


def test_lzw_of_many_lengths():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300, 5000, 60_000):
        for data in (bytes(n), rng.integers(0, 256, n, np.uint8).tobytes(), bytes(rng.integers(0, 3, n, np.uint8))):
            assert unpack_lzw(_pack_lzw(data)) == data


def test_places_of_cells(tmp_path):
    """The corner, the centre, and a matrix give boxes that differ by half a cell."""
    v = np.zeros((3, 4), "<f4")
    for name, raw, box in (
        ("area", _tiff(v), (100, 108, 44, 50)), ("point", _tiff(v, point=True), (99, 107, 45, 51)),
        ("matrix", _tiff(v, matrix=[2, 0, 0, 100, 0, -2, 0, 50, 0, 0, 0, 0, 0, 0, 0, 1]), (100, 108, 44, 50)),
    ):
        (tmp_path / f"{name}.tif").write_bytes(raw)
        e = raster_grid(f"{tmp_path}/{name}.tif").extent
        assert (e.xmin, e.xmax, e.ymin, e.ymax) == box, name
    (tmp_path / "turned.tif").write_bytes(_tiff(v, matrix=[2, 1, 0, 100, 1, -2, 0, 50, 0, 0, 0, 0, 0, 0, 0, 1]))
    with pytest.raises(ValueError, match="turned"):
        raster_grid(f"{tmp_path}/turned.tif")


@pytest.mark.parametrize("text", ["26910", "4326", "2927+5703", "26910+6360", "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96 +x_0=1000 +datum=NAD83 +units=us-ft", "+proj=tmerc +lat_0=10 +lon_0=20 +k=0.9999 +x_0=5 +y_0=7 +ellps=intl", "5070"])
def test_systems_in_keys(tmp_path, text):
    crs = Crs.parse(text)
    (tmp_path / "a.tif").write_bytes(tiff_bytes(np.zeros((2, 2)), Grid(Extent(0, 2, 0, 2), 2, 2), crs))
    again = raster_crs(f"{tmp_path}/a.tif")
    assert again.same_place(crs) and again.geographic == crs.geographic and again.vertical == crs.vertical
    assert again.z_unit.consistent(crs.z_unit) and again.epsg == crs.epsg


def test_sink_writes_all_layers_of_a_tile_in_one_job(spark, tmp_path):
    g = Grid(Extent(0, 5, 0, 4), 4, 5)
    rows = [(r, c, p, float(10 * r + c), r if c else None, None) for r in range(4) for c in range(5) for p in ("ALL", "FIRST")]
    df = spark.createDataFrame(rows, "row int, col int, return_type string, a double, b int, none double")
    write_layers(df, g, str(tmp_path), ["a", "b", "none"], ["return_type"], {"a": "run_a_Meters"}, Crs(26910), tile=3)
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.tif"))
    assert len(files) == 2 * 2 * 4 and files[0] == "ALL/a/run_a_Meters_Col1_Row1.tif" and not list(tmp_path.glob("_staging*")) and not list(tmp_path.rglob("none"))
    grid, v = read_rows(f"{tmp_path}/FIRST/b/b_Col2_Row2.tif", 0, 0)
    assert grid.extent == Extent(3, 5, 0, 1) and v.tolist() == [[3.0, 3.0]] and raster_crs(f"{tmp_path}/ALL/a/run_a_Meters_Col1_Row1.tif").epsg == 26910
    tiles = spark.createDataFrame([(str(p),) for p in (tmp_path / "ALL" / "a").glob("*.tif")], "path string")
    back = rasters.read_tiles(tiles, g)
    assert {tuple(r) for r in back.collect()} == {(r, c, float(10 * r + c)) for r in range(4) for c in range(5)}


def test_failed_and_doubled_tasks_leave_nothing(spark, tmp_path, monkeypatch):
    g = Grid(Extent(0, 4, 0, 4), 4, 4)
    bad = spark.range(16).select(F.expr("cast(id div 4 as int)").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.when(F.col("id") == 15, F.raise_error(F.lit("lost"))).otherwise(1.0).cast("double").alias("v"))
    with pytest.raises(Exception, match="lost"):
        write_layers(bad, g, str(tmp_path / "bad"), ["v"], tile=2)
    assert not list(tmp_path.rglob("*.tif"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"part": [""] * 2, "tr": [0, 0], "tc": [0, 0], "row": [0, 1], "col": [0, 1], "v": [1.0, 2.0]})
    writer = TileWriter({"folder": str(tmp_path / "two"), "grid": "[0, 4, 0, 4, 4, 4]", "tile": "4"}, ["v"])
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))  # one of them is lost or a double
    assert first.files[0][0] != second.files[0][0] and first.files[0][1] == second.files[0][1]
    writer.commit([second])
    assert [p.name for p in (tmp_path / "two").rglob("*.tif")] == ["v_Col1_Row1.tif"] and raster_sink.TILE == 2048
