"""Files written here and read back, options, a whole run, and incremental ingest."""

import json
import struct

import numpy as np
import pytest
from raster_rows import cells, tidy

from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.operators import metrics
from gridcanopy.plans import lifecycle
from gridcanopy.plans.config import RunConfig, parse_args
from gridcanopy.sources.files import find_files
from gridcanopy.sources.las import las_catalogue, read_header, read_points, write_las
from gridcanopy.sources.rasters import layout_polygons, raster_grid, read_raster, tiff_bytes, write_tiles
from gridcanopy.streaming import ingest

WKT = 'PROJCS["UTM",AUTHORITY["EPSG","32610"]]'


def cloud(n=500, seed=0, size=20.0):
    rng = np.random.default_rng(seed)
    return {
        "x": np.round(rng.uniform(0, size, n), 2), "y": np.round(rng.uniform(0, size, n), 2), "z": np.round(rng.uniform(0, 30, n), 2),
        "intensity": rng.integers(0, 999, n), "return_number": rng.integers(1, 4, n), "number_of_returns": np.full(n, 3),
        "classification": rng.integers(0, 20, n), "withheld": rng.random(n) < 0.1, "scan_angle": rng.integers(-30, 30, n),
    }


@pytest.mark.parametrize("kind", [0, 1, 3, 6, 7])
def test_las_round_trip(spark, tmp_path, kind):
    c = cloud(seed=kind)
    write_las(f"{tmp_path}/a.las", c, kind, wkt=WKT)
    h = read_header(f"{tmp_path}/a.las")
    assert (h.n_points, h.point_format, h.crs.epsg) == (500, kind, 32610)
    got = read_points(spark, str(tmp_path), recordsPerPartition="120").toPandas()
    assert len(got) == 500
    for name in c:
        assert np.allclose(np.sort(got[name].astype(float)), np.sort(np.asarray(c[name], float)), atol=0.006), name


def test_las_damage(spark, tmp_path):
    write_las(f"{tmp_path}/a.las", cloud(50))
    raw = bytearray((tmp_path / "a.las").read_bytes())
    struct.pack_into("<i", raw, 375, 10**9)  # the first point leaves the header's box
    (tmp_path / "a.las").write_bytes(raw)
    assert read_points(spark, str(tmp_path)).count() == 49
    (tmp_path / "b.laz").write_bytes(bytes(raw[:104]) + bytes([raw[104] | 0x80]) + bytes(raw[105:]))
    (tmp_path / "c.las").write_bytes(b"nothing")
    found = las_catalogue(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5:], r["compressed"]) for r in found) == [("a.las", False), ("b.laz", True)]
    with pytest.raises(Exception, match="compressed|no LAS"):
        read_points(spark, f"{tmp_path}/b.laz").count()


def test_discovery(tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.las", "b.LAS", "in/c.las", "d.txt"):
        (tmp_path / name).write_bytes(b"")
    assert len(find_files(str(tmp_path), (".las",))) == 3
    assert len(find_files(f"{tmp_path}/*.las")) == 2
    assert find_files([f"{tmp_path}/a.las", f"{tmp_path}/none.las"]) == [f"{tmp_path}/a.las"]


def test_rasters(spark, tmp_path):
    g = Grid(Extent(10, 22, 5, 11), 3, 6)
    v = np.arange(18.0).reshape(3, 6)
    v[1, 2] = np.nan
    (tmp_path / "r.tif").write_bytes(tiff_bytes(v, g, 32610))
    rows = "\n".join(" ".join("-9999" if np.isnan(x) else str(x) for x in line) for line in v)
    (tmp_path / "r.asc").write_text(f"ncols 6\nnrows 3\nxllcorner 10\nyllcorner 5\ncellsize 2\nNODATA_value -9999\n{rows}\n")
    for name in ("r.tif", "r.asc"):
        df, grid = read_raster(spark, f"{tmp_path}/{name}", rows_per_task=2)
        assert grid == g == raster_grid(f"{tmp_path}/{name}")
        assert cells(df) == {(r, c): v[r, c] for r in range(3) for c in range(6) if not np.isnan(v[r, c])}
        part, small = read_raster(spark, f"{tmp_path}/{name}", window=Extent(14, 18, 5, 9))
        assert (small.nrow, small.ncol) == (2, 2) and cells(part) == {(0, 1): 9.0, (1, 0): 14.0, (1, 1): 15.0}


def test_tile_sink(spark, tmp_path):
    v = [[float(r * 5 + c) for c in range(5)] for r in range(4)]
    g = Grid(Extent(0, 5, 0, 4), 4, 5)
    written = {r["name"]: r["path"] for r in write_tiles(tidy(spark, v), g, str(tmp_path / "out"), tile=3).collect()}
    assert sorted(written) == ["Col1_Row1", "Col1_Row2", "Col2_Row1", "Col2_Row2"]
    df, small = read_raster(spark, written["Col2_Row2"])
    assert small.extent == Extent(3, 5, 0, 1) and cells(df) == {(0, 0): 18.0, (0, 1): 19.0}
    tiles = spark.createDataFrame([("Col1_Row1", 0, 0, 0)], "name string, tile_id long, row int, col int")
    assert layout_polygons(tiles, Grid(Extent(0, 6, 0, 6), 2, 2)).first()["wkt"].startswith("POLYGON ((0.0 3.0, 0.0 6.0")


def test_options(tmp_path):
    (tmp_path / "a.ini").write_text("canopy=3\nminht=-1\nskip-topo\n")
    c = parse_args(["--canopy", "4", "--ini-file", f"{tmp_path}/a.ini", "--class", "1,2", "--adv-point", "--strata", "4,2,2"])
    assert (c.canopy, c.min_ht, c.do_topo, c.classes, c.advanced, c.strata) == (4.0, -1.0, False, "1,2", True, (2.0, 4.0))
    feet = parse_args(["--user-units", "feet"])
    assert round(feet.canopy, 3) == 6.562 and feet.file_name("x") == "x.tif"
    assert RunConfig(do_csm=False).with_taos is False and RunConfig(canopy=5).tao_height == 5
    again = tmp_path / "b.ini"
    again.write_text(c.to_ini())
    assert parse_args(["--ini-file", str(again)]) == c
    with pytest.raises(ValueError):
        RunConfig(smooth=4)


def test_options_from_outside(tmp_path, monkeypatch):
    from gridcanopy.plans import config

    monkeypatch.setattr(config, "OPTIONS", {})
    config.register_option("crown-shape", "round")
    config.register_option("limit", 3, int)
    (tmp_path / "a.ini").write_text("limit=5\ncrown-shape=flat\ncanopy=3\n")
    assert parse_args([]).option("limit") == 3 and parse_args(["--limit", "7"]).option("limit") == 7
    c = parse_args(["--limit", "7", "--ini-file", f"{tmp_path}/a.ini"])
    assert (c.option("limit"), c.option("crown-shape"), c.canopy) == (7, "flat", 3.0)
    (tmp_path / "b.ini").write_text(c.to_ini())
    assert parse_args(["--ini-file", f"{tmp_path}/b.ini"]) == c
    for taken in ("canopy", "minht", "adv-point"):
        with pytest.raises(ValueError):
            config.register_option(taken, 1)


def test_whole_run(spark, tmp_path):
    (tmp_path / "las").mkdir()
    for k in range(2):
        write_las(f"{tmp_path}/las/{k}.las", cloud(2000, seed=k), wkt=WKT)
    g = Grid(Extent(-10, 30, -10, 30), 8, 8)
    (tmp_path / "dem.tif").write_bytes(tiff_bytes(np.fromfunction(lambda r, c: 0.1 * r + 0.2 * c, (8, 8)), g))
    config = RunConfig(las=(str(tmp_path / "las"),), dem=(str(tmp_path / "dem.tif"),), output=str(tmp_path / "out"), cellsize=5.0, topo_scale=(5.0,), do_fine_int=True, advanced=True, min_tao_dist=2.0, las_units="metre", classes="~7")
    paths = lifecycle.execute(lifecycle.open_run(spark, config))
    assert {"point_metrics", "strata", "csm", "csm_metrics", "taos", "segments", "fine_intensity", "elevation", "topo_metrics", "topo_position_5", "coverage"} <= set(paths)
    for p in paths.values():
        assert spark.read.parquet(p).count() > 0
    report = json.loads("\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/report.json").collect()))
    assert report["grid"]["nrow"] == 4


def test_registered_product(spark):
    lifecycle.register("extra")(lambda run: {"extra": run})
    try:
        assert "extra" in lifecycle.PRODUCTS
    finally:
        del lifecycle.PRODUCTS["extra"]


def test_incremental_equals_batch(spark, tmp_path):
    g = Grid(Extent(0, 4, 0, 4), 4, 4)
    rng = np.random.default_rng(3)
    boxes = [(0, 0.0, 2.0, 0.0, 4.0), (1, 2.0, 4.0, 0.0, 4.0), (2, 1.0, 3.0, 0.0, 4.0)]
    schema = "file_id int, x double, y double, z double, return_number int"
    rows = [(f, float(rng.uniform(a, b)), float(rng.uniform(0, 4)), float(rng.uniform(0, 9)), 1) for f, a, b, _, _ in boxes for _ in range(60)]
    files = spark.createDataFrame([(*b, 60) for b in boxes], "file_id int, xmin double, xmax double, ymin double, ymax double, n int")
    source = str(tmp_path / "in")
    for f in (0, 1):
        spark.createDataFrame([r for r in rows if r[0] == f], schema).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.ingest(stream, g, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()

    drain()
    first = ingest.complete_cells(spark, str(tmp_path / "state"), files, g)
    assert {(r["col"]) for r in first.collect()} <= {0, 3}
    spark.createDataFrame([r for r in rows if r[0] == 2], schema).coalesce(1).write.mode("append").parquet(source)
    drain()
    got = cells(ingest.complete_cells(spark, str(tmp_path / "state"), files, g), "n", "mean")
    batch = metrics.point_metrics(spark.createDataFrame(rows, schema), g, 2.0, ("ALL",))
    want = cells(batch, "TotalReturnCount", "Mean_CanopyHeight")
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and (want[k][1] is None or abs(got[k][1] - want[k][1]) < 1e-9) for k in want)


@pytest.mark.parametrize("compress", [False, True])
def test_geotiff_in_strips(tmp_path, compress, monkeypatch):
    from gridcanopy.sources import rasters

    monkeypatch.setattr(rasters, "STRIP_BYTES", 64)
    g = Grid(Extent(10, 15, 0, 7), 7, 5)
    v = np.arange(35, dtype=float).reshape(7, 5)
    v[2, 3] = np.nan
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(rasters.tiff_bytes(v, g, 32610, compress))
    assert rasters.raster_grid(path) == g and rasters.raster_epsg(path) == 32610
    np.testing.assert_array_equal(rasters.read_rows(path, 0, 6)[1], v)
    np.testing.assert_array_equal(rasters.read_rows(path, 2, 4)[1], v[2:5])


def test_tiled_deflated_geotiff_with_differences(tmp_path):
    """Tiles of 4 x 4 unsigned shorts, differenced along rows, in a big TIFF file."""
    import zlib

    from gridcanopy.sources import rasters

    v = (np.arange(30).reshape(5, 6) * 7 % 50).astype("<u2")
    tiles = []
    for r in (0, 4):
        for c in (0, 4):
            t = np.zeros((4, 4), "<u2")
            part = v[r : r + 4, c : c + 4]
            t[: part.shape[0], : part.shape[1]] = part
            t[:, 1:] -= t[:, :-1].copy()
            tiles.append(zlib.compress(t.tobytes()))
    numbers = {256: (3, [6]), 257: (3, [5]), 258: (3, [16]), 259: (3, [8]), 277: (3, [1]), 317: (3, [2]), 322: (3, [4]), 323: (3, [4]), 339: (3, [1])}
    n = len(numbers) + 4
    at = 16 + 8 + 20 * n + 8
    blobs = {33550: (12, struct.pack("<3d", 2, 2, 0), 3), 33922: (12, struct.pack("<6d", 0, 0, 0, 100, 50, 0), 6)}
    body = at + 24 + 48 + 2 * 32
    starts = np.cumsum([body, *map(len, tiles[:-1])]).tolist()
    blobs |= {324: (16, struct.pack("<4Q", *starts), 4), 325: (16, struct.pack("<4Q", *map(len, tiles)), 4)}
    out, tail = b"II" + struct.pack("<HHHQQ", 43, 8, 0, 16, n), b""
    for tag in sorted([*numbers, *blobs]):
        if tag in numbers:
            out += struct.pack("<HHQHxxxxxx", tag, 3, 1, numbers[tag][1][0])
        else:
            kind, blob, count = blobs[tag]
            out += struct.pack("<HHQQ", tag, kind, count, at + len(tail))
            tail += blob
    path = tmp_path / "b.tif"
    path.write_bytes(out + b"\0" * 8 + tail + b"".join(tiles))
    assert rasters.raster_grid(str(path)).extent == Extent(100, 112, 40, 50)
    np.testing.assert_array_equal(rasters.read_rows(str(path), 1, 4)[1], v[1:])


def test_rasters_and_added_steps_of_a_run(spark, tmp_path, monkeypatch):
    """Products as GeoTIFF tiles; a filter, a metric and a ground of the caller's own."""
    from pyspark.sql import functions as F

    from gridcanopy.sources.rasters import raster_epsg, read_tiles

    for table in ("FILTERS", "METRICS"):
        monkeypatch.setattr(lifecycle, table, {})
    monkeypatch.setitem(lifecycle.ALGORITHMS, "ground", dict(lifecycle.ALGORITHMS["ground"]))
    lifecycle.register_filter("bright", lambda c: F.col("intensity") >= 100)
    lifecycle.register_metric("Brightest", lambda c: F.max("intensity"))
    lifecycle.register_algorithm("ground", "one", lambda points, run: points.withColumn("z", F.col("z") - 1.0))
    (tmp_path / "las").mkdir()
    c = cloud(3000)
    write_las(f"{tmp_path}/las/a.las", c, wkt=WKT)
    config = RunConfig(las=(str(tmp_path / "las"),), output=str(tmp_path / "out"), cellsize=5.0, do_tao=False, do_topo=False, do_strata=False, first_returns=False, dem_algo="one", rasters=True, las_units="metre", classes="", use_withheld=True, smooth=1, csm_fill=False)
    run = lifecycle.open_run(spark, config)
    paths = lifecycle.execute(run)
    metrics_ = spark.read.parquet(paths["point_metrics"])
    ok = c["intensity"] >= 100
    assert metrics_.agg(F.sum("TotalReturnCount")).first()[0] == ok.sum() and metrics_.agg(F.max("Brightest")).first()[0] == c["intensity"].max()
    assert np.isclose(spark.read.parquet(paths["csm"]).agg(F.max("value")).first()[0], c["z"][ok].max() - 1)
    folder = tmp_path / "out" / "rasters" / "point_metrics" / "ALL" / "Mean_CanopyHeight"
    tiles = [str(p) for p in folder.glob("*.tif")]
    assert tiles and raster_epsg(tiles[0]) == 32610
    got = cells(read_tiles(spark.createDataFrame([(t,) for t in tiles], "path string"), run.grid))
    want = {k: v for k, v in cells(metrics_, "Mean_CanopyHeight").items() if v is not None}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    assert (tmp_path / "out" / "rasters" / "csm" / "value").exists()


def test_resampling_reads_its_own_window(spark):
    """A small ground on a large target makes only the cells within its box."""
    from gridcanopy.operators import terrain

    small, large = Grid(Extent(100, 110, 100, 110), 10, 10), Grid(Extent(0, 1000, 0, 1000), 1000, 1000)
    dem = tidy(spark, [[float(r + c) for c in range(10)] for r in range(10)])
    assert large.dense(spark, small.extent).count() == 100
    got = cells(terrain.resample(dem, small, large))
    assert got == {(890 + r, 100 + c): float(r + c) for r in range(10) for c in range(10)}
    assert terrain.resample(dem, small, Grid(Extent(200, 210, 200, 210), 10, 10)).count() == 0
