"""Runs in other units, over files of several systems, and on a given alignment."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcanopy.functions.crs import Crs
from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.operators.ground import overlapping
from gridcanopy.plans import lifecycle
from gridcanopy.plans.config import RunConfig, parse_args
from gridcanopy.plans.lifecycle import execute, open_run
from gridcanopy.sources.las import las_catalogue, write_las
from gridcanopy.sources.rasters import crs_of, raster_crs, tiff_bytes

FOOT = 0.3048
WKT = Crs.parse("26910+5703").to_wkt()


def _points(n=900, seed=0, x0=500000.0, y0=5000000.0, size=60.0, k=1.0):
    rng = np.random.default_rng(seed)
    x, y = (np.floor(rng.uniform(v, v + size, n) * 10) / 10 + 0.05 for v in (x0, y0))  # on no cell's border
    z = np.round((100 + 0.1 * (x - x0) + rng.uniform(0, 30, n)) * k, 2)
    one = np.ones(n, int)
    return {"x": x, "y": y, "z": z, "intensity": one, "return_number": one, "number_of_returns": one, "classification": one}


def _dem(path, x0=499901.0, y0=4999901.0, cells=40, size=8.0):
    g = Grid(Extent(x0, x0 + cells * size, y0, y0 + cells * size), cells, cells)
    path.write_bytes(tiff_bytes(np.fromfunction(lambda r, c: 100 + 0.1 * (c * size + size / 2 - 100) + 0.01 * r * r, (cells, cells)), g, 26910))
    return g


def test_a_run_in_feet_equals_one_in_metres(spark, tmp_path):
    write_las(f"{tmp_path}/a.las", _points(), wkt=WKT)
    _dem(tmp_path / "dem.tif")
    metres = RunConfig(las=(f"{tmp_path}/a.las",), dem=(f"{tmp_path}/dem.tif",), output=f"{tmp_path}/m", cellsize=12.0, csm_cellsize=2.0, footprint=0.42, min_tao_dist=4.1, topo_scale=(24.0,), classes="", use_withheld=True)
    feet = replace(metres.in_units("foot"), output=f"{tmp_path}/f")
    a, b = (open_run(spark, c) for c in (metres, feet))
    assert np.allclose([a.grid.extent.xmin, a.grid.xres], [b.grid.extent.xmin, b.grid.xres]) and (a.grid.nrow, a.grid.ncol) == (b.grid.nrow, b.grid.ncol)
    assert np.isclose(b.config.cellsize, 12) and np.isclose(b.config.canopy, 2 / FOOT) and np.isclose(b.config.topo_scale[0], 24)
    pa, pb = execute(a), execute(b)
    assert set(pa) == set(pb)
    for name, key, plain, high in (
        ("point_metrics", ["return_type", "row", "col"], ["TotalReturnCount", "CanopyCover"], ["Mean_CanopyHeight", "95thPercentile_CanopyHeight", "StdDev_CanopyHeight"]),
        ("csm_metrics", ["row", "col"], ["RumpleCSM"], ["MaxCSM", "MeanCSM"]),
        ("topo_metrics", ["row", "col"], ["Slope", "Aspect", "Curvature", "SolarRadiationIndex"], ["TerrainRuggedness"]),
        ("taos", ["row", "col"], ["x", "y"], ["height", "radius"]),
    ):
        one, two = (spark.read.parquet(p[name]).toPandas().sort_values(key).reset_index(drop=True) for p in (pa, pb))
        assert len(one) == len(two) > 0, name
        for c in plain + high:
            k = 1 / FOOT if c in high else 1.0
            off = np.abs(one[c].astype(float) * k - two[c].astype(float))
            assert np.allclose(one[c].astype(float) * k, two[c].astype(float), rtol=1e-5, atol=1e-5, equal_nan=True), (name, c, off.max(), one.loc[off.idxmax()].to_dict(), two.loc[off.idxmax()].to_dict())
    areas = [spark.read.parquet(p["taos"]).agg(F.sum("area")).first()[0] for p in (pa, pb)]
    assert np.isclose(areas[0], areas[1] * FOOT**2)


def test_files_of_several_systems_and_units(spark, tmp_path):
    """The same points as UTM with metres, UTM with heights in feet, and state plane feet come out alike."""
    (tmp_path / "las").mkdir()
    c = _points(300)
    write_las(f"{tmp_path}/las/a.las", c, wkt=WKT)
    write_las(f"{tmp_path}/las/b.las", c | {"z": np.round(c["z"] / (1200 / 3937), 2)}, wkt=Crs.parse("26910+6360").to_wkt())
    df = spark.createDataFrame(list(zip(range(300), c["x"].tolist(), c["y"].tolist())), "k int, x double, y double")
    plane = Crs.parse("2285+6360")
    x, y = Crs(26910).transform(plane, F.col("x"), F.col("y"))
    moved = df.select("k", x.alias("x"), y.alias("y")).toPandas().sort_values("k")
    write_las(f"{tmp_path}/las/c.las", c | {"x": moved["x"].round(2).to_numpy(), "y": moved["y"].round(2).to_numpy(), "z": np.round(c["z"] / (1200 / 3937), 2)}, wkt=plane.to_wkt())
    found = {r["path"][-5]: r for r in las_catalogue(spark, f"{tmp_path}/las").collect()}
    assert [(found[k]["epsg"], found[k]["z_unit"]) for k in "abc"] == [(26910, "metre"), (26910, "us survey foot"), (2285, "us survey foot")]
    options = dict(las=(f"{tmp_path}/las",), output=f"{tmp_path}/o", cellsize=20.0, classes="", use_withheld=True, min_ht=0.0, max_ht=1000.0, do_topo=False)
    with pytest.raises(ValueError, match="several coordinate systems"):
        open_run(spark, RunConfig(**options))
    run = open_run(spark, RunConfig(out_crs="26910", **options))
    got = run.heights().toPandas()
    assert len(got) == 900 and run.files.count() == 3
    want = np.sort(np.repeat(c["z"], 3))
    assert np.allclose(np.sort(got["z"]), want, atol=0.02)
    assert got["x"].between(500000 - 0.05, 500060.05).all() and got["y"].between(5000000 - 0.05, 5000060.05).all()


def test_alignment_and_cells_that_are_not_square(spark, tmp_path):
    write_las(f"{tmp_path}/a.las", _points(200), wkt=WKT)
    g = Grid(Extent(499993.0, 500093.0, 4999991.0, 5000091.0), 10, 4)
    (tmp_path / "pattern.tif").write_bytes(tiff_bytes(np.zeros((10, 4)), g, 26910))
    options = dict(las=(f"{tmp_path}/a.las",), output=f"{tmp_path}/o", do_topo=False)
    run = open_run(spark, RunConfig(alignment=f"{tmp_path}/pattern.tif", **options))
    assert run.grid.consistent(g) and (run.grid.xres, run.grid.yres) == (25.0, 10.0)
    run = open_run(spark, RunConfig(xres=30.0, yres=15.0, **options))
    assert (run.grid.xres, run.grid.yres) == (30.0, 15.0)
    assert crs_of(f"{tmp_path}/pattern.tif").epsg == 26910 and crs_of(f"{tmp_path}/a.las").vertical == 5703


def test_many_ground_files_are_one_plan(spark, tmp_path):
    """Tiles of ground, a coarser file under them and one far away: one scan, the finest first."""
    write_las(f"{tmp_path}/a.las", _points(400), wkt=WKT)
    (tmp_path / "dem").mkdir()
    for r in range(4):
        for c in range(4):
            g = Grid(Extent(500000.0 + 16 * c, 500016.0 + 16 * c, 5000000.0 + 16 * r, 5000016.0 + 16 * r), 8, 8)
            (tmp_path / "dem" / f"{r}{c}.tif").write_bytes(tiff_bytes(np.full((8, 8), 100.0), g, 26910))
    _dem(tmp_path / "dem" / "coarse.tif")
    far = Grid(Extent(10.0, 20.0, 10.0, 20.0), 2, 2)
    (tmp_path / "dem" / "far.tif").write_bytes(tiff_bytes(np.zeros((2, 2)), far, 26910))
    (tmp_path / "dem" / "notes.tif").write_bytes(b"no raster")
    run = open_run(spark, RunConfig(las=(f"{tmp_path}/a.las",), dem=(f"{tmp_path}/dem",), output=f"{tmp_path}/o", cellsize=16.0, topo_scale=(16.0,), classes="", use_withheld=True))
    assert run.dems.files.count() == 17
    plan = run.dems.on(run.grid)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    ground, g = run.ground
    assert (g.xres, g.yres) == (2.0, 2.0) and {r["value"] for r in ground.where("row > 2 and col < 28").collect()} == {100.0}
    assert run.heights().count() == 400


def test_prj_beside_a_grid(tmp_path):
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\n1 2\n3 4\n")
    assert not raster_crs(f"{tmp_path}/g.asc").known
    (tmp_path / "g.prj").write_text(Crs.parse("2927").to_wkt())
    assert raster_crs(f"{tmp_path}/g.asc").same_place(Crs(2927)) and crs_of(f"{tmp_path}/g.prj").epsg == 2927


def test_overlapping_boxes(spark):
    rng = np.random.default_rng(4)
    boxes = lambda n: [(k, float(x), float(x + w), float(y), float(y + h)) for k, (x, y, w, h) in enumerate(zip(*rng.uniform(0, 90, (2, n)), *rng.uniform(0.1, 40, (2, n))))]
    a, b = boxes(40) + [(40, 20.0, 40.0, 20.0, 60.0), (41, 0.0, 20.0, 60.0, 80.0)], boxes(30) + [(30, 40.0, 60.0, 20.0, 60.0), (31, 20.0, 60.0, 40.0, 60.0)]  # some along the buckets' borders
    da, db = (spark.createDataFrame(v, f"{n} int, xmin double, xmax double, ymin double, ymax double") for v, n in ((a, "a"), (b, "b")))
    got = [tuple(r) for r in overlapping(da, db, Grid(Extent(0, 140, 0, 140), 7, 9), "a", "b").collect()]
    want = {(i, j) for i, ax0, ax1, ay0, ay1 in a for j, bx0, bx1, by0, by1 in b if max(ax0, bx0) < min(ax1, bx1) and max(ay0, by0) < min(ay1, by1)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_second_run_clears_what_it_does_not_make(spark, tmp_path, monkeypatch):
    """Options by category, tables and layers of an earlier run, and a layer that cannot be written."""
    write_las(f"{tmp_path}/a.las", _points(150), wkt=WKT)
    options = dict(las=(f"{tmp_path}/a.las",), output=f"{tmp_path}/o", cellsize=20.0, do_tao=False, do_topo=False, do_strata=False, user_units="foot", max_ht=1000.0)
    config = RunConfig(rasters=True, **options)
    execute(open_run(spark, config))
    assert (tmp_path / "o" / "csm.parquet").exists() and (tmp_path / "o" / "rasters" / "csm").exists()
    names = {p.name for p in (tmp_path / "o" / "parameters").glob("*.ini")}
    assert names == {"full.ini", "process_and_computer.ini", "data.ini", "process.ini", "computer.ini"}
    assert parse_args(["--ini-file", f"{tmp_path}/o/parameters/full.ini"]) == config
    only = (tmp_path / "o" / "parameters" / "data.ini").read_text()
    assert "[data]" in only and "cellsize" not in only and "output" in only
    (tmp_path / "o" / "own.txt").write_text("the user's")
    monkeypatch.setattr(lifecycle, "write_layers", lambda *a: 1 / 0)
    execute(open_run(spark, RunConfig(rasters=True, do_csm=False, **options)))
    assert not (tmp_path / "o" / "csm.parquet").exists() and not (tmp_path / "o" / "rasters").exists()
    assert (tmp_path / "o" / "own.txt").exists() and (tmp_path / "o" / "point_metrics.parquet").exists()
    report = json.loads((tmp_path / "o" / "report.json").read_text())
    assert report["failed"]["layers of point_metrics"] == "division by zero" and "csm" not in report["products"]
