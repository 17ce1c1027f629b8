import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridcanopy.functions.grid import Extent, Grid, QuadExtent
from gridcanopy.functions.crs import Crs
from gridcanopy.functions.units import LinearUnit

G = Grid(Extent(0, 4, 0, 4), 4, 4)


@given(st.integers(1, 40), st.integers(1, 40), st.floats(0.1, 50), st.data())
@settings(max_examples=60, deadline=None)
def test_cell_centre_round_trip(nrow, ncol, res, data):
    g = Grid(Extent(-5.0, -5.0 + ncol * res, 3.0, 3.0 + nrow * res), nrow, ncol)
    cell = data.draw(st.integers(0, g.ncell - 1))
    assert g.cell_of(*g.centre(cell)) == cell


def test_edges_belong_to_the_last_cell():
    assert G.col_of(4.0) == 3 and G.row_of(0.0) == 3 and G.row_of(4.0) == 0
    with pytest.raises(ValueError):
        G.col_of(4.1)


def test_columns_agree_with_scalars(spark):
    pts = [(0.0, 0.0), (4.0, 4.0), (1.0, 3.0), (2.5, 0.2)]
    got = G.with_cells(spark.createDataFrame(pts, "x double, y double")).select("x", "y", G.cell().alias("cell"), "row", "col").collect()
    assert {(r["x"], r["y"]): r["cell"] for r in got} == {p: G.cell_of(*p) for p in pts}


def test_snap_and_crop():
    e = Extent(0.6, 2.4, 1.4, 3.6)
    assert G.snap(e, "near") == Extent(1, 2, 1, 4)
    assert G.snap(e, "out") == Extent(0, 3, 1, 4)
    assert G.snap(e, "in") == Extent(1, 2, 2, 3)
    assert G.snap(e, "ll") == Extent(0, 2, 1, 3)
    assert G.rows_cols(e, "out") == (0, 2, 0, 2)
    small = G.crop(e, "in")
    assert (small.nrow, small.ncol) == (1, 1) and small.extent == Extent(1, 2, 2, 3)
    assert G.extend(Extent(-0.5, 4, 0, 5.2)).ncol == 5
    assert G.cells(Extent(0, 2, 2, 4)) == [0, 1, 4, 5]


def test_consistency_and_offsets():
    other = Grid(Extent(2, 6, 1, 5), 4, 4)
    assert G.consistent(other) and G.offset_to(other) == (1, -2)
    assert not G.consistent(Grid(Extent(0.5, 4.5, 0, 4), 4, 4))
    assert Extent(0, 1, 0, 1, 32610).consistent(Extent(0, 1, 0, 1))
    with pytest.raises(ValueError):
        Extent(0, 1, 0, 1, 32610).overlaps(Extent(0, 1, 0, 1, 32611))


def test_overlap_and_touch():
    a = Extent(0, 1, 0, 1)
    assert not a.overlaps(Extent(1, 2, 0, 1)) and a.touches(Extent(1, 2, 0, 1))
    assert a.contains(1, 1) and not a.strictly_contains(1, 1)


def test_quad(spark):
    q = QuadExtent(((0, 0), (1, 3), (4, 3), (3, 0)))
    pts = [(x / 2, y / 2) for x in range(10) for y in range(8)]
    df = spark.createDataFrame(pts, "x double, y double")
    got = {(r["x"], r["y"]) for r in df.where(q.inside()).collect()}
    assert got == {p for p in pts if q.contains(*p)} and (3.5, 0.5) not in got
    assert q.overlaps(QuadExtent.of(Extent(3, 5, 1, 2))) and not q.overlaps(QuadExtent.of(Extent(3.7, 5, 0, 0.5)))


def test_covered_matches_driver(spark):
    e = Extent(0.6, 2.4, 1.4, 3.6)
    df = spark.createDataFrame([(e.xmin, e.xmax, e.ymin, e.ymax)], "xmin double, xmax double, ymin double, ymax double")
    for how in ("near", "out", "in"):
        assert sorted(r[0] for r in G.covered(df, how).select(G.cell().alias("c")).collect()) == G.cells(e, how)


def test_units():
    ft, m = LinearUnit.named("feet"), LinearUnit.named("metres")
    assert math.isclose(ft.factor_to(m), 0.3048) and LinearUnit.named("cubit").factor_to(m) == 1.0
    assert (m.suffix, ft.suffix, LinearUnit().suffix) == ("Meters", "Feet", "")


def test_crs():
    assert Crs.parse("EPSG:32610+5703").z_unit.name == "metre"
    assert Crs.parse("+proj=utm +zone=10 +datum=WGS84").epsg == 32610
    assert Crs.parse('PROJCS["x",AUTHORITY["EPSG","26911"]]').epsg == 26911
    assert Crs.parse("").consistent(Crs(32610)) and not Crs(32611).consistent(Crs(32610))


def test_utm_round_trip_and_known_point(spark):
    geo, utm = Crs(4326), Crs(32631)
    df = spark.createDataFrame([(3.0, 0.0), (2.2945, 48.8582), (5.9, -33.0)], "x double, y double")
    x, y = geo.transform(utm, F.col("x"), F.col("y"))
    there = df.select("x", "y", x.alias("e"), y.alias("n"))
    rows = there.collect()
    assert math.isclose(rows[0]["e"], 500000, abs_tol=1e-6) and abs(rows[0]["n"]) < 1e-6
    assert math.isclose(rows[1]["e"], 448252, abs_tol=2) and math.isclose(rows[1]["n"], 5411943, abs_tol=12)
    lon, lat = utm.transform(geo, F.col("e"), F.col("n"))
    for r in there.select("x", "y", lon.alias("lon"), lat.alias("lat")).collect():
        assert math.isclose(r["x"], r["lon"], abs_tol=1e-9) and math.isclose(r["y"], r["lat"], abs_tol=1e-9)
    a, b = utm.transform(utm, F.col("x"), F.col("y"))
    assert str(a) == str(F.col("x"))
