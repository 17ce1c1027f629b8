"""Small closed-form cases for rasters, metrics, surfaces, terrain and trees."""

import math
import random

import numpy as np
import pytest
from raster_rows import cells, tidy
from pyspark.sql import functions as F

from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.operators import csm, metrics, raster, terrain, trees
from gridcanopy.operators.points import PointFilter, already_normalized, bilinear, nearest, normalize, parse_classes


def grid(n, m=None, res=1.0, x=0.0, y=0.0):
    m = m or n
    return Grid(Extent(x, x + m * res, y, y + n * res), n, m)


def test_arithmetic(spark):
    a, b = tidy(spark, [[1, 2], [None, 4]]), tidy(spark, [[0, 1], [2, None]])
    at = lambda df: cells(df)
    assert at(raster.combine(a, b, "add")) == {(0, 0): 1, (0, 1): 3}
    assert at(raster.combine(a, b, "div")) == {(0, 0): None, (0, 1): 2}
    assert at(raster.combine_scalar(a, 1, "sub", scalar_first=True)) == {(0, 0): 0, (0, 1): -1, (1, 1): -3}
    assert at(raster.combine_scalar(b, 6, "div", scalar_first=True)) == {(0, 0): None, (0, 1): 6, (1, 0): 3}
    with pytest.raises(ValueError):
        raster.combine(a, b, "add", grid(2), grid(2, x=0.5))


def test_extract(spark):
    r, g = tidy(spark, [[0, 1], [2, 3]]), grid(2)
    p = spark.createDataFrame([(0.5, 0.5), (1.0, 1.0), (5.0, 5.0), (0.1, 0.1)], "x double, y double")
    assert [x["ground"] for x in bilinear(p, r, g).orderBy("x").collect()] == [2.0, 2.0, 1.5, None]
    assert [x["ground"] for x in nearest(p, r, g).orderBy("x").collect()] == [2.0, 2.0, 3.0, None]


def test_bilinear_against_brute_force(spark):
    rng = random.Random(5)
    v = [[None if rng.random() < 0.3 else rng.uniform(0, 9) for _ in range(6)] for _ in range(5)]
    g = Grid(Extent(10, 22, 4, 9), 5, 6)
    pts = [(rng.uniform(10, 22), rng.uniform(4, 9)) for _ in range(200)]

    def value(r, c):
        return v[r][c] if 0 <= r < 5 and 0 <= c < 6 else None

    def mix(a, b, t):
        return b if a is None else a if b is None else (1 - t) * a + t * b

    def want(x, y):
        fx, fy = (x - 10 - 1) / 2, (9 - y - 0.5) / 1
        c, r = math.floor(fx), math.floor(fy)
        return mix(mix(value(r, c), value(r, c + 1), fx - c), mix(value(r + 1, c), value(r + 1, c + 1), fx - c), fy - r)

    got = {(r["x"], r["y"]): r["ground"] for r in bilinear(spark.createDataFrame(pts, "x double, y double"), tidy(spark, v), g).collect()}
    for p in pts:
        w = want(*p)
        assert (got[p] is None) == (w is None) and (w is None or math.isclose(got[p], w, abs_tol=1e-9))


def test_overlays(spark):
    x, gx = tidy(spark, [[None, 1, None], [3, None, 5], [None, 7, None]]), grid(3)
    y, gy = tidy(spark, [[None, None, None], [3, 4, 5], [6, 7, 8]]), Grid(Extent(1, 4, -1, 2), 3, 3)
    got = cells(raster.overlay([(x, gx), (y, gy)], gx, "sum"))
    assert got == {(0, 1): 1, (1, 0): 3, (1, 2): 5, (2, 1): 10, (2, 2): 4}
    inner = tidy(spark, [[None, 1, None], [3, 4, 5], [None, 7, None]])
    other = tidy(spark, [[None, 1, None], [3, 4, None], [6, 7, 8]])
    got = cells(raster.overlay([(inner, gx), (other, Grid(Extent(0, 3, -1, 2), 3, 3))], gx, "inside"))
    assert got == {(0, 1): 1, (1, 0): 3, (1, 1): 4, (1, 2): 5, (2, 0): 3, (2, 1): 4}


def test_zonal(spark):
    v = [[None, None, 2, 3], [None, None, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]]
    out = raster.zonal(tidy(spark, v), grid(4), grid(2, res=2.0), {n: raster.ZONAL[n]() for n in ("max", "mean", "sd")})
    got = cells(out, "max", "mean", "sd")
    assert set(got) == {(0, 1), (1, 0), (1, 1)} and got[(0, 1)][:2] == (7, 4.5) and math.isclose(got[(0, 1)][2], 2.0616, abs_tol=1e-3)


def test_focal_needs_odd(spark):
    with pytest.raises(ValueError):
        raster.focal(tidy(spark, [[1]]), grid(1), 2, F.avg("value"))


def points(spark, rows):
    return spark.createDataFrame(rows, "x double, y double, z double, return_number int")


def test_metrics_sparse_and_dense(spark):
    z = [float(v) for v in range(-10, 21)]
    out = metrics.point_metrics(points(spark, [(0.5, 0.5, v, 1) for v in z]), grid(1), 2.0, ("ALL",), advanced=True).first()
    assert out["TotalReturnCount"] == 31 and math.isclose(out["Mean_CanopyHeight"], 11) and math.isclose(out["StdDev_CanopyHeight"], 5.477, abs_tol=1e-3)
    assert math.isclose(out["CanopyCover"], 61.29, abs_tol=0.01)
    assert [out[f"{p}thPercentile_CanopyHeight"] for p in (25, 50, 75)] == [6.5, 11, 15.5] and math.isclose(out["95thPercentile_CanopyHeight"], 19.1)
    z = [2 + 0.01 * i for i in range(1000)]
    out = metrics.point_metrics(points(spark, [(0.5, 0.5, v, 1) for v in z]), grid(1), 2.0, ("ALL",), binned=True).first()
    assert math.isclose(out["Mean_CanopyHeight"], 6.995) and math.isclose(out["StdDev_CanopyHeight"], 2.887, abs_tol=1e-3)
    bins = metrics.histogram(points(spark, [(0.5, 0.5, v + 0.001, 1) for v in z]), grid(1))
    assert math.isclose(metrics.binned_percentiles(bins).first()["p50"], 6.995, abs_tol=0.011)


def test_end_to_end_closed_form(spark):
    """51 heights 0 to 50 in a cell; the first 21 are first returns; decoys are filtered."""
    good = [(5.0 + (h % 7) - 3, 5.0, float(h), 1 if h <= 20 else 2, 1, False, 5.0) for h in range(51)]
    decoys = [(5.0, 5.0, -10.0, 1, 1, False, 0.0), (5.0, 5.0, 110.0, 1, 1, False, 0.0), (5.0, 5.0, 9.0, 1, 7, False, 0.0), (5.0, 5.0, 9.0, 1, 1, True, 0.0), (5.0, 5.0, 9.0, 1, 1, False, 40.0)]
    df = spark.createDataFrame(good + decoys, "x double, y double, z double, return_number int, classification int, withheld boolean, scan_angle double")
    h = already_normalized(PointFilter("~7,9,18", False, 30.0).apply(df))
    g = grid(1, res=10.0)
    got = {r["return_type"]: r for r in metrics.point_metrics(h, g, 1.5, advanced=True).collect()}
    a, f = got["ALL"], got["FIRST"]
    assert (a["TotalReturnCount"], f["TotalReturnCount"]) == (51, 21)
    want = [(a, "Mean_CanopyHeight", 26), (a, "StdDev_CanopyHeight", 14.14), (a, "05thPercentile_CanopyHeight", 4.4), (a, "99thPercentile_CanopyHeight", 49.52), (a, "CanopyCover", 96.078),
            (a, "CanopyKurtosis", 1.799), (a, "CanopyReliefRatio", 0.505), (a, "CanopySkewness", 0), (f, "Mean_CanopyHeight", 11), (f, "95thPercentile_CanopyHeight", 19.1), (f, "CanopyKurtosis", 1.793)]
    for row, name, value in want:
        assert math.isclose(row[name], value, abs_tol=0.01), name
    s = {(r["return_type"], r["stratum_idx"]): (r["cover"], r["pct"]) for r in metrics.strata(h, g, (0.5, 5.5, 10.5)).collect()}
    assert [round(s[("ALL", k)][0], 2) for k in range(4)] == [100, 83.33, 45.45, 78.43]
    assert [round(s[("FIRST", k)][1], 2) for k in range(4)] == [4.76, 23.81, 23.81, 47.62]
    above = {r["return_type"]: r["CoverAboveMean"] for r in metrics.cover_above_mean(h, g, 1.5).collect()}
    assert round(above["ALL"], 2) in (47.06, 49.02) and round(above["FIRST"], 2) in (42.86, 47.62)


def test_few_returns_give_nulls(spark):
    out = metrics.point_metrics(points(spark, [(0.5, 0.5, 5.0, 1), (0.5, 0.5, 5.0, 1)]), grid(1), 2.0, ("ALL",), advanced=True).first()
    assert out["50thPercentile_CanopyHeight"] is None and out["CanopySkewness"] is None and out["StdDev_CanopyHeight"] == 0
    out = metrics.point_metrics(points(spark, [(0.5, 0.5, 1.0, 1)]), grid(1), 2.0, ("ALL",), advanced=True).first()
    assert out["Mean_CanopyHeight"] is None and out["CanopyCover"] == 0


def test_coverage(spark):
    files = spark.createDataFrame([(0.0, 2.0, 0.0, 2.0), (1.0, 3.0, 1.0, 2.0)], "xmin double, xmax double, ymin double, ymax double")
    got = cells(metrics.coverage(files, grid(3)), "n")
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 1, (2, 0): 1, (2, 1): 1}


def test_csm_footprint(spark):
    p = points(spark, [(0.5, 4.5, 5.0, 1), (2.5, 3.5, 3.0, 1), (4.5, 3.5, -1.0, 1), (1.5, 4.5, 4.0, 1)])
    got = cells(csm.max_points(p, grid(5), 2.99))
    assert math.isclose(got[(0, 0)], 5, abs_tol=0.01) and math.isclose(got[(0, 2)], 4, abs_tol=0.01) and math.isclose(got[(2, 3)], 3, abs_tol=0.01) and math.isclose(got[(2, 4)], -1, abs_tol=0.01)


def test_smooth_and_fill(spark):
    v = [[None if r * 5 + c in (6, 13, 17, 18, 19) else r * 5 + c for c in range(5)] for r in range(5)]
    df, g = tidy(spark, v), grid(5)
    filled = cells(csm.fill(df, g, 6, 1.5))
    assert set(filled) == {(1, 1), (3, 2), (3, 4)}
    smooth = cells(csm.smooth(df, g, 3))
    near = [v[r][c] for r in (0, 1) for c in (0, 1) if v[r][c] is not None]
    assert math.isclose(smooth[(0, 0)], sum(near) / len(near)) and (1, 1) not in smooth
    both = cells(csm.smooth_and_fill(df, g, 3, 6, 1.5))
    assert both == smooth | filled


def test_rumple_of_flat_ground(spark):
    flat, g = tidy(spark, [[7] * 4] * 4), grid(4)
    assert math.isclose(csm.rumple(flat, g, grid(1, res=4.0)).first()["RumpleCSM"], 1.0)
    assert math.isclose(csm.rumple(flat, g, grid(1, res=4.0), compat=True).first()["RumpleCSM"], math.sqrt(2))


def test_intensity(spark):
    p = spark.createDataFrame([(0.5, 0.5, 3.0, 5), (0.5, 0.5, 3.0, 8), (1.5, 1.5, 3.0, 3), (1.5, 1.5, 1.0, 1)], "x double, y double, z double, intensity int")
    assert cells(csm.mean_intensity(p, grid(2))) == {(1, 0): 6, (0, 1): 3}


def test_ground_priority(spark):
    d1, g1 = tidy(spark, [[1] * 5] * 5), grid(5)
    d2, g2 = tidy(spark, [[10] * 2] * 2), grid(2, res=5.0)
    target = grid(15)
    ground = terrain.mosaic([(d1, g1), (d2, g2)], target)
    p = points(spark, [(0.5, 0.5, 11.0, 1), (7.5, 7.5, 11.0, 1), (0.5, 0.5, 102.0, 1), (0.5, 0.5, 500.0, 1), (12.0, 12.0, 20.0, 1)])
    assert sorted(r["z"] for r in normalize(p, ground, target, 0.0, 100.0).collect()) == [1.0, 10.0]


def test_topography(spark):
    n = 7
    plane = tidy(spark, [[3.0 * r + 0 * c for c in range(n)] for r in range(n)])
    row = terrain.topo_metrics(plane, grid(n)).where("row = 3 and col = 3").first()
    assert math.isclose(row["Slope"], math.degrees(math.atan(3))) and row["Aspect"] == 0 and math.isclose(row["Curvature"], 0, abs_tol=1e-9)
    for values, aspect in (([[-3.0 * r for _ in range(n)] for r in range(n)], 180), ([[-2.0 * c for c in range(n)] for _ in range(n)], 90), ([[2.0 * c for c in range(n)] for _ in range(n)], 270)):
        assert math.isclose(terrain.topo_metrics(tidy(spark, values), grid(n)).first()["Aspect"], aspect)
    flat = terrain.topo_metrics(tidy(spark, [[4.0] * 3] * 3), grid(3)).first()
    assert flat["Aspect"] is None and flat["ProfileCurvature"] is None and flat["TerrainRuggedness"] == 0
    bowl = terrain.topo_metrics(tidy(spark, [[(r - 1) ** 2 + (c - 1) ** 2 for c in range(3)] for r in range(3)]), grid(3)).first()
    assert math.isclose(bowl["Curvature"], -400)


def test_curvature_of_cells_that_are_not_square(spark):
    """z = y^2 bends by 2 along y alone, whatever the cells' sides: curvature -200, none across the slope."""
    oblong = Grid(Extent(0, 3, 0, 6), 3, 3)
    at = lambda r: 5.0 - 2 * r
    rows = tidy(spark, [[at(r) ** 2] * 3 for r in range(3)])
    got = terrain.topo_metrics(rows, oblong).first()
    assert math.isclose(got["Curvature"], -200) and math.isclose(got["ProfileCurvature"], -200) and math.isclose(got["PlanCurvature"], 0, abs_tol=1e-9)
    saddle = tidy(spark, [[(c + 0.5) * at(r) for c in range(3)] for r in range(3)])
    got = terrain.topo_metrics(saddle, oblong).first()  # x y: D = E = 0, F = 1, G = y = 3, H = x = 1.5
    assert math.isclose(got["ProfileCurvature"], -200 * 4.5 / 11.25) and math.isclose(got["PlanCurvature"], -200 * 4.5 / 11.25)


def test_position_index(spark):
    n = 25
    cone = [[math.hypot(r - 12, c - 12) for c in range(n)] for r in range(n)]
    rng = random.Random(2)
    v = [[None if rng.random() < 0.2 and (r, c) != (12, 12) else cone[r][c] for c in range(n)] for r in range(n)]
    g = grid(n)
    for radius in (3, 5, 10):
        got = cells(terrain.position_index(tidy(spark, v), g, radius))
        assert math.isclose(got[(12, 12)], -radius, abs_tol=1)
        for (r, c), x in got.items():
            ring = [v[r + dr][c + dc] for dr, dc in terrain.ring_offsets(g, radius) if 0 <= r + dr < n and 0 <= c + dc < n and v[r + dr][c + dc] is not None]
            assert math.isclose(x, v[r][c] - sum(ring) / len(ring), abs_tol=1e-9)


def test_tops(spark):
    v = [[None, 1, 5], [None, 1, 1], [10, 1, 10]]
    assert set(cells(trees.candidates(tidy(spark, v), grid(3), 6.0))) == {(2, 0), (2, 2)}
    assert len(cells(trees.candidates(tidy(spark, [[10] * 3] * 3), grid(3), 6.0))) == 1


def test_thinning_is_greedy(spark):
    rng = random.Random(9)
    tops = [(r, c, float(rng.randrange(30))) for r in range(12) for c in range(12) if rng.random() < 0.6]
    want = []
    for r, c, v in sorted(tops, key=lambda t: (-t[2], t[0], t[1])):
        if all((r - a) ** 2 + (c - b) ** 2 >= 2.5**2 for a, b, _ in want):
            want.append((r, c, v))
    got = trees.thin(spark.createDataFrame(tops, "row int, col int, value double"), grid(12), 2.5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_thinning_of_a_long_ridge(spark):
    tops = spark.createDataFrame([(0, c, float(c)) for c in range(12)], "row int, col int, value double")
    got = trees.thin(tops, grid(1, 12), 1.5).collect()
    assert sorted(r["col"] for r in got) == list(range(1, 12, 2))


def test_watershed_case():
    h = np.array([[7, 6, 5], [3, 4, 3], [9, 1, 2]], float)
    got = trees.watershed(h, [(2, 0), (0, 0)], 1.1, 10, 0.1)
    assert {(r, c) for r, c in zip(*np.nonzero(got == 2))} == {(0, 0), (0, 1), (0, 2), (1, 2)}
    assert {(r, c) for r, c in zip(*np.nonzero(got == 1))} == {(1, 0), (1, 1), (2, 0), (2, 2)} and got[2, 1] == 0


def test_tiles_do_not_matter(spark):
    rng = np.random.default_rng(4)
    n = 40
    peaks = rng.uniform(0, n, (25, 2))
    rr, cc = np.mgrid[:n, :n]
    h = np.max([20 - 3.0 * np.hypot(rr - a, cc - b) + rng.uniform(0, 2) for a, b in peaks], axis=0)
    df, g = tidy(spark, h.tolist()), grid(n)
    tops = trees.identify(df, g, 2.0, 2.0)
    one = trees.segments(df, tops, g, tile=64)
    many = trees.segments(df, tops, g, tile=10)
    assert cells(one, "tao_row", "tao_col") == cells(many, "tao_row", "tao_col")
    table = trees.tree_table(tops, one, g, tile=10)
    ids = [r["id"] for r in table.collect()]
    assert len(set(ids)) == len(ids) == tops.count()
    both = trees.segment_rasters(one, table)
    assert {r["tao_id"] for r in both.collect()} - {0} <= set(ids)
    sizes = {r["id"]: r["area"] for r in table.collect()}
    counts = {r["tao_id"]: r["count"] for r in both.groupBy("tao_id").count().collect()}
    assert all(sizes[k] == n for k, n in counts.items() if k)


def test_class_grammar():
    assert parse_classes("~7,9") == (frozenset({7, 9}), False) and parse_classes("1, 2") == (frozenset({1, 2}), True) and parse_classes("") == (frozenset(), False)
