"""Crowns over tiles against a flood of the whole raster, one cell at a time."""

import heapq

import numpy as np
import pytest

from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.operators import crowns, trees


def _grid(nrow, ncol):
    return Grid(Extent(0, ncol, 0, nrow), nrow, ncol)


def _brute(h, tops, cutoff, top, size):
    """Cells leave one queue by level, step and top; each labels the open canopy around it."""
    depth = crowns.levels(h, cutoff, top, size)
    label, queue = {}, []
    rank = {t: k for k, t in enumerate(sorted(tops, key=lambda t: (-h[t], *t)))}
    for t in tops:
        label[t] = t
        heapq.heappush(queue, (int(depth[t]), 0, rank[t], t))
    while queue:
        level, step, k, (r, c) = heapq.heappop(queue)
        for dr, dc in crowns.AROUND:
            n = (r + dr, c + dc)
            if 0 <= n[0] < h.shape[0] and 0 <= n[1] < h.shape[1] and n not in label and h[n] >= cutoff:
                label[n] = label[r, c]
                below = max(level, int(depth[n]))
                heapq.heappush(queue, (below, step + 1 if below == level else 0, k, n))
    out = {n: label[n] for n in label}
    return out | {(r, c): (None, None) for r, c in zip(*np.nonzero(h < cutoff))}


def _tiled(spark, h, tops, tile, **k):
    rows = [(int(r), int(c), float(h[r, c])) for r, c in zip(*np.nonzero(~np.isnan(h)))]
    df = spark.createDataFrame(rows, "row int, col int, value double")
    t = spark.createDataFrame([(int(r), int(c), float(h[r, c])) for r, c in tops], "row int, col int, value double")
    return {(x["row"], x["col"]): (x["tao_row"], x["tao_col"]) for x in trees.segments(df, t, _grid(*h.shape), tile, **k).collect()}


@pytest.mark.parametrize("tile", [3, 7, 16, 64])
def test_random_surfaces(spark, tile):
    rng = np.random.default_rng(tile)
    h = np.round(rng.uniform(0, 8, (24, 31)) * 2) / 2  # many ties and plateaus
    h[rng.uniform(size=h.shape) < 0.1] = np.nan
    tops = [tuple(map(int, t)) for t in np.argwhere(h >= 7)][::3]
    assert _tiled(spark, h, tops, tile, cutoff=2.0, max_height=8.0, bin_size=0.5) == _brute(h, tops, 2.0, 8.0, 0.5)


def test_crown_wider_than_tiles(spark):
    """One top on a plateau that spans many tiles, and a second that shares it."""
    h = np.full((40, 200), 10.0)
    h[20, 5] = 12.0
    one = _tiled(spark, h, [(20, 5)], 16)
    assert len(one) == 8000 and set(one.values()) == {(20, 5)}
    h[3, 190] = 11.0
    tops = [(20, 5), (3, 190)]
    assert _tiled(spark, h, tops, 32) == _brute(h, tops, 2.0, 100.0, 0.01)


def test_way_round_by_other_tiles(spark):
    """A wall makes the flood leave a tile and come back into it."""
    h = np.full((12, 12), 5.0)
    h[5, :10] = 0.0
    h[0, 0] = 9.0
    h[11, 11] = 0.5
    tops = [(0, 0)]
    got = _tiled(spark, h, tops, 6)
    assert got == _brute(h, tops, 2.0, 100.0, 0.01) and got[11, 0] == (0, 0) and got[5, 0] == (None, None)


def test_no_tops_and_no_cells(spark):
    h = np.full((5, 5), 5.0)
    h[0, 0] = 1.0
    assert _tiled(spark, h, [], 2) == {(0, 0): (None, None)}
    assert _tiled(spark, np.full((5, 5), np.nan), [], 2) == {}
