"""Steps whose rows must not grow with the area or the neighbourhood: results by plain loops, and what plans shuffle."""

import numpy as np
from pyspark.sql import functions as F

from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.operators import crowns, csm, metrics, raster, terrain, trees
from gridcanopy.operators.ground import overlapping
from gridcanopy.streaming import ingest


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _boxes(spark, rng, n, size, name="id"):
    x, y = rng.random(n) * size, rng.random(n) * size
    w, h = (rng.random(n) ** 8 * size for _ in range(2))
    rows = [(k, *map(float, (x[k], x[k] + w[k], y[k], y[k] + h[k]))) for k in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, xmin double, xmax double, ymin double, ymax double")


def test_boxes_that_cover_many_buckets_meet(spark):
    """As many buckets as a ground of 100,000 cells a side has would not be listed in a test's time."""
    rng = np.random.default_rng(1)
    rows, one = _boxes(spark, rng, 60, 1000)
    others, two = _boxes(spark, rng, 60, 1000, "other")
    got = overlapping(one, two, Grid(Extent(-10, 2100, -10, 2100), 100_000, 100_000), "id", "other").collect()
    want = {(a[0], b[0]) for a in rows for b in others if max(a[1], b[1]) < min(a[2], b[2]) and max(a[3], b[3]) < min(a[4], b[4])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_coverage_by_runs(spark):
    rows, boxes = _boxes(spark, np.random.default_rng(2), 12, 60)
    g = Grid(Extent(0, 50, 0, 50), 25, 20)
    want: dict[tuple[int, int], int] = {}
    for r in boxes.transform(lambda b: g.covered(b, "out")).collect():
        want[r["row"], r["col"]] = want.get((r["row"], r["col"]), 0) + 1
    got = metrics.coverage(boxes, g)
    assert {(r["row"], r["col"]): r["n"] for r in got.collect()} == want
    assert g.tallies(boxes).count() <= 25 * 2 * len(rows) < 100 * len(want)
    assert {(r["row"], r["col"]) for r in trees.tiles_of(boxes, g).collect()} == set(want)


def test_greedy_thinning_over_borders_of_blocks(spark):
    rng = np.random.default_rng(3)
    n = 2 * raster.BLOCK - 40
    at = np.unique(rng.integers(0, n, (6000, 2)), axis=0)
    at = np.concatenate([at, [(250 + k // 9, k) for k in range(450) if not (at == (250 + k // 9, k)).all(1).any()]])  # a chain over many blocks' borders
    rows = [(int(r), int(c), float(v)) for (r, c), v in zip(at, rng.integers(1, 30, len(at)))]
    g = Grid(Extent(0, n, 0, n), n, n)
    kept: set[tuple[int, int]] = set()
    for r, c, _ in sorted(rows, key=lambda t: (-t[2], t[0], t[1])):
        if not any((r + a, c + b) in kept for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b < 10.24):
            kept.add((r, c))
    tops = spark.createDataFrame(rows, "row int, col int, value double")
    assert {(r["row"], r["col"]) for r in trees.thin(tops, g, 3.2).collect()} == kept
    known = trees._decided(tops, g, 3.2).groupBy("state").count().collect()
    assert sum(r["count"] for r in known) == len(rows) and sum(r["count"] for r in known if r["state"] == trees.OPEN) < len(rows) / 10


def test_cells_travel_once_to_a_block(spark):
    g = Grid(Extent(0, 20, 0, 20), 20, 20)
    cells = g.dense(spark).withColumn("value", (F.col("row") * 7 + F.col("col") * 3) % 11 * 1.0)
    for df in (csm.smooth(cells, g, 5), trees.candidates(cells, g, 2.0), csm.rumple(cells, g, Grid(g.extent, 2, 2))):
        assert "FlatMapGroupsInArrow" in _plan(df)
    h = np.array([[(r * 7 + c * 3) % 11 for c in range(20)] for r in range(20)], float)
    for r in csm.smooth(cells, g, 5).collect():
        near = h[max(0, r["row"] - 2) : r["row"] + 3, max(0, r["col"] - 2) : r["col"] + 3]
        assert abs(r["value"] - near.mean()) < 1e-9


def test_target_cells_are_not_shuffled(spark):
    rng = np.random.default_rng(4)
    cells = [(r, c, float(v)) for (r, c), v in zip(np.ndindex(9, 4), rng.random(36)) if v > 0.2]
    dem, g = spark.createDataFrame(cells, "row int, col int, value double"), Grid(Extent(3, 83, 2, 29), 9, 4)
    fine, own = Grid(Extent(0, 90, 0, 30), 60, 45), [(5, 5, -1.0)]
    exact = spark.createDataFrame(own, "row int, col int, value double")
    got = terrain.mosaic([(exact, fine), (dem, g)], fine)
    assert "Range (" not in _plan(got)
    value = {(r, c): v for r, c, v in cells}
    mix = lambda a, b, t: (1 - t) * a + t * b if a is not None and b is not None else a if b is None else b
    want = {}
    for row in range(60):
        for col in range(45):
            x, y = (col + 0.5) * 2, 30 - (row + 0.5) * 0.5
            if 3 <= x <= 83 and 2 <= y <= 29:
                fx, fy = (x - 3 - 10) / 20, (29 - y - 1.5) / 3
                r, c = int(np.floor(fy)), int(np.floor(fx))
                v = mix(*(mix(value.get((r + k, c)), value.get((r + k, c + 1)), fx - c) for k in (0, 1)), fy - r)
                if v is not None:
                    want[row, col] = v
    want[5, 5] = -1.0
    found = {(r["row"], r["col"]): r["value"] for r in got.collect()}
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_a_crown_task_takes_one_tile_at_a_time(spark):
    g = Grid(Extent(0, 8, 0, 8), 8, 8)
    cells = g.dense(spark).withColumn("value", F.col("row") + 3.0)
    got = crowns.segments(cells, spark.createDataFrame([(7, 7, 10.0)], "row int, col int, value double"), g, tile=4, cutoff=2.0)
    assert "MapInArrow" not in _plan(got).replace("FlatMapGroupsInArrow", "") and got.where("tao_row = 7").count() == 64


def test_the_end_of_a_file_sends_blocks_not_cells(spark, tmp_path):
    g = Grid(Extent(0, 600, 0, 600), 600, 600)
    files = spark.createDataFrame([(0, 0.0, 600.0, 0.0, 600.0)], "file int, xmin double, xmax double, ymin double, ymax double")
    spark.createDataFrame([(0, 1.5, 2.5, 7.0, False), (0, None, None, None, True)], "file int, x double, y double, z double, last boolean").write.parquet(str(tmp_path / "in"))
    stream = ingest.completed(spark.readStream.schema("file int, x double, y double, z double, last boolean").parquet(str(tmp_path / "in")), files, g)
    q = stream.writeStream.format("memory").queryName("ended").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ended").count() == 360_000 and spark.table("ended").where("n = 1 and row = 597 and col = 1 and top = 7").count() == 1
    assert q.lastProgress is None or sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == 0


def test_tiles_of_few_cells_are_small(spark):
    """A tile's rows hold its cells, not a raster of the tile with its gaps, and so do its crowns and reports."""
    g = Grid(Extent(0, 2048, 0, 2048), 2048, 2048)
    rows = [(k * 512 + 511, k * 512 + 511, 9.0) for k in range(3)] + [(k * 512 + 510, k * 512 + 511, 1.0) for k in range(3)]
    cells = spark.createDataFrame(rows, "row int, col int, value double")
    packed = crowns._packed(cells, cells.where("value > 2"), 512)
    flooded = crowns._flooded(packed.withColumn("around", F.lit(None).cast("array<binary>")), 512, 2.0, 100.0, 0.01)
    size = lambda v: len(v) if isinstance(v, (bytes, bytearray)) else sum(map(size, v)) if isinstance(v, (list, tuple)) else 0
    for made in (packed.collect(), flooded.collect()):
        assert len(made) == 3 and all(0 < size(tuple(r)) < 4096 for r in made)
    got = crowns.segments(cells, cells.where("value > 2"), g, tile=512, cutoff=2.0).collect()
    assert {(r["row"], r["col"], r["tao_row"], r["tao_col"]) for r in got} == {(r, c, *((r, c) if v > 2 else (None, None))) for r, c, v in rows}


def test_cells_come_out_by_blocks(spark, tmp_path):
    """What a stream gives are rows of blocks, some 4096 cells with points in each, however many cells the files cover."""
    g = Grid(Extent(0, 600, 0, 600), 600, 600)
    files = spark.createDataFrame([(0, 0.0, 600.0, 0.0, 500.0), (1, 0.0, 1.0, 0.0, 1.0)], "file int, xmin double, xmax double, ymin double, ymax double")
    at = np.stack([v.ravel() for v in np.meshgrid(np.arange(90), np.arange(140))], 1)
    rows = [(0, float(x) + 0.5, float(y) + 0.5, float(z), False) for x, y in at for z in {(x * y) % 5, 1}] + [(0, None, None, None, True)]
    spark.createDataFrame(rows, "file int, x double, y double, z double, last boolean").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("file int, x double, y double, z double, last boolean").parquet(str(tmp_path / "in"))
    q = ingest.completed_blocks(source, files, g).writeStream.format("memory").queryName("by_blocks").trigger(availableNow=True).start()
    q.awaitTermination()
    blocks = spark.table("by_blocks")
    assert blocks.count() <= 12 and max(len(r["cells"]) for r in blocks.collect()) < 1 << 17
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]) <= 12
    found = {(r["row"], r["col"]): r[2:] for r in ingest.cells_of(blocks).where("n > 0").collect()}
    want = {}
    for x, y in at:
        z = {int(x * y) % 5, 1}
        high = [v for v in z if v >= 2]
        want[599 - int(y), int(x)] = (len(z), 100.0 * len(high) / len(z), sum(high) / len(high) if high else None, max(high) if high else None)
    del want[599, 0]  # the second file has not ended
    assert found == want and ingest.cells_of(blocks).count() == 300_000 - 1
