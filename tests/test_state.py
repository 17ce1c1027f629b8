"""Cells and zones that come out of a stream once, when nothing can be added to them."""

import numpy as np

from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.sources.las import stream_points, write_las
from gridcanopy.streaming.ingest import completed, completed_ground

G = Grid(Extent(0, 3, 0, 3), 3, 3)


def _las(folder, name, points):
    x, y, z = (np.array(v, float) for v in (zip(*points) if points else ([], [], [])))
    one = np.ones(len(points), int)
    write_las(f"{folder}/{name}.las", {"x": x, "y": y, "z": z, "intensity": one, "return_number": one, "number_of_returns": one, "classification": one})


def _drain(spark, stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())


def test_cells_wait_for_all_their_files(spark, tmp_path):
    """Two overlapping files: the cells of the first alone come first; a file in parts completes nothing before its end."""
    (tmp_path / "in").mkdir()
    source = str(tmp_path / "in")
    files = spark.createDataFrame([(f"{source}/a.las", 0.0, 2.0, 0.0, 2.0), (f"{source}/b.las", 1.0, 3.0, 1.0, 2.0), (f"{source}/c.las", 2.0, 3.0, 2.0, 3.0)], "file string, xmin double, xmax double, ymin double, ymax double")
    _las(source, "a", [(0.5, 0.5, 3), (0.5, 1.5, 1), (0.5, 1.5, 3), (1.5, 1.5, 3)])

    def drain(**options):
        return _drain(spark, completed(stream_points(spark, source, columns=("file", "x", "y", "z", "last"), **options), files, G, 2.0), tmp_path)

    first = drain(recordsPerBatch="3")  # three of the four points
    assert first == []
    second = drain(recordsPerBatch="3")
    assert second == [(1, 0, 2, 50.0, 3.0, 3.0), (2, 0, 1, 100.0, 3.0, 3.0), (2, 1, 0, None, None, None)]
    _las(source, "b", [(1.5, 1.5, 5), (2.5, 1.5, 1)])
    _las(source, "c", [])  # without points
    both = drain()
    assert both == sorted([*second, (1, 1, 2, 100.0, 4.0, 5.0), (1, 2, 1, 0.0, None, None), (0, 2, 0, None, None, None)], key=lambda r: r[:2])


def test_ground_zones_come_out_when_full(spark, tmp_path):
    """Two overlapping files; a zone with a hole never comes out, and the first value of a fine cell stays."""
    fine, zones = Grid(Extent(0, 4, 0, 2), 2, 4), Grid(Extent(0, 4, 0, 2), 1, 2)
    schema = "row int, col int, value double, ord int"
    parts = [[(0, 0, 1.0, 0), (0, 1, 2.0, 0), (1, 0, 3.0, 0)], [(1, 0, 9.0, 1), (1, 1, 4.0, 1), (0, 2, 5.0, 1), (0, 3, 5.0, 1), (1, 2, 5.0, 1)], [(0, 0, 8.0, 2)]]
    got = []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = completed_ground(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), fine, zones)
        got.append(_drain(spark, stream, tmp_path))
    assert got == [[], [(0, 0, 2.5, 4)], [(0, 0, 2.5, 4)]]
