"""Filters and columns that reach the LAS reader, and files that arrive one after another."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, Not

from gridcanopy.sources.las import LasDataSource, LasStreamReader, read_points, stream_points, write_las


def _tiles(folder, n=5):
    """Files side by side, 10 wide, of 50 points each."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(n):
        x, y, z = np.round(rng.uniform(10 * k, 10 * k + 10, 50), 2), np.round(rng.uniform(0, 10, 50), 2), np.round(rng.uniform(0, 30, 50), 2)
        c, r = rng.integers(1, 6, 50), rng.integers(1, 4, 50)
        write_las(f"{folder}/{k}.las", {"x": x, "y": y, "z": z, "intensity": 10 * c, "return_number": r, "number_of_returns": r, "classification": c})
        rows += list(zip(x.tolist(), y.tolist(), z.tolist(), c.tolist(), r.tolist()))
    return rows


def _reader(folder, filters, **options):
    schema = type("S", (), {"fields": [type("F", (), {"name": n})() for n in ("file", "x", "y", "z")]})()
    reader = LasDataSource({"path": str(folder), "pushdown": "true", **options}).reader(schema)
    left = list(reader.pushFilters(filters))
    return reader, left


def test_only_overlapping_files_are_read(tmp_path):
    _tiles(tmp_path)
    reader, left = _reader(tmp_path, [GreaterThanOrEqual(("x",), 12.0), LessThan(("x",), 28.0), IsNotNull(("x",))])
    assert not left and sorted(p.header.path[-5] for p in reader.partitions()) == ["1", "2"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 100
    for filters, files in (([GreaterThan(("x",), 1e6)], 0), ([EqualTo(("file",), f"{tmp_path}/3.las")], 1), ([In(("file",), (f"{tmp_path}/3.las", f"{tmp_path}/0.las"))], 2), ([LessThan(("z",), -1.0)], 0)):
        reader, left = _reader(tmp_path, filters)
        assert not left and len([p for p in reader.partitions() if p.header]) == files
    other = Not(EqualTo(("classification",), 2))
    assert _reader(tmp_path, [other])[1] == [other]


def test_filters_and_columns_in_a_query(spark, tmp_path):
    rows = _tiles(tmp_path)
    df = read_points(spark, str(tmp_path), columns=("x", "z", "classification")).where("x >= 12 and x < 28 and classification = 2 and z is not null")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.columns == ["x", "z", "classification"] and "Filter" not in plan.replace("Filters", "")
    want = sorted((x, z) for x, _, z, c, _ in rows if 12 <= x < 28 and c == 2)
    assert sorted((round(r["x"], 2), round(r["z"], 2)) for r in df.collect()) == want and want
    mixed = read_points(spark, str(tmp_path)).where("(classification in (1, 3) or z > 29) and not (return_number = 2)")
    assert mixed.count() == sum((c in (1, 3) or z > 29) and r != 2 for _, _, z, c, r in rows)
    with pytest.raises(Exception, match="no column"):
        read_points(spark, str(tmp_path), columns=("colour",)).count()


def test_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = _tiles(tmp_path / "in", 3)

    def drain():
        q = stream_points(spark, str(tmp_path / "in"), filesPerBatch="2").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert drain().count() == 100 and drain().count() == len(rows)  # a run takes a batch, and a batch two files
    more = _tiles(tmp_path / "in", 5)  # the same three again, and two new ones
    got = drain().groupBy("file").agg(F.count("*").alias("n")).collect()
    assert len(got) == 5 and {r["n"] for r in got} == {50} and len(more) == 250


def test_offsets_name_files_and_the_place_in_one(tmp_path):
    _tiles(tmp_path, 3)
    r = LasStreamReader({"path": str(tmp_path), "filesPerBatch": "2"}, ["x"])
    start = r.initialOffset()
    first = r.latestOffset()
    second = r.latestOffset()
    assert [len(json.loads(o["files"])) for o in (start, first, second)] == [0, 2, 3]
    again = LasStreamReader({"path": str(tmp_path)}, ["x"])  # after a restart
    assert len(again.partitions(first, second)) == 1 and len(json.loads(again.latestOffset()["files"])) == 3
    r = LasStreamReader({"path": str(tmp_path), "recordsPerBatch": "70"}, ["file", "x", "last"])
    offsets = [r.initialOffset()]
    for _ in range(4):
        offsets.append(r.latestOffset())
    assert [(len(json.loads(o["files"])), int(o["at"])) for o in offsets] == [(0, 0), (1, 20), (2, 40), (3, 0), (3, 0)]
    rows = [[x for p in r.partitions(a, b) for batch in r.read(p) for x in batch.to_pylist()] for a, b in zip(offsets, offsets[1:])]
    assert [sum(not x["last"] for x in b) for b in rows] == [70, 70, 10, 0] and [sum(x["last"] for x in b) for b in rows] == [1, 1, 1, 0]
