"""Incremental ingest: points arrive as files, cells keep mergeable sums, complete cells come out.

Points have no event time.  A cell is complete when every file that covers it has been read to its end, which
counting does for, as a watermark does elsewhere.  :func:`completed` keeps the sums and the count as state by cell,
which is dropped when the cell comes out; :func:`ingest` keeps sums of batches as files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.grid import CELLS_PER_TASK, MAX_TASKS, Grid
from ..operators.crowns import squeeze, unsqueeze

SUMS = ("n", "nc", "zsum", "top")
METRICS = "row int, col int, n long, cover double, mean double, top double"


# State by block of cells -----------------------------------------------------------------------------
#: Cells along the side of a block, whose cells share a state.
BLOCK = 256
#: What a state holds of each cell with points that has not come out.
HELD = np.dtype([("place", "<i4"), ("n", "<i8"), ("nc", "<i8"), ("zsum", "<f8"), ("top", "<f8")])
#: Points that a task sums at a time, and cells with points in a row of cells that come out together.
SUMMED, TOGETHER = 1 << 19, 4096
BLOCKS = "br int, bc int, cells binary"


def _sums(place: np.ndarray, n: np.ndarray, nc: np.ndarray, zsum: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places there are, in order, and sums and the maximum of each."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    out = np.zeros(len(first), HELD)
    if len(first):
        for name, v in (("n", n), ("nc", nc), ("zsum", zsum)):
            out[name] = np.add.reduceat(v[order], first)
        out["top"] = np.fmax.reduceat(top[order], first)
    return place[first], out


def _partial(rows: DataFrame) -> DataFrame:
    """``(br, bc, cells)``: sums by cell of some of a task's rows, a row a block, so that few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            row, col, *sums = (np.concatenate(c) for c in zip(*parts))
            br, bc = row.astype(np.int64) // BLOCK, col.astype(np.int64) // BLOCK
            key, held = _sums(((br << 23 | bc) << 16) | (row % BLOCK) * BLOCK + col % BLOCK, *sums)
            held["place"] = key & 0xFFFF
            key >>= 16
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            cells = [held[lo:hi].tobytes() for lo, hi in zip(cut, [*cut[1:], len(held)])]
            return pa.RecordBatch.from_arrays([pa.array((key[cut] >> 23).astype(np.int32)), pa.array((key[cut] & 0x7FFFFF).astype(np.int32)), pa.array(cells, pa.binary())], names=["br", "bc", "cells"])

        for b in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size >= SUMMED:
                yield out()
                parts, size = [], 0
        if size:
            yield out()

    return rows.select("row", "col", *SUMS).mapInArrow(run, BLOCKS)


def cells_of(blocks: DataFrame) -> DataFrame:
    """The cells of what :func:`completed_blocks` gives: ``(row, col, n, cover, mean, top)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for br, bc, raw in zip(*(b.column(k) for k in range(3))):
                bits, held = unsqueeze(raw.as_py(), "u1", HELD)
                ready = np.flatnonzero(np.unpackbits(bits, count=BLOCK * BLOCK))
                at = np.searchsorted(ready, held["place"])
                n = np.zeros(len(ready), np.int64)
                n[at] = held["n"]
                cover, mean, top = np.full((3, len(ready)), np.nan)
                cover[at] = 100.0 * held["nc"] / held["n"]
                high = held["nc"] > 0
                mean[at[high]] = held["zsum"][high] / held["nc"][high]
                top[at] = held["top"]
                row, col = (ready // BLOCK + br.as_py() * BLOCK).astype(np.int32), (ready % BLOCK + bc.as_py() * BLOCK).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(n), *(pa.array(v, from_pandas=True) for v in (cover, mean, top))], names=["row", "col", "n", "cover", "mean", "top"])

    return blocks.mapInArrow(run, METRICS)


def completed(points: DataFrame, files: DataFrame, grid: Grid, canopy: float = 2.0, name: str = "file", keep: Column | None = None) -> DataFrame:
    """Stream of ``(row, col, n, cover, mean, top)``: each cell once, when the files that cover it have ended.

    ``points``: a stream of ``name, x, y, z`` and ``last``; a row with ``last`` true ends its file.  ``files``: a table of boxes
    by ``name``, all the files that will come.  ``keep``: points that count.  A file counts as read at its end row, however
    many batches it came in; a file without points has the end row alone.  Cells that no file covers never come out;
    covered cells without points come out with ``n`` 0.  State is kept by block of ``BLOCK`` squared cells: the boxes that cover
    it, those that have ended, and sums of cells that hold points; it is
    dropped when all covered cells of the block have come out.  The end of a file sends each block its box, not its cells.
    """
    return cells_of(completed_blocks(points, files, grid, canopy, name, keep))


def completed_blocks(points: DataFrame, files: DataFrame, grid: Grid, canopy: float = 2.0, name: str = "file", keep: Column | None = None) -> DataFrame:
    """Stream of what :func:`completed` gives as ``(br, bc, cells)``: cells of a block that come out together, for :func:`cells_of`.

    A row has a bit a cell and the sums of at most ``TOGETHER`` cells with points, so covered cells without points cost little
    on their way through a table.
    """
    side = lambda first, last: F.sequence(F.expr(f"{first} div {BLOCK}").cast("int"), F.expr(f"{last} div {BLOCK}").cast("int"))
    parts = grid.spans(files.select(name, "xmin", "xmax", "ymin", "ymax"), "out").withColumn("br", F.explode(side("_r0", "_r1")))
    tasks = min(MAX_TASKS, grid.ncell // (BLOCK * CELLS_PER_TASK))
    parts = (parts.repartition(tasks, "br") if tasks > 1 else parts).withColumn("bc", F.explode(side("_c0", "_c1")))
    sides = [F.greatest("_r0", F.col("br") * BLOCK), F.least("_r1", F.col("br") * BLOCK + BLOCK - 1), F.greatest("_c0", F.col("bc") * BLOCK), F.least("_c1", F.col("bc") * BLOCK + BLOCK - 1)]
    parts = parts.select(name, "br", "bc", F.array(*sides).alias("box"))
    boxes = parts.groupBy("br", "bc").agg(F.flatten(F.collect_list("box")).alias("boxes"))  # of the files that meet in a block
    high = F.coalesce(F.col("z") >= canopy, F.lit(False))
    own = points.where(~F.col("last"))
    own = grid.with_cells(own.where(keep) if keep is not None else own)
    own = own.select("row", "col", F.lit(1).cast("long").alias("n"), high.cast("long").alias("nc"), F.when(high, F.col("z")).otherwise(0.0).alias("zsum"), F.when(high, F.col("z")).alias("top"))
    none = F.lit(None).cast("array<int>")
    own = _partial(own).withColumns({"box": none, "boxes": none})
    ends = points.where("last").select(name).join(parts, name).join(boxes, ["br", "bc"])
    ends = ends.select("br", "bc", F.lit(None).cast("binary").alias("cells"), "box", "boxes")

    def counted(of: np.ndarray, key: tuple) -> np.ndarray:
        """How many boxes cover each cell of a block."""
        out = np.zeros((BLOCK, BLOCK), np.int32)
        for r0, r1, c0, c1 in of.reshape(-1, 4) - np.array([key[0], key[0], key[1], key[1]]) * BLOCK:
            out[r0 : r1 + 1, c0 : c1 + 1] += 1
        return out.ravel()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, of, ended = np.zeros(0, HELD), np.zeros(0, np.int32), np.zeros(0, np.int32)
        if state.exists:
            held, of, ended = (np.frombuffer(raw, kind) for raw, kind in zip(state.get, (HELD, np.int32, np.int32)))
        total = counted(of, key)
        before = (total > 0) & (counted(ended, key) >= total)
        sums = [held]
        for f in frames:
            at_end = f["cells"].isna().to_numpy()
            for box, boxes in zip(f["box"][at_end], f["boxes"][at_end]):
                ended = np.append(ended, np.asarray(box, np.int32))
                of = np.asarray(boxes, np.int32)
            sums += [np.frombuffer(raw, HELD) for raw in f["cells"][~at_end]]
        sums = np.concatenate(sums)
        place, held = _sums(*(sums[c] for c in HELD.names))
        held["place"] = place
        total = counted(of, key)
        out = (total > 0) & (counted(ended, key) >= total)
        if len(of) and (out | (total == 0)).all():
            if state.exists:
                state.remove()
        else:
            state.update((held[~out[held["place"]]].tobytes(), of.tobytes(), ended.tobytes()))
        ready = out & ~before
        done = held[ready[held["place"]]]
        edges = [0, *done["place"][TOGETHER::TOGETHER].tolist(), BLOCK * BLOCK] if ready.any() else []
        cells = []
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
            bits = np.zeros(BLOCK * BLOCK, bool)
            bits[lo:hi] = ready[lo:hi]
            cells.append(squeeze(np.packbits(bits), done[k * TOGETHER : (k + 1) * TOGETHER]))
        yield pd.DataFrame({"br": np.full(len(cells), key[0], np.int32), "bc": np.full(len(cells), key[1], np.int32), "cells": cells})

    return own.unionByName(ends).groupBy("br", "bc").applyInPandasWithState(step, BLOCKS, "cells binary, boxes binary, ended binary", "append", GroupStateTimeout.NoTimeout)


# Sums of batches as files --------------------------------------------------------------------------
def partial_metrics(points: DataFrame, grid: Grid, canopy: float = 2.0) -> DataFrame:
    """``(row, col, n, nc, zsum, top)`` of one batch; partials of batches add up."""
    high = F.when(F.col("z") >= canopy, F.col("z"))
    return grid.with_cells(points).groupBy("row", "col").agg(
        F.count("*").alias("n"), F.count(high).alias("nc"), F.sum(high).alias("zsum"), F.max(high).alias("top")
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Count, cover, mean and maximum over all partials of a cell."""
    s = partials.groupBy("row", "col").agg(F.sum("n").alias("n"), F.sum("nc").alias("nc"), F.sum("zsum").alias("zsum"), F.max("top").alias("top"))
    return s.select("row", "col", "n", (100.0 * F.col("nc") / F.col("n")).alias("cover"), F.try_divide("zsum", F.col("nc")).alias("mean"), "top")


def ingest(points: DataFrame, grid: Grid, folder: str, checkpoint: str, canopy: float = 2.0, keep: Column | None = None):
    """Start a query that appends each batch's partials under ``folder``; returns the stream writer's query.

    A batch writes its own partition, replaced as a whole if the batch is tried again: exactly once.
    ``points`` has ``file_id, x, y, z``; rows of each file are counted beside the sums, ``keep`` or not.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        partial_metrics(batch.where(keep) if keep is not None else batch, grid, canopy).write.mode("overwrite").parquet(f"{folder}/partials/batch={number}")
        batch.groupBy("file_id").count().write.mode("overwrite").parquet(f"{folder}/files/batch={number}")
        batch.unpersist()

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_cells(spark: SparkSession, folder: str, files: DataFrame, grid: Grid) -> DataFrame:
    """Metrics of the cells all of whose files have been read; ``files`` has boxes and rows (``n``) by ``file_id``.

    A file is read when as many of its rows have come as its header promises; one of no rows is read from the start.
    """
    seen = spark.read.parquet(f"{folder}/files").groupBy("file_id").agg(F.sum("count").alias("seen"))
    read = files.join(seen, "file_id", "left").where(F.coalesce("seen", F.lit(0)) >= F.col("n")).select("file_id")
    waiting = files.join(read.withColumn("_read", F.lit(1)), "file_id", "left").withColumn("_waiting", F.isnull("_read").cast("int"))
    runs = grid.tallies(waiting, {"waiting": F.col("_waiting")}).withColumn("run", F.struct("z", "waiting")).select("row", F.col("a").alias("col"), F.lit(0).alias("kind"), "run")
    cells = merge_partials(spark.read.parquet(f"{folder}/partials"))
    both = cells.withColumn("kind", F.lit(1)).unionByName(runs, allowMissingColumns=True)
    # each cell sees the run that begins last before it in its row
    along = Window.partitionBy("row").orderBy("col", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("run", F.last("run", ignorenulls=True).over(along))
    return found.where("kind = 1 and col <= run.z and run.waiting = 0").select(*cells.columns)


# Ground that is covered bit by bit -----------------------------------------------------------------
def completed_ground(ground: DataFrame, grid: Grid, zones: Grid, order: str = "ord") -> DataFrame:
    """Stream of ``(row, col, value, n)``: the mean ground of each zone, once, when all its fine cells have a value.

    ``ground``: a stream of ``row, col, value`` in ``grid`` and ``order``, the priority of the file of each; of files that
    overlap the first of a fine cell that comes stays, within a batch that of the smaller order.  The state of a block of zones
    is a bitmap of the fine cells that are still open, and the zones' sums so far; it goes when the bitmap is empty.
    A zone that is never covered wholly never comes out.
    """
    at = {"zr": zones.row(grid.y()), "zc": zones.col(grid.x())}
    inner_x, inner_y = grid.extent.xmin + (np.arange(grid.ncol) + 0.5) * grid.xres, grid.extent.ymax - (np.arange(grid.nrow) + 0.5) * grid.yres
    of_col = np.minimum(np.floor((inner_x - zones.extent.xmin) / zones.xres), zones.ncol - 1).astype(np.int64)
    of_row = np.minimum(np.floor((zones.extent.ymax - inner_y) / zones.yres), zones.nrow - 1).astype(np.int64)
    # zones along the sides of a block, so that it has some BLOCK fine cells along each
    high, wide = (max(1, int(BLOCK * fine / coarse)) for fine, coarse in ((grid.yres, zones.yres), (grid.xres, zones.xres)))
    block = {"br": F.expr(f"cast(zr div {high} as int)"), "bc": F.expr(f"cast(zc div {wide} as int)")}
    rows = ground.where("value is not null").withColumns(at).withColumns(block)
    rows = rows.select("br", "bc", "row", "col", F.col(order).cast("long").alias("ord"), F.col("value").cast("double").alias("value"))

    def edges(of: np.ndarray, first: int, n: int) -> np.ndarray:
        """Where each of ``n`` zones begins among the fine rows or columns, and where the last ends."""
        return np.searchsorted(of, np.arange(first, first + n + 1))

    def by_zone(cells: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How many cells of each zone are set."""
        sums = np.zeros((cells.shape[0] + 1, cells.shape[1] + 1), np.int64)
        sums[1:, 1:] = cells.cumsum(0, dtype=np.int64).cumsum(1)
        r, c = r - r[0], c - c[0]
        return np.diff(np.diff(sums[np.ix_(r, c)], axis=0), axis=1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zr, zc = key[0] * high, key[1] * wide
        r, c = edges(of_row, zr, min(high, zones.nrow - zr)), edges(of_col, zc, min(wide, zones.ncol - zc))
        shape, many = (r[-1] - r[0], c[-1] - c[0]), (len(r) - 1, len(c) - 1)
        if state.exists:
            bits, sums = state.get
            open_ = np.unpackbits(np.frombuffer(bits, np.uint8), count=shape[0] * shape[1]).astype(bool).reshape(shape)
            total = np.frombuffer(sums, float).reshape(many).copy()
        else:
            open_, total = np.ones(shape, bool), np.zeros(many)
        before = by_zone(open_, r, c)
        f = pd.concat(list(frames)).sort_values(["row", "col", "ord"], kind="stable").drop_duplicates(["row", "col"])
        row, col, value = (f[n].to_numpy() for n in ("row", "col", "value"))
        new = open_[row - r[0], col - c[0]]
        np.add.at(total, (of_row[row[new]] - zr, of_col[col[new]] - zc), value[new])
        open_[row - r[0], col - c[0]] = False
        left = by_zone(open_, r, c)
        if not open_.any():
            if state.exists:
                state.remove()
        else:
            state.update((np.packbits(open_).tobytes(), total.tobytes()))
        a, b = np.nonzero((left == 0) & (before > 0))
        size = np.diff(r)[a] * np.diff(c)[b]
        yield pd.DataFrame({"row": (a + zr).astype("int32"), "col": (b + zc).astype("int32"), "value": total[a, b] / size, "n": size.astype("int64")})

    grouped = rows.groupBy("br", "bc")
    return grouped.applyInPandasWithState(step, "row int, col int, value double, n long", "bits binary, sums binary", "append", GroupStateTimeout.NoTimeout)
