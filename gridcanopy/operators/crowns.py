"""Watershed crowns of any size over tiles of any size.

A canopy cell takes the crown of the neighbour that the flood reaches first.  The flood goes from the highest
level down; a cell is reached at the lowest level on its way and, within a level, in steps; what is reached in
one step is ordered by tops, the higher first.  This order refers to no tile: each tile floods from its own
tops and from what its neighbours report of the cells along its border, and floods again when such a report
changes.  Reports start at "not reached" and levels and steps in them only fall, so rounds end, with the
result of one raster.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.lineage import materialize, release
from .raster import values

#: What a tile reports of a labelled border cell: place, level, step, and the top's height and place.
REPORT = np.dtype([("row", "<i4"), ("col", "<i4"), ("level", "<i8"), ("step", "<i8"), ("value", "<f8"), ("top_row", "<i4"), ("top_col", "<i4")])
AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
#: Frame around a tile: the neighbours' border cells, and room for their own neighbours.
PAD = 2


def levels(heights: np.ndarray, cutoff: float, max_height: float, bin_size: float) -> np.ndarray:
    """Height bins counted from the top; heights over ``max_height`` are in the first."""
    last = max(0, int(np.ceil((max_height - cutoff) / bin_size)) - 1)
    down = np.floor((max_height - np.nan_to_num(heights, nan=cutoff)) / bin_size)
    return np.clip(down, 0, last).astype(np.int64)


class Flood:
    """The flood of one tile: level, step and rank of the top of every reached cell."""

    def __init__(self, heights: np.ndarray, cutoff: float, max_height: float, bin_size: float):
        self.shape = heights.shape
        full = np.full((self.shape[0] + 2 * PAD, self.shape[1] + 2 * PAD), np.nan)
        full[PAD:-PAD, PAD:-PAD] = heights
        self.width = full.shape[1]
        self.canopy = (np.nan_to_num(full, nan=-np.inf) >= cutoff).ravel()
        self.depth = levels(full, cutoff, max_height, bin_size).ravel()
        self.near = np.array([dr * self.width + dc for dr, dc in AROUND])

    def at(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Places in the frame of rows and columns of the tile, from -1 on."""
        return (np.asarray(row, np.int64) + PAD) * self.width + np.asarray(col, np.int64) + PAD

    def run(self, tops: np.ndarray, ranks: np.ndarray, outer: np.ndarray, level: np.ndarray, step: np.ndarray, outer_ranks: np.ndarray) -> None:
        """Flood from ``tops`` in the tile and from labelled cells around it, each with its rank (0 first)."""
        size = len(self.canopy)
        self.rank, self.level, self.step = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        open_ = self.canopy.copy()
        self.rank[tops], self.level[tops], open_[tops] = ranks, self.depth[tops], False
        waiting: dict[int, list[np.ndarray]] = {}
        for k in np.unique(self.depth[tops]).tolist():
            waiting[k] = [tops[self.depth[tops] == k]]
        order = np.lexsort((step, level))
        outer, level, step, outer_ranks = outer[order], level[order], step[order], outer_ranks[order]
        todo = sorted({*waiting, *level.tolist()})
        while todo:
            now = heapq.heappop(todo)
            cells = np.concatenate(waiting.pop(now, []) or [np.zeros(0, np.int64)])
            lo, hi = np.searchsorted(level, (now, now + 1))
            layer = 0
            while len(cells) or lo < hi:
                if not len(cells):
                    layer = max(layer, int(step[lo]))
                source, rank = cells, self.rank[cells]
                if lo < hi and step[lo] <= layer:
                    end = lo + int(np.searchsorted(step[lo:hi], layer, "right"))
                    source, rank = np.concatenate([source, outer[lo:end]]), np.concatenate([rank, outer_ranks[lo:end]])
                    lo = end
                found = (source[:, None] + self.near).ravel()
                keep = open_[found]
                found, rank = found[keep], np.repeat(rank, len(self.near))[keep]
                if len(found):
                    order = np.lexsort((rank, found))
                    found, rank = found[order], rank[order]
                    first = np.append(True, found[1:] != found[:-1])
                    found, rank = found[first], rank[first]
                    open_[found] = False
                    self.rank[found] = rank
                    at = np.maximum(self.depth[found], now)
                    self.level[found] = at
                    same = at == now
                    self.step[found[same]] = layer + 1
                    for k in np.unique(at[~same]).tolist():
                        if k not in waiting:
                            waiting[k] = []
                            heapq.heappush(todo, k)
                        waiting[k].append(found[at == k])
                    found = found[same]
                cells = found
                layer += 1

    def inner(self, flat: np.ndarray) -> np.ndarray:
        return flat.reshape(-1, self.width)[PAD:-PAD, PAD:-PAD]


def watershed(heights: np.ndarray, tops: list[tuple[int, int]], cutoff: float, max_height: float, bin_size: float = 0.01) -> np.ndarray:
    """Crowns of one raster: 1, 2, ... for the tops in order, 0 under the cutoff, -1 no data or unreached.

    Where two tops reach a cell at once, the earlier in the list has it.
    """
    f = Flood(heights, cutoff, max_height, bin_size)
    at = np.array(tops, np.int64).reshape(-1, 2)
    none = np.zeros(0, np.int64)
    f.run(f.at(at[:, 0], at[:, 1]), np.arange(len(at)), none, none, none, none)
    out = f.inner(f.rank).copy()
    out[out >= 0] += 1
    out[~np.isnan(heights) & ~f.inner(f.canopy)] = 0
    return out


def squeeze(*columns: np.ndarray) -> bytes:
    """Arrays one after another, deflated, after their sizes."""
    sizes = np.array([c.nbytes for c in columns], "<i8").tobytes()
    return sizes + pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<i8", len(kinds))
    total = int(sizes.sum())
    raw = pa.decompress(blob[sizes.nbytes :], total, codec="zstd", asbytes=True) if total else b""
    at = np.cumsum(sizes) - sizes
    return [np.frombuffer(raw, k, int(n) // np.dtype(k).itemsize, int(a)) for k, n, a in zip(kinds, sizes, at)]


def _placed(bits: np.ndarray, tile: int) -> np.ndarray:
    """Places in a tile, by rows, of the cells that have a value."""
    return np.flatnonzero(np.unpackbits(bits, count=tile * tile))


def _packed(csm: DataFrame, tops: DataFrame, tile: int) -> DataFrame:
    """``(tr, tc, cells, tops)``: a row a tile; a bit a cell and the heights there are, and tops as places in it.

    Rows are deflated here and not by the tables that hold them, as Spark and its joins go by the size that is written.
    """
    none = F.lit(None).cast("double")
    cells = values(csm).select("row", "col", F.col("value").cast("double").alias("value"), F.lit(False).alias("top"))
    both = cells.unionByName(tops.select("row", "col", none.alias("value"), F.lit(True).alias("top")))
    both = both.withColumns({"tr": F.expr(f"cast(row div {tile} as int)"), "tc": F.expr(f"cast(col div {tile} as int)")})

    def run(key: tuple, t: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        at, top = (t["row"].to_numpy() - tr * tile) * tile + t["col"].to_numpy() - tc * tile, t["top"].to_numpy()
        h = np.full(tile * tile, np.nan)
        h[at[~top]] = t["value"].to_numpy()[~top]
        has = ~np.isnan(h)
        cells, places = squeeze(np.packbits(has), h[has]), np.unique(at[top]).astype("<i4").tobytes()
        return pa.table([pa.array([tr], pa.int32()), pa.array([tc], pa.int32()), pa.array([cells], pa.binary()), pa.array([places], pa.binary())], names=["tr", "tc", "cells", "tops"])

    return both.groupBy("tr", "tc").applyInArrow(run, "tr int, tc int, cells binary, tops binary")


def _flooded(tiles: DataFrame, tile: int, cutoff: float, max_height: float, bin_size: float) -> DataFrame:
    """``(tr, tc, crowns, reports)`` of tiles with the reports of their neighbours (``around``, null for none).

    ``crowns`` holds a bit a cell, for each cell with a height the number of its top, -1 where there is none and -2 under
    the cutoff, and the rows and columns of the tops; ``reports`` is what each neighbour is told.
    """
    schema = "tr int, tc int, crowns binary, reports array<struct<to_tr:int,to_tc:int,report:binary>>"

    def one(tr: int, tc: int, cells: bytes, tops: bytes, around: list[bytes]) -> tuple[bytes, list[dict]]:
        bits, heights = unsqueeze(cells, "u1", "<f8")
        places = _placed(bits, tile)
        h = np.full((tile, tile), np.nan)
        h.ravel()[places] = heights
        own = np.frombuffer(tops, "<i4").astype(np.int64)
        r, c = own // tile, own % tile
        told = np.concatenate([np.zeros(0, REPORT), *(unsqueeze(r, REPORT)[0] for r in around)])
        every = np.rec.fromarrays([
            np.append(h[r, c], told["value"]), np.append(r + tr * tile, told["top_row"]), np.append(c + tc * tile, told["top_col"]),
        ], names="value,row,col")
        order = np.lexsort((every["col"], every["row"], -every["value"]))
        by = every[order]
        new = np.append(True, (by["row"][1:] != by["row"][:-1]) | (by["col"][1:] != by["col"][:-1])) if len(by) else np.zeros(0, bool)
        rank = np.empty(len(by), np.int64)
        rank[order] = np.cumsum(new) - 1
        names = by[new]
        f = Flood(h, cutoff, max_height, bin_size)
        at = f.at(told["row"].astype(np.int64) - tr * tile, told["col"].astype(np.int64) - tc * tile)
        f.run(f.at(r, c), rank[: len(own)], at, told["level"].astype(np.int64), told["step"].astype(np.int64), rank[len(own) :])
        got = f.inner(f.rank)
        has = got >= 0
        top = np.where(f.inner(f.canopy), got, -2).ravel()[places]
        used, number = np.unique(top[top >= 0], return_inverse=True)
        top[top >= 0] = number
        crowns = squeeze(bits, top.astype("<i4"), *(names[n][used].astype("<i4") for n in ("row", "col")))
        reports = []
        for dr, dc in AROUND:
            rows = np.arange(tile) if dr == 0 else np.array([0 if dr < 0 else tile - 1])
            cols = np.arange(tile) if dc == 0 else np.array([0 if dc < 0 else tile - 1])
            rr, cc = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
            keep = has[rr, cc]
            rr, cc = rr[keep], cc[keep]
            out = np.zeros(len(rr), REPORT)
            out["row"], out["col"] = rr + tr * tile, cc + tc * tile
            out["level"], out["step"] = f.inner(f.level)[rr, cc], f.inner(f.step)[rr, cc]
            for name, of in (("value", "value"), ("top_row", "row"), ("top_col", "col")):
                out[name] = names[of][got[rr, cc]]
            reports.append({"to_tr": tr + dr, "to_tc": tc + dc, "report": squeeze(out) if len(out) else b""})
        return crowns, reports

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("to_tr", pa.int32()), ("to_tc", pa.int32()), ("report", pa.binary())]))
        tr, tc = key[0].as_py(), key[1].as_py()
        cells, tops, around = (t[n][0].as_py() for n in ("cells", "tops", "around"))
        crowns, reports = one(tr, tc, cells, tops, [r for r in around or [] if r])
        return pa.table([pa.array([tr], pa.int32()), pa.array([tc], pa.int32()), pa.array([crowns], pa.binary()), pa.array([reports], kind)], names=["tr", "tc", "crowns", "reports"])

    # by tile, as a batch of many tiles does not fit a task
    return tiles.select("tr", "tc", "cells", "tops", "around").groupBy("tr", "tc").applyInArrow(run, schema)


def segments(csm: DataFrame, tops: DataFrame, grid: Grid, tile: int = 512, cutoff: float = 2.0, max_height: float = 100.0, bin_size: float = 0.01) -> DataFrame:
    """``(row, col, tao_row, tao_col)``: the top whose crown holds each cell; null under the cutoff.

    The result does not depend on ``tile``, whatever the size of crowns.  A task holds one tile; rounds go on
    while a report changes, over the tiles that it concerns.  Tops are named by their own cell.  Canopy that no
    top reaches has no row.
    """
    key, link = ["tr", "tc"], ["tr", "tc", "from_tr", "from_tc"]
    packed = materialize(_packed(csm, tops, tile))
    done = [materialize(_flooded(packed.withColumn("around", F.lit(None).cast("array<binary>")), tile, cutoff, max_height, bin_size))]
    last_r, last_c = (grid.nrow - 1) // tile, (grid.ncol - 1) // tile

    def reports(k: int) -> DataFrame:
        each = done[k].select(F.col("tr").alias("from_tr"), F.col("tc").alias("from_tc"), F.explode("reports").alias("r"))
        inside = each.select(F.col("r.to_tr").alias("tr"), F.col("r.to_tc").alias("tc"), "from_tr", "from_tc", F.struct(F.lit(k).alias("k"), "r.report").alias("told"))
        return inside.where(f"tr between 0 and {last_r} and tc between 0 and {last_c}")

    told = reports(0)
    while True:
        # a neighbour's last two reports: is the last of this round, and other than the one before
        k = len(done) - 1
        pair = told.groupBy(*link).agg(F.max("told").alias("last"), F.max(F.when(F.col("told.k") < k, F.col("told"))).alias("before"))
        news = (F.col("last.k") == k) & (F.length("last.report") > 0) & ~F.col("last.report").eqNullSafe(F.col("before.report"))
        around = pair.groupBy(*key).agg(F.collect_list("last.report").alias("around"), F.bool_or(news).alias("news"))  # of eight tiles at most
        around = materialize(around.where("news").drop("news"))
        if around.isEmpty():
            release(around)
            break
        done.append(materialize(_flooded(packed.join(around, key), tile, cutoff, max_height, bin_size)))
        release(around)
        told = told.unionByName(reports(k + 1))
    release(packed)
    every = None
    for k, d in enumerate(done):
        part = d.select(*key, F.lit(k).alias("round"), "crowns")
        every = part if every is None else every.unionByName(part)
    if len(done) > 1:
        every = every.join(every.groupBy(*key).agg(F.max("round").alias("round")), [*key, "round"])
    return _unpacked(every, tile)


def _unpacked(tiles: DataFrame, tile: int) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        bits, own, *tops = unsqueeze(t["crowns"][0].as_py(), "u1", "<i4", "<i4", "<i4")
        there = own != -1
        (r, c), own = np.divmod(_placed(bits, tile)[there], tile), own[there]
        low = own < 0
        names = [pa.array(np.append(v, np.int32(0))[own.clip(-1)], pa.int32(), mask=low) for v in tops]
        return pa.table([pa.array((r + tr * tile).astype(np.int32)), pa.array((c + tc * tile).astype(np.int32)), *names], names=["row", "col", "tao_row", "tao_col"])

    return tiles.select("tr", "tc", "crowns").groupBy("tr", "tc").applyInArrow(run, "row int, col int, tao_row int, tao_col int")
