"""Hard negatives by exact integer inner products, behind an orthogonal rotation that discards early.

Vectors are rotated onto the principal directions of a sample.  A pair's product is accumulated over the
leading components; what the rest can add is at most the product of both residual norms, and rounding is
covered by a slack.  Pairs that cannot reach what their anchor already has, or lie outside the window of
its positives, go; the others' products are taken anew in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

POSITIVES, NEGATIVES = 5, 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
SCALE, EVERY = 256, 100
#: Rows that a rotation is fitted on at most; it decides what is discarded early, never what is found.
SAMPLE = 8192
#: Anchors whose vectors a task holds, rows that meet them in one stream at most, and both sides of one product.
ANCHORS, STREAM, SIDE, WIDE = 1 << 15, 1 << 24, 256, 2048
#: Share of the components after which bounds are taken.
LEADING = (0.25, 0.5, 0.75)
_NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(id, label, dim, q)`` of the rows that take part: components ``floor(scale * x)`` as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            x = np.array(flat.to_numpy(zero_copy_only=False), np.float64)
            good = np.isfinite(x) & flat.is_valid().to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            v = np.floor(scale * np.where(good, x, 0))
            keep, out = [], []
            for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
                if good[lo:hi].all() and np.dot(v[lo:hi], v[lo:hi]) < 2.0**62:
                    keep.append(k)
                    out.append(v[lo:hi].astype("<i8").tobytes())
            at = pa.array(keep, pa.int64())
            dim = pa.array([len(q) // 8 for q in out], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), dim, pa.array(out, pa.binary())], names=["id", "label", "dim", "q"])

    return rows.mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, dim int, q binary")


def rotation(x: np.ndarray) -> np.ndarray:
    """Columns: orthonormal principal directions of the rows' second moments, largest first."""
    x = x.astype(np.float64)
    _, vectors = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vectors[:, ::-1])


class Side:
    """Integer vectors with their rotated form, norms, and norms of what is left after each leading part."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, turn: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.r = q.astype(np.float64) @ turn
        d = q.shape[1]
        self.cuts = sorted({max(1, round(d * share)) for share in LEADING} - {d}) if d > 1 else []
        square = self.r * self.r
        self.norm = np.sqrt(square.sum(1))
        self.rest = [np.sqrt(square[:, c:].sum(1)) for c in self.cuts]


def slack(dim: int) -> float:
    """Relative to both norms, more than rounding of the rotation and of the sums can come to."""
    return 8 * (dim + 8) ** 2 * np.finfo(np.float64).eps


class Best:
    """The ``k`` best ``(score, id)`` of each slot: higher scores, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), _NONE)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        if not len(touched):
            return
        old = self.score[touched].ravel() != _NONE
        slot = np.concatenate([np.repeat(touched, self.k)[old], slot])
        score = np.concatenate([self.score[touched].ravel()[old], score])
        ids = np.concatenate([self.ids[touched].ravel()[old], ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        top = rank < self.k
        self.score[touched], self.ids[touched] = _NONE, np.iinfo(np.int64).max
        self.score[slot[top], rank[top]], self.ids[slot[top], rank[top]] = score[top], ids[top]

    @property
    def least(self) -> np.ndarray:
        """The score that an entry must reach to be among the best of its slot."""
        return self.score[:, -1]


def reaching(a: Side, rows: np.ndarray, b: Side, open_: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, product)`` of the open pairs whose product is from ``low`` to ``high`` of its anchor.

    ``rows`` are the anchors' places in ``a``; ``open_``, ``low`` and ``high`` follow them.
    """
    dim = a.q.shape[1]
    near = slack(dim)
    i, j = None, None
    done = 0
    for c, ra, rb in zip(a.cuts, a.rest, b.rest):
        if i is None:
            part = a.r[rows, :c] @ b.r[:, :c].T
            spare = np.outer(ra[rows], rb) + near * np.outer(a.norm[rows], b.norm)
            i, j = np.nonzero(open_ & (part + spare >= low[:, None]) & (part - spare <= high[:, None]))
            part = part[i, j]
        else:
            part = part + np.einsum("ij,ij->i", a.r[rows[i], done:c], b.r[j, done:c])
            spare = ra[rows[i]] * rb[j] + near * a.norm[rows[i]] * b.norm[j]
            keep = (part + spare >= low[i]) & (part - spare <= high[i])
            i, j, part = i[keep], j[keep], part[keep]
        done = c
    if i is None:
        i, j = np.nonzero(open_)
    exact = np.einsum("ij,ij->i", a.q[rows[i]], b.q[j])
    keep = (exact >= low[i]) & (exact <= high[i])
    return i[keep], j[keep], exact[keep]


def _positives(a: Side, blocks: Iterator[Side], _: list) -> Iterator[tuple[np.ndarray, ...]]:
    """``(anchor, which, score, id)``: the first rows of an anchor's label in this stream; ``which`` is 0."""
    best = Best(len(a.ids), POSITIVES)
    top = np.full(len(a.ids), np.iinfo(np.int64).max)
    for b in blocks:
        for lo in range(0, len(a.ids), SIDE):
            rows = np.arange(lo, min(lo + SIDE, len(a.ids)))
            open_ = (a.labels[rows, None] == b.labels) & (a.ids[rows, None] != b.ids)
            if open_.any():
                i, j, s = reaching(a, rows, b, open_, best.least[rows], top[rows])
                best.add(rows[i], s, b.ids[j])
    k, at = np.nonzero(best.score != _NONE)
    yield k, np.zeros(len(k), np.int64), best.score[k, at], best.ids[k, at]


def _negatives(a: Side, blocks: Iterator[Side], windows: list[list[int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """``(anchor, which, score, id)``: the first rows of another label for each positive score, by its number."""
    widest = max(map(len, windows))
    score = np.full((len(windows), widest), _NONE)
    for k, w in enumerate(windows):
        score[k, : len(w)] = w
    real = score != _NONE
    # least integer s with HIGH_PERCENT * s >= LOW_PERCENT * score; Python's integers do not overflow
    low = np.array([[-(-LOW_PERCENT * int(s) // HIGH_PERCENT) if s != _NONE else np.iinfo(np.int64).max for s in row] for row in score], np.int64)
    best = Best(len(windows) * widest, NEGATIVES)
    top = np.where(real, score, _NONE).max(1)
    for b in blocks:
        for lo in range(0, len(a.ids), SIDE):
            rows = np.arange(lo, min(lo + SIDE, len(a.ids)))
            open_ = (a.labels[rows, None] != b.labels) & (a.ids[rows, None] != b.ids)
            held = best.least.reshape(-1, widest)[rows]
            need = np.where(real[rows], np.maximum(low[rows], held), np.iinfo(np.int64).max).min(1)
            i, j, s = reaching(a, rows, b, open_, need, top[rows])
            for w in range(widest):
                at = rows[i]
                fits = (s >= low[at, w]) & (s <= score[at, w]) & real[at, w] & (s >= held[i, w])
                best.add(at[fits] * widest + w, s[fits], b.ids[j[fits]])
    slot, at = np.nonzero(best.score != _NONE)
    yield slot // widest, slot % widest, best.score[slot, at], best.ids[slot, at]


def _meet(anchors: DataFrame, rows: DataFrame, turns: dict[int, np.ndarray], streams: dict[int, int], chunks: dict[int, int], search) -> DataFrame:
    """``(anchor, which, score, other)`` of what ``search`` finds when all anchors meet all rows of their width.

    Anchors are dealt into chunks and rows into streams; each chunk and stream meet in a group of one task,
    where the chunk comes first and stays while the stream's rows pass in blocks.  Both kinds are dealt by hash of
    id, so no label, key or group of copies makes a group larger.
    """
    n_streams = _by_dim(streams)
    n_chunks = _by_dim(chunks)
    left = anchors.select(
        "dim", F.pmod(F.xxhash64("anchor"), n_chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), n_streams - 1)).alias("stream"),
        F.lit(0).alias("kind"), "anchor", "id", "label", "q", "windows",
    )
    right = rows.select(
        "dim", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"), F.pmod(F.xxhash64("id", "q"), n_streams).cast("int").alias("stream"),
        F.lit(1).alias("kind"), F.lit(0).cast("long").alias("anchor"), "id", "label", "q", F.lit(None).cast("array<long>").alias("windows"),
    )
    key = ["dim", "chunk", "stream"]
    groups = sum(chunks[d] * streams[d] for d in chunks)
    dealt = left.unionByName(right).repartition(groups, *key).sortWithinPartitions(*key, "kind", "id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Parts of batches of one group and kind, in order."""
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(k).to_numpy() for k in range(4)]
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                yield tuple(int(x[lo]) for x in at), b.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = pieces(batches)
        nxt = next(todo, None)

        def side(parts: list[pa.RecordBatch], dim: int) -> Side:
            t = pa.Table.from_batches(parts)
            q = np.frombuffer(b"".join(t["q"].to_pylist()), "<i8").reshape(len(t), dim)
            return Side(t["id"].to_numpy(), t["label"].to_numpy(), q, turns[dim])

        while nxt:
            group, held = nxt[0][:3], []
            while nxt and nxt[0] == (*group, 0):
                held.append(nxt[1])
                nxt = next(todo, None)

            def blocks() -> Iterator[Side]:
                nonlocal nxt
                while nxt and nxt[0] == (*group, 1):
                    part = nxt[1]
                    nxt = next(todo, None)
                    if held:
                        for lo in range(0, part.num_rows, WIDE):
                            yield side([part.slice(lo, WIDE)], group[0])

            if not held:
                for _ in blocks():
                    pass
                continue
            a = side(held, group[0])
            t = pa.Table.from_batches(held)
            names = t["anchor"].to_numpy()
            for k, which, score, other in search(a, blocks(), t["windows"].to_pylist()):
                columns = [pa.array(names[k]), pa.array(which, pa.int32()), pa.array(score), pa.array(other)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "which", "score", "other"])

    return dealt.mapInArrow(run, "anchor long, which int, score long, other long")


def _by_dim(values: dict[int, int]):
    out = F.lit(1)
    for dim, n in values.items():
        out = F.when(F.col("dim") == dim, F.lit(n)).otherwise(out)
    return out


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each ``(anchor, which)`` with their ``rank``; ranks are cut in the tasks before rows are shuffled."""
    order = Window.partitionBy("anchor", "which").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", every: int = EVERY, relabel=None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, hard negatives of every anchor.

    Anchors are rows whose id ``every`` divides.  An anchor's positives are the ``POSITIVES`` best rows of its
    label under other ids; for each, the ``NEGATIVES`` best rows of other labels and ids from 80 to 100 % of
    the positive's product.  Higher products come first, then smaller ids.  ``relabel`` maps the id and label
    columns to the label that counts.

    Defined cases: a row without id, label or vector, or with a null or non-finite component, takes no part, nor
    does one whose squared norm in integers reaches 2**62, whose products have no 64-bit form; vectors of
    different widths have no product.  Rows equal in id, label and vector are one anchor, others of one id are
    anchors of their own; as positives and negatives rows count as often as they are repeated.  A negative
    positive score has no window.  Other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    read = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    if relabel is not None:
        read = read.withColumn("label", relabel(F.col("id"), F.col("label")))
    read = read.where("id is not null and label is not null and v is not null").withColumn("label", F.xxhash64(F.col("label").cast("string")))
    table = materialize(quantised(read))
    sizes = {r["dim"]: (r["n"], r["a"]) for r in table.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("a")).collect()}
    sizes = {d: s for d, s in sizes.items() if d and s[1]}
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes:
        return spark.createDataFrame([], empty)
    turns = {}
    for dim in sizes:
        some = table.where(F.col("dim") == dim).select("q").orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, (1 << 26) // (8 * dim)))).collect()
        turns[dim] = rotation(np.frombuffer(b"".join(bytes(r["q"]) for r in some), "<i8").reshape(-1, dim))
    chunks = {d: -(-a // ANCHORS) for d, (_, a) in sizes.items()}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streams = {d: max(-(-n // STREAM), -(-tasks // chunks[d])) for d, (n, _) in sizes.items()}
    table = table.where(F.col("dim").isin(*sizes))
    anchors = table.where(F.col("id") % every == 0).distinct().withColumn("anchor", F.xxhash64("id", "label", "q"))
    pairs = _first(_meet(anchors.withColumn("windows", F.lit(None).cast("array<long>")), table, turns, streams, chunks, _positives), POSITIVES)
    pairs = materialize(pairs.select("anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = pairs.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    found = _first(_meet(anchors.join(windows, "anchor"), table, turns, streams, chunks, _negatives), NEGATIVES)
    named = windows.select("anchor", F.posexplode("windows").alias("which", "positive_score")).join(pairs, ["anchor", "positive_score"])
    return (
        found.join(named, ["anchor", "which"])
        .join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
