"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a product grid.  Every vector has one home
cell; it visits other cells in order of a lower bound on their distance, up to a radius at which a
wanted share of vectors at the linking cosine is met.  Members of a cell and its visitors are then
compared exactly, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

COSINE = 0.98
#: Vectors that codebooks and the radius are fitted on at most, and words of a codebook at most.
SAMPLE, MAX_WORDS = 8192, 256
#: Vectors of a label that a cell should hold, members of a cell in one block, share of links to meet.
PER_CELL, BLOCK, TARGET_RECALL = 24, 1024, 0.9995
#: Crowded cells, of which there is one for BLOCK vectors at most, that are sent to all tasks.
BROADCAST_CELLS = 200_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, steps: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from a seeded start; empty words keep their place."""
    k = max(1, min(k, len(x)))
    words = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = _far(x, words).argmin(1)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        words[n > 0] = total[n > 0] / n[n > 0, None]
    return words


def _far(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


class MultiIndex:
    """Two codebooks and the squared radius up to which cells are visited."""

    def __init__(self, first: np.ndarray, second: np.ndarray, radius2: float):
        self.words, self.radius2 = (first, second), radius2
        self.gaps = [np.sqrt(_far(w, w)) for w in self.words]

    @classmethod
    def fit(cls, sample: np.ndarray, words: int, cosine: float = COSINE, target: float = TARGET_RECALL, seed: int = 7) -> MultiIndex:
        """Fit on unit vectors; the radius meets ``target`` of partners at exactly ``cosine``, in
        random directions (real partners are as close or closer)."""
        half = sample.shape[1] // 2
        index = cls(kmeans(sample[:, :half], words, seed=seed), kmeans(sample[:, half:], words, seed=seed + 1), 0.0)
        if sample.shape[1] < 2:
            index.radius2 = np.inf
            return index
        side = np.random.default_rng(seed).normal(size=sample.shape)
        side = unit(side - (side * sample).sum(1, keepdims=True) * sample + 1e-300)
        partner = cosine * sample + np.sqrt(1 - cosine**2) * side
        i, j = index.home(partner)
        rows = np.arange(len(sample))
        low = index.bounds(sample)
        index.radius2 = float(np.quantile(low[0][rows, i] + low[1][rows, j], target)) * 1.05 + 1e-9
        return index

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return x[:, :half], x[:, half:]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_far(h, w).argmin(1) for h, w in zip(self.halves(x), self.words))

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each half to the plane between its word's cell and every other."""
        out = []
        for h, w, gap in zip(self.halves(x), self.words, self.gaps):
            d = _far(h, w)
            a = d.argmin(1)
            rows = np.arange(len(d))
            low = (d - d[rows, a][:, None]) / (2 * np.maximum(gap[a], 1e-12))
            low[rows, a] = 0
            out.append(np.maximum(low, 0) ** 2)
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(home cell, visitor row, visited cell)``; of two cells the vector of the lower visits.

        Both halves' words are walked in order of their bounds, so the cells of a row come off the
        grid as a staircase of growing sums, which ends at the radius.
        """
        i, j = self.home(x)
        width = len(self.words[1])
        own = i * width + j
        one, two = self.bounds(x)
        rows, cells = [], []
        for step in range(one.shape[1]):
            open_rows = np.flatnonzero(one[:, step] <= self.radius2)
            r, c = np.nonzero(one[open_rows, step][:, None] + two[open_rows] <= self.radius2)
            cell = step * width + c
            later = cell > own[open_rows[r]]
            rows.append(open_rows[r][later])
            cells.append(cell[later])
        return own, np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _spread(classes: DataFrame, index: MultiIndex) -> DataFrame:
    """``(label, cell, role, cid, n, embedding)``: role 0 at home, 1 on a visit."""
    held = classes.sparkSession.sparkContext.broadcast((*index.words, index.radius2))
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = MultiIndex(*held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                own, rows, cells = m.visits(unit(_matrix(part.column(3))))
                take = pa.array(np.concatenate((np.arange(len(own)), rows)))
                got = part.take(take)
                role = np.concatenate((np.zeros(len(own), np.int32), np.ones(len(rows), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [got.column(0), pa.array(np.concatenate((own, cells))), pa.array(role), *got.columns[1:]],
                    names=["label", "cell", "role", "cid", "n", "embedding"],
                )

    schema = f"label {kinds['label']}, cell long, role int, cid long, n long, embedding {kinds['embedding']}"
    return classes.select("label", "cid", "n", "embedding").mapInArrow(run, schema)


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one block, members first: emit ``(cid, other, links)``.

    Counts have a null ``other``; links have one row for each member that a smaller one reaches
    and for each reached cluster of a visitor, so a group of k copies emits about k rows.
    """
    key, home, cid, n, label, counted, done = None, None, None, None, None, None, True

    def out(a, b, k):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], names=["cid", "other", "links"]
        )

    def close_homes():
        near = home @ home.T >= cosine
        np.fill_diagonal(near, False)
        counted[:] += near @ n
        lab = np.arange(len(home))
        while True:
            new = np.minimum(lab, np.where(near, lab, len(lab)).min(1, initial=len(lab)))
            new = new[new]
            if (new == lab).all():
                return lab
            lab = new

    def flush():
        if key is None:
            return
        lab = label if done else close_homes()
        hit = np.flatnonzero(counted)
        if len(hit):
            yield out(cid[hit], [None] * len(hit), counted[hit])
        moved = np.flatnonzero(lab != np.arange(len(lab)))
        if len(moved):
            yield out(cid[moved], cid[lab[moved]], np.zeros(len(moved), np.int64))

    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
        group = np.array([a != z for a, z in zip(keys, keys[1:])], bool)
        role, ids, times = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
        x = unit(_matrix(b.column(6)))
        cuts = np.flatnonzero(group | (np.diff(role) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(role)]):
            if keys[lo] != key:
                yield from flush()
                key, done, label = keys[lo], False, None
                home, cid, n, counted = np.zeros((0, x.shape[1])), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if role[lo] == 0:
                home, cid, n = np.vstack((home, x[lo:hi])), np.append(cid, ids[lo:hi]), np.append(n, times[lo:hi])
                counted = np.zeros(len(cid), np.int64)
                continue
            if not done:
                label, done = close_homes(), True
            for at in range(lo, hi, 2048):
                to = min(hi, at + 2048)
                near = x[at:to] @ home.T >= cosine
                if not near.any():
                    continue
                counted += times[at:to] @ near
                links = near @ n
                hit = np.flatnonzero(links)
                yield out(ids[at:to][hit], [None] * len(hit), links[hit])
                r, c = np.nonzero(near)
                pair = np.unique(np.stack((r, label[c])), axis=1)
                yield out(ids[at:to][pair[0]], cid[pair[1]], np.zeros(pair.shape[1], np.int64))
    yield from flush()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``(vec_id, embedding, label)``.

    Equal vectors of a label are compared once and counted as often as they occur.  Vectors that are
    null, zero, or hold null or non-finite parts, and rows of null label, link with nothing.  A row
    with a null id counts as a link of others but names no component.  Vectors of different widths do not link.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    e = F.col("embedding")
    inf = float("inf")
    good = (
        F.col("label").isNotNull()
        & e.isNotNull()
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
        & F.exists(e, lambda v: v != 0)
    )
    good = F.coalesce(good, F.lit(False))
    valid = rows.where(good)
    classes = materialize(
        valid.groupBy("label", "embedding")
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    width = F.size("embedding")
    size = classes.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min(width).alias("least"), F.max(width).alias("most")).first()
    if size["n"] and size["least"] < size["most"]:  # zeros change no cosine, and widths meet only their own
        kind = classes.schema["embedding"].dataType.simpleString()
        zeros = F.array_repeat(F.lit(0), F.lit(size["most"]) - width).cast(kind)
        filled = valid.select("vec_id", F.concat("embedding", zeros).alias("embedding"), F.struct("label", width.alias("width")).alias("label"))
        alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        alone = alone.withColumn("kept", F.col("vec_id").isNotNull())
        return near_duplicates(filled, cosine, target_recall).unionByName(alone)
    if not size["n"]:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").collect()
    words = int(np.clip(np.sqrt(size["n"] / size["labels"] / PER_CELL), 1, MAX_WORDS))
    index = MultiIndex.fit(unit(np.array([r["embedding"] for r in sample])), words, cosine, target_recall)
    spread = materialize(_spread(classes, index))
    # cells of more than BLOCK members are cut into blocks; members also visit their later blocks
    crowded = spread.where("role = 0").groupBy("label", "cell").count().where(F.col("count") > BLOCK)
    crowded = crowded.select("label", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    crowded = materialize(crowded)
    if crowded.count() <= BROADCAST_CELLS:  # else an ordinary join
        crowded = F.broadcast(crowded)
    cut = spread.join(crowded, ["label", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    cut = cut.withColumn("own", F.when(F.col("role") == 0, own).otherwise(F.lit(0)))
    cut = cut.withColumn("block", F.explode(F.sequence("own", F.col("blocks") - 1)))
    cut = cut.withColumn("role", F.when((F.col("role") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1))
    cut = cut.select("label", "cell", "block", "role", "cid", "n", "embedding")
    dealt = cut.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role", "cid")
    found = materialize(dealt.mapInArrow(lambda b: _compare(b, cosine), "cid long, other long, links long"))
    links = found.where("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    parts = connected_components(edges)
    named = (
        classes.join(links, "cid", "left")
        .join(parts, F.col("cid") == F.col("node"), "left")
        .select("label", "embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("root"))
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("label", "embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = valid.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    apart = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(apart)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
