"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash propose pairs, whole sets decide.

Each set has a SimHash fingerprint, and :mod:`simhash` groups all fingerprints within four bits; what it groups is
compared by whole sets.  Four bits of 64 reach only the nearest copies, so MinHash bands propose the others.  Two texts
of similarity ``s`` share none of the bands with probability ``(1 - s**ROWS) ** BANDS``, 1.3e-7 at 0.8 and less above.
What shares a band is compared by its whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, give_back, materialize, slices
from .simhash import link_components, majority
from .suffix_tree_lm import Words

SHINGLE = 5
#: Similarity of near copies as a fraction, so that the comparison is exact.
SIMILAR, OF = 4, 5
ROWS, BANDS = 5, 40
#: Shingles hashed at a time; their hashes under all functions stay in a core's cache.
CHUNK = 1 << 9
#: Sets of a key that meet in a task at most, from each of two blocks.
BLOCK = 512
_A = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
_XOR, _TIMES = (_rng.integers(0, 2**32, ROWS * BANDS, np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def shingles(text: str | None, words: Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words.

    A-Z are lower-cased and words end at ASCII white space; fewer words give one shingle of all of
    them, none give an empty set.
    """
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    size = min(size, len(got))
    w = np.fromiter(map(words.__getitem__, got), np.uint64, len(got))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + n]) * _A
        h ^= h >> np.uint64(32)
    return np.unique(h)


def bands(sets: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; none for an empty set."""
    if not len(sets):
        return np.zeros(0, np.int64)
    short = sets.astype(np.uint32)[:, None]
    low = np.full(ROWS * BANDS, 2**32 - 1, np.uint32)
    for k in range(0, len(sets), CHUNK):
        x = short[k : k + CHUNK] ^ _XOR
        x *= _TIMES
        np.minimum(low, x.min(0), out=low)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(ROWS, BANDS).astype(np.uint64):
        h = (h ^ row) * _A
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), 0)


def signatures(docs: DataFrame) -> DataFrame:
    """``(id, set, n, fp, bands)`` for each ``(id, text)``: a hash of the shingle set, its size, fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in (s for whole in batches for s in slices(whole, 1)):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            name = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            keys = [bands(s) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name), n, pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], names=["id", "set", "n", "fp", "bands"])
        words.clear()
        give_back()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, set long, n int, fp long, bands array<long>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """``(set, members)`` for each ``(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in (s for whole in batches for s in slices(whole, 1)):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            name = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
            members = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(name), members], names=["set", "members"])
        words.clear()
        give_back()

    return docs.mapInArrow(run, "set long, members array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the similarity."""
    left = sets.select(F.col("set").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("set").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return pairs.join(left, "a").join(right, "b").where(both * OF >= either * SIMILAR).select("a", "b")


def _open_pairs(left: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``(a, b)`` of different clusters within a key that reach the similarity by half of each hash.

    Halves can only agree more often than wholes, so no pair is missed.  A key of over ``block`` sets
    is cut into blocks by hash, and every two blocks meet in a task of their own; only similar pairs leave it.
    """
    short = sets.select("set", F.transform("members", lambda m: F.shiftright(m, 32).cast("int")).alias("members"))
    crowded = left.groupBy("key").count().where(F.col("count") > block)
    crowded = crowded.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cut = left.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "set", "cluster", "n").join(short, "set")
    order = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close():
            t = pa.Table.from_batches(held)
            a, b = similar_across(t["own"].to_numpy(), t["cluster"].to_numpy(), t["members"].combine_chunks(), last[1] < last[2])
            ids = t["set"].to_numpy()
            a, b = ids[a], ids[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                name = tuple(int(x[lo]) for x in at)
                if held and name != last:
                    yield close()
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = name
        if held:
            yield close()
        held = []
        give_back()

    dealt = cut.select(*order, "own", "set", "cluster", "members").repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_across(own: np.ndarray, cluster: np.ndarray, members: pa.Array, two_blocks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of different clusters (and blocks, if there are two) whose sets reach the similarity.

    Of two clusters one is not the largest, so only the rows of the others are compared with all.
    """
    names, of, count = np.unique(cluster, return_inverse=True, return_counts=True)
    none = np.zeros(0, np.int64)
    if len(names) < 2:
        return none, none
    most = int(np.argmax(count))
    _, code = np.unique(members.flatten().to_numpy(), return_inverse=True)
    ends = members.offsets.to_numpy() - members.offsets[0].as_py()
    n = np.diff(ends)
    mark = np.zeros(int(code.max()) + 1, bool)
    left, right = [none], [none]
    rows = np.arange(len(of))
    for i in np.flatnonzero(of != most).tolist():
        open_ = (of != of[i]) & ((of == most) | (rows > i)) & (n * OF >= n[i] * SIMILAR) & (n[i] * OF >= n * SIMILAR)
        if two_blocks:
            open_ &= own != own[i]
        if not open_.any():
            continue
        mine = code[ends[i] : ends[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[code], ends[:-1], dtype=np.int64)
        mark[mine] = False
        near = np.flatnonzero(open_ & (both * OF >= (n + n[i] - both) * SIMILAR))
        left.append(np.full(len(near), i))
        right.append(near)
    return np.concatenate(left), np.concatenate(right)


def _stars(grouped: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of the sets of a group and its two pivots."""
    pairs = grouped.select("set", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("p")).where(F.col("set") != F.col("p"))
    return pairs.select(F.least("set", "p").alias("a"), F.greatest("set", "p").alias("b"))


def _pivots() -> list:
    return [F.count("*").alias("size"), F.max(F.struct("copies", "set"))["set"].alias("p1"), F.min("set").alias("p2")]


def _fingerprint_groups(distinct: DataFrame) -> DataFrame:
    """``(set, p1, p2)`` for the sets whose fingerprints SimHash links to those of others: the pivots of the group."""
    fps = materialize(distinct.groupBy("fp").agg(F.sum("copies").alias("n")))
    of = materialize(distinct.select("set", "fp", "copies").join(link_components(fps), "fp").select("root", "set", "copies"))
    pivots = of.groupBy("root").agg(*_pivots()).where("size > 1")
    return of.join(pivots, "root").select("set", "p1", "p2")


def _link(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """``(set, root)`` for every set that SimHash links to another one or that shares a band with one.

    First each group of fingerprints and each band key links its members to two pivots, which joins dense groups;
    then sets of different clusters within a key are compared, all of them, block by block.
    """
    near = materialize(_stars(_fingerprint_groups(distinct)).distinct())
    keyed = distinct.select("set", "n", "copies", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(*_pivots())
    shared = materialize(keyed.join(pivots.where("size > 1"), "key").select("key", "set", "n", "p1", "p2"))
    both = near.select(F.explode(F.array("a", "b")).alias("set"))
    nodes = materialize(shared.select("set").unionByName(both).distinct())
    chosen = distinct.join(nodes, "set", "left_semi").select(F.col("least").alias("chosen")).distinct()
    read = whole_sets(texts.join(chosen, F.col("id").eqNullSafe(F.col("chosen")), "left_semi"))
    sets = materialize(read.join(nodes, "set", "left_semi").dropDuplicates(["set"]))
    stars = materialize(near.unionByName(_stars(shared)).distinct())
    first = connected_components(_similar(stars, sets))
    clusters = materialize(
        nodes.join(first, F.col("set") == F.col("node"), "left").select("set", F.coalesce("component", "set").alias("cluster"))
    )
    placed = materialize(shared.select("key", "set", "n").join(clusters, "set"))
    mixed = placed.groupBy("key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi").select("key")
    left = materialize(placed.join(mixed, "key", "left_semi"))
    found = _similar(_open_pairs(left, sets), sets)
    ca = clusters.select(F.col("set").alias("a"), F.col("cluster").alias("ca"))
    cb = clusters.select(F.col("set").alias("b"), F.col("cluster").alias("cb"))
    second = connected_components(found.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return clusters.join(second, F.col("cluster") == F.col("node"), "left").select("set", F.coalesce("component", "cluster").alias("root"))


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, component_id)`` for every row."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hashed = texts.select(F.struct("id", F.xxhash64("text").alias("text_hash")).alias("id"), "text")
    marks = materialize(signatures(hashed).select("id.id", "id.text_hash", "set", "n", "fp", "bands"))
    distinct = materialize(
        marks.groupBy("set").agg(
            F.count("*").alias("copies"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
        )
    )
    roots = materialize(_link(distinct, texts))
    named = distinct.select("set", "least").join(roots, "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(names, "root").select("set", "component_id")
    return marks.select("id", "text_hash", "set").join(of, "set").select("id", "text_hash", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, component_id)`` for every row: the smallest id reachable by links of the similarity.

    Texts of equal sets are linked, wordless and null ones among themselves; a null id takes part
    but names no component (null if a group has no other).
    """
    return _components(docs, id_col, text_col).select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: the smallest id, of several texts of that id the one of the smallest hash.

    Rows are told apart by id and text: a text that resembles nothing stays whatever else its id holds,
    of rows that repeat both one stays.  Rows with a null id stay.
    """
    found = materialize(_components(docs, id_col, text_col).where("id is not null"))
    own = found.where("id = component_id").groupBy("component_id", "text_hash").agg(F.count("*").alias("n"))
    first = own.groupBy("component_id").agg(F.min(F.struct("text_hash", "n")).alias("first"))
    kept = first.select(F.col("component_id").alias("__id"), F.col("first.text_hash").alias("__hash"), F.col("first.n").alias("__n"))
    gone = (
        found.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "component_id").distinct()
        .join(first, "component_id")
        .where((F.col("__id") != F.col("component_id")) | (F.col("__hash") != F.col("first.text_hash")))
        .select("__id", "__hash")
    )
    same = (F.col(f"`{id_col}`") == F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__hash"))
    left = docs.join(gone, same, "left_anti")
    twice = kept.where("__n > 1").select("__id", "__hash")
    if twice.isEmpty():
        return left
    again = left.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(twice, same, "left_anti").unionByName(again)
