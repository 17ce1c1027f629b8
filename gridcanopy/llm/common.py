"""Shared pieces: tables, connected components, disjoint spans, columns by name."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import materialize, release, shared_root  # noqa: F401 - for the operators here

#: Bytes of texts that a worker takes up at a time (a longer text by itself).
SLICE_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_at(docs: DataFrame, name: str) -> int:
    """The place of a column: spelt so, else the one that differs in case alone, as Spark resolves names."""
    if name in docs.columns:
        return docs.columns.index(name)
    return [c.lower() for c in docs.columns].index(name.lower())


class Spans:
    """Disjoint spans in order; one that overlaps another is not taken."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, start)
        if k < len(self.starts) and self.starts[k] < end or k and self.ends[k - 1] > start:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def give_back() -> None:
    """Hand memory that is free again to the system: workers serve one stage after another, and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in order, in slices of about ``most`` bytes of the text in column ``at``; nothing for no rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge list ``(a, b)``.

    Alternating large-star and small-star steps; each is one partial aggregation (the smallest
    neighbour) and one join on the node, so a node with very many neighbours never sits in one
    group.  Returns ``(node, component)``; nodes without edges do not appear; nulls and self
    links are ignored.  Each step is written to the shared folder.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    cur = materialize(e.distinct())
    mark = _mark(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        nxt = materialize(_small_star(_large_star(cur)))
        release(cur)
        cur, old, mark = nxt, mark, _mark(nxt)
        if old == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)).alias("s"),
    ).first()
    return r["n"], r["x"], r["s"]


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    m = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(m, "u")
        .where("v > u")
        .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (``a > b`` in every edge)."""
    m = e.groupBy("a").agg(F.min("b").alias("m"))
    return (
        e.join(m, "a")
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .where("a <> b")
        .distinct()
    )
