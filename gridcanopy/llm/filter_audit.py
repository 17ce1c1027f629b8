"""Audit of five filters under every order: what each removes, repeats and costs at every place.

A document's failures are five bits.  A table of 32 failure sets by 120 orders holds the step at which
each order first fails each set; counts of failure sets by part and label, run through it, are the
removals of all orders at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
_MARKS = re.compile(rb"[#$%&*|]")
_UPPER = re.compile(rb"[^A-Z]+")
#: Parts whose counts a task holds before it hands them on; what is handed on twice is summed.
HELD_PARTS = 4096


def first_failures() -> np.ndarray:
    """``[failure set, order]``: the step, from 1, of the first filter of the order that is in the set; 0 if none is."""
    sets = np.arange(1 << len(LETTERS))[:, None, None]
    filters = np.array([[LETTERS.index(c) for c in order] for order in ORDERS])
    fails = (sets >> filters) & 1
    return np.where(fails.any(2), fails.argmax(2) + 1, 0)


def own_failures(text: bytes) -> int:
    """The bits of filters A to D for a whole text in UTF-8; words end at ASCII white space."""
    words = text.split()
    points = len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * len(_UPPER.sub(b"", text)) > MAX_UPPER_PERCENT * points) << 2
        | (_MARKS.search(text) is not None) << 3
    )


def features(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(id, part, mask, digest)`` of each document; equal texts have equal 128-bit digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            mask = pa.array([own_failures(t) for t in texts], pa.int32())
            digest = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), mask, digest], names=["id", "part", "mask", "digest"])

    none = F.lit("")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), none).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), none).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part string, mask int, digest binary")


def failure_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, mask, label)`` for each document: the set of filters it fails, and its labels.

    Bits of ``mask`` are the filters in order of letters, bits of ``label`` good and toxic.  The first id of
    each text is found by one aggregation, which combines before its shuffle, and met by id: texts with very
    many copies are never gathered.
    """
    own = materialize(features(docs, id_col, text_col, part_col))
    first = own.groupBy("digest").agg(F.min("id").alias("first_id")).where("first_id is not null")
    first = first.select(F.col("first_id").alias("id"), "digest", F.lit(True).alias("first"))
    bit = lambda name, value: F.max(F.when(F.col(f"`{name}`") == 1, value).otherwise(0))
    known = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id"))
    known = known.agg((bit("quality", 1) + bit("toxic", 2)).alias("label"))
    repeats = F.col("id").isNotNull() & F.col("first").isNull()
    return own.join(first, ["id", "digest"], "left").join(known, "id", "left").select(
        "part",
        F.when(repeats, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"),
        F.coalesce("label", F.lit(0)).alias("label"),
    )


def removals(sets: DataFrame) -> DataFrame:
    """``(part, filter_order, docs, removed1.., good1.., toxic1..)``: partial arrays of the tasks, summed."""
    steps = len(LETTERS)
    kinds = [f"{name}{k}" for name in ("removed", "good", "toxic") for k in range(1, steps + 1)]

    def table_rows(held: dict[str, np.ndarray], failures: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = (steps + 1) * len(ORDERS)
        at = (np.arange(len(ORDERS)) * (steps + 1) + failures).ravel()
        orders = pa.array(ORDERS)
        for part, counts in held.items():
            of = [counts.sum(0), counts[[1, 3]].sum(0), counts[[2, 3]].sum(0)]
            sums = [np.bincount(at, np.repeat(n, len(ORDERS)), size).reshape(-1, steps + 1).astype(np.int64) for n in of]
            docs = np.full(len(ORDERS), counts.sum())
            columns = [pa.array(s[:, k]) for s in sums for k in range(1, steps + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ORDERS)), orders, pa.array(docs), *columns], names=["part", "filter_order", "docs", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failures = first_failures()
        held: dict[str, np.ndarray] = {}
        for b in batches:
            part = b.column(0).dictionary_encode()
            code = part.indices.to_numpy().astype(np.int64) * 128 + b.column(2).to_numpy() * 32 + b.column(1).to_numpy()
            names = part.dictionary.to_pylist()
            for name, n in zip(names, np.bincount(code, minlength=128 * len(names)).reshape(-1, 4, 32)):
                held[name] = held.get(name, 0) + n
            if len(held) >= HELD_PARTS:
                yield from table_rows(held, failures)
                held = {}
        yield from table_rows(held, failures)

    schema = "part string, filter_order string, docs long, " + ", ".join(f"{k} long" for k in kinds)
    partial = sets.mapInArrow(run, schema)
    return partial.groupBy("part", "filter_order").agg(*[F.sum(c).alias(c) for c in ["docs", *kinds]])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    Filters: A under 200 words; B distinct words under half of all; C over 2 % upper-case A-Z; D holds one of
    ``#$%&*|``; E equal to the text of a smaller id.  Columns: ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``.  A filter's failures are what it removes at
    step 1 of any order, and what only it fails is what it removes at step 5.

    Defined cases: a null text is empty, a null part the empty string.  A row without id never fails E and
    makes no other row fail it; rows of one id never make each other fail.  Rows count as often as they are
    repeated.  An id with several label rows has a label if any of them does; labels without id count for
    nothing.  Other columns, whatever their names, are not read.  An empty table gives no rows.
    """
    sums = removals(failure_sets(docs, labels, id_col, text_col, part_col))
    gone = F.lit(0)
    each = []
    for k in range(1, len(LETTERS) + 1):
        gone = gone + F.col(f"removed{k}")
        each.append(F.struct(
            F.lit(k).alias("step"), F.substring("filter_order", k, 1).alias("filter"), (F.col("docs") - gone).alias("kept"),
            F.col(f"removed{k}").alias("removed"), F.col(f"good{k}").alias("good_lost"), F.col(f"toxic{k}").alias("toxic_lost"),
        ))
    rows = sums.select("part", "filter_order", F.explode(F.array(*each)).alias("r")).select("part", "filter_order", "r.*")
    same = Window.partitionBy("part", "filter")  # 120 rows each
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("removed"))).over(same)
    earlier = at(1) - F.col("removed")
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", earlier.alias("redundant"), at(len(LETTERS)).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(same).alias("shapley"),
    )
