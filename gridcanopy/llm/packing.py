"""Hierarchical residual packing of token sequences into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, release, slices
from .tokens import forget_words, word_encoder

LENGTH = 2048
END_ID = 0
#: Items that one task packs, and how full a bin must be to leave the rounds.
GROUP_ITEMS, NEARLY_FULL = 60_000, 0.998
PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = True, forget: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: whole texts encoded, ended, cut at ``length``.

    Only documents of more than ``length`` ids (the end id counts) are cut; the last piece may be
    shorter.  A null text is empty and gives one piece, the end id.  ``ids`` holds little-endian
    unsigned 32-bit ids.  ``forget``: a task drops the words that it has learnt, for workers that other work follows on.
    """
    idt = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in (s for whole in batches for s in slices(whole, 1)):
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            cols = list(zip(*rows)) or [()] * (6 if with_ids else 5)
            kinds = [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names[: len(cols)])
        if forget:
            del encoder
            forget_words(tokenizer)
        give_back()

    schema = PIECE.format(id=idt) + (", ids binary" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the place in it of each size, in time of sizes x log capacity.

    Bins are kept by room left; the tightest room that fits is found in a bitmap of rooms.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_rooms >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[k], places[k] = b, capacity - room
        rest = room - size
        if rest:
            if not by_room[rest]:
                open_rooms |= 1 << rest
            by_room[rest].append(b)
    return bins, places


def _round(items: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Pack each of ``groups`` groups of ``(item, size)``: ``(item, size, bin, place, fill)``.

    A bin's number holds its level and group, so numbers differ across rounds and tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("size", "descending"), ("item", "ascending")])
        for g in sorted(set(t["grp"].to_pylist())):
            own = t.filter(pc.equal(t["grp"], g))
            size = own["size"].to_numpy()
            b, place = best_fit(size, capacity)
            fill = np.bincount(b, size).astype(np.int64)
            number = (np.int64(level) << 58) | (np.int64(g) << 28) | b
            out = pa.table({"item": own["item"], "size": own["size"], "bin": number, "place": place, "fill": fill[b]})
            yield from out.to_batches(max_chunksize=20_000)

    grouped = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
    spread = grouped.repartition(groups, "grp") if groups > 1 else grouped.coalesce(1)
    return spread.select("item", "size", "grp").mapInArrow(run, "item long, size long, bin long, place long, fill long")


def pack(items: DataFrame, capacity: int = LENGTH, group_items: int = GROUP_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``(item, sequence_id, offset)`` for items ``(item long, size long)`` of at most ``capacity``.

    Groups of about ``group_items`` are packed best-fit; bins filled to ``nearly_full`` are done and
    the others go on as items of their own into fewer groups, until one group is left or a round
    merges nothing.  A task never holds more than its group.
    """
    assigned = None
    n = items.count()
    todo, level = items, 0
    while True:
        groups = max(1, -(-n // group_items))
        packed = materialize(_round(todo, groups, level, capacity))
        bins = packed.groupBy("bin").agg(F.first("fill").alias("size"), F.count("*").alias("parts"))
        stay = packed.select("item", F.col("bin").alias("top"), F.col("place").alias("off"))
        if assigned is None:
            assigned = stay.select("item", "top", "off")
        else:
            up = stay.select(F.col("item").alias("top"), F.col("top").alias("new"), F.col("off").alias("shift"))
            assigned = assigned.join(up, "top", "left").select(
                "item", F.coalesce("new", "top").alias("top"), (F.col("off") + F.coalesce("shift", F.lit(0))).alias("off")
            )
        under = bins.where(F.col("size") < nearly_full * capacity).select(F.col("bin").alias("item"), "size")
        left = under.count() if groups > 1 else 0
        level += 1
        if groups == 1 or left < 2 or (level > 1 and left >= 0.99 * n) or level > 20:
            break
        n, todo = left, under
    return assigned.select("item", F.col("top").alias("sequence_id"), F.col("off").alias("offset"))


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, forget: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    The pieces, without their ids, are written once and numbered by position in that table; whole
    pieces of ``length`` are sequences of their own.  Rows that repeat a doc_id are packed each.
    """
    made = materialize(pieces(docs, length, tokenizer=tokenizer, with_ids=False, forget=forget))
    numbered = materialize(made.withColumn("item", F.monotonically_increasing_id()))
    release(made)
    rest = numbered.where(F.col("length") < length).select("item", F.col("length").alias("size"))
    placed = pack(rest, length)
    whole = F.bitwise_not(F.col("item"))  # negative, so unlike any packed bin
    return (
        numbered.join(placed, "item", "left")
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.coalesce("sequence_id", whole).alias("sequence_id"),
            F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
        )
    )
