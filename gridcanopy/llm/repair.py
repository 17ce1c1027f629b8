"""Token files under Re-Pair grammars: frequent pairs of ids become nonterminals, block by block."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_root
from .tokens import word_encoder

END_ID = 1
#: Ids after which a block is closed (a longer document makes a longer block).
BLOCK_IDS = 1 << 20
#: Places from which a pair gets a rule (12 bytes, two saved a place); nonterminals over a vocabulary of 2^16 ids or more.
MIN_COUNT, EXTRA_SYMBOLS = 16, 1 << 14
_SLOT_BITS = 20
MAGIC = b"RPG1"
SCHEMA = "part int, block int, n_ids long, doc_ids array<{id}>, lengths array<int>, grammar binary"


def compress(ids: np.ndarray, min_count: int = MIN_COUNT, max_symbols: int | None = None) -> bytes:
    """A block: ``RPG1``, first nonterminal, counts, rules (pairs), expansion lengths, sequence.

    Each round replaces the pairs that occur at least ``min_count`` times by nonterminals, most
    frequent first while symbols are left, without overlaps from left to right; a pair left with fewer
    than two places gets no rule.  Rounds go on until no pair is that frequent or ``max_symbols``
    symbols are in use (default: as many as two bytes hold, or EXTRA_SYMBOLS over a larger vocabulary).
    After the first round only pairs with one of the last round's symbols can have become frequent.
    """
    x = ids.astype(np.uint32)
    base = max(int(x.max()) + 1 if len(x) else 1, 1)
    limit = max_symbols or (1 << 16 if base < 1 << 16 else base + EXTRA_SYMBOLS)
    rules: list[np.ndarray] = []
    size = np.ones(base, np.uint32)
    symbols, last = base, 0
    while len(x) >= 2 * min_count and symbols < limit:
        young = x >= last
        at = _often(x, np.flatnonzero(young[:-1] | young[1:]) if last else None, min_count)
        if len(at) < min_count:
            break
        pairs, which, count = _pairs(x, at, symbols)
        best = np.flatnonzero(count >= min_count)
        best = best[np.argsort(-count[best], kind="stable")][: limit - symbols]
        chosen = np.zeros(len(pairs), bool)
        chosen[best] = True
        at, which = _apart(at, which, chosen[which])
        kept = np.bincount(which, minlength=len(pairs)) >= 2
        new = np.flatnonzero(kept)
        if not len(new):
            break
        ok = kept[which]
        at, which = at[ok], which[ok]
        number = np.zeros(len(pairs), np.uint32)
        number[new] = symbols + np.arange(len(new), dtype=np.uint32)
        left, right = (pairs[new] >> np.uint64(32)).astype(np.uint32), pairs[new].astype(np.uint32)
        rules.append(np.stack([left, right], 1))
        size = np.concatenate((size, size[left] + size[right]))
        last, symbols = symbols, symbols + len(new)
        x[at] = number[which]
        stay = np.ones(len(x), bool)
        stay[at + 1] = False
        x = x[stay]
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    width = 2 if symbols <= 1 << 16 else 4
    head = struct.pack("<4sIIIB", MAGIC, base, len(rule), len(x), width)
    return head + rule.astype("<u4").tobytes() + size[base:].astype("<u4").tobytes() + x.astype(f"<u{width}").tobytes()


def _often(x: np.ndarray, at: np.ndarray | None, least: int) -> np.ndarray:
    """Of the places (None: all) those whose pair may be as frequent, by counts of hashed pairs."""
    left, right = (x[:-1], x[1:]) if at is None else (x[at], x[at + 1])
    bits = min(_SLOT_BITS, max(10, int(len(left)).bit_length() + 1))
    slot = (left * np.uint32(2654435761) + right * np.uint32(2246822519)) >> np.uint32(32 - bits)
    ok = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least)[slot])
    return ok if at is None else at[ok]


def _pairs(x: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order (left one high), the number of each place's pair, and how often each occurs."""
    if symbols > 1 << 16:
        return np.unique(x[at].astype(np.uint64) << np.uint64(32) | x[at + 1], return_inverse=True, return_counts=True)
    # two symbols and the place fill a word: plain sorting is quicker than sorting places
    key = (x[at] << np.uint32(16) | x[at + 1]).astype(np.uint64) << np.uint64(32) | np.arange(len(at), dtype=np.uint64)
    key.sort()
    place, pair = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32)
    edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    count = np.diff(np.append(edge, len(pair)))
    which = np.empty(len(at), np.int64)
    which[place] = np.repeat(np.arange(len(edge)), count)
    pair = pair[edge].astype(np.uint64)
    return pair >> np.uint64(16) << np.uint64(32) | pair & np.uint64(0xFFFF), which, count


def _apart(at: np.ndarray, which: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places that overlap their left neighbour keep every other one, from the left of each run."""
    at, which = at[ok], which[ok]
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.diff(at) != 1
    place = np.arange(len(at), dtype=np.int32)
    even = (place - np.maximum.accumulate(place * fresh)) & 1 == 0
    return at[even], which[even]


def _parts(block: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    magic, base, n_rules, n, width = struct.unpack_from("<4sIIIB", block)
    if magic != MAGIC:
        raise ValueError("not a grammar block")
    at = struct.calcsize("<4sIIIB")
    rule = np.frombuffer(block, "<u4", 2 * n_rules, at).reshape(-1, 2)
    lengths = np.frombuffer(block, "<u4", n_rules, at + 8 * n_rules)
    return base, rule, lengths, np.frombuffer(block, f"<u{width}", n, at + 12 * n_rules).astype(np.uint32)


def _expand(x: np.ndarray, base: int, rule: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Replace nonterminals by what they stand for: rules are expanded once, as many passes as they are deep, then copied."""
    if not len(x) or not len(rule):
        return x
    used = np.zeros(len(rule), bool)
    inner = x >= base
    used[x[inner] - base] = True
    names = np.flatnonzero(used)
    pool, size = (names + base).astype(np.uint32), lengths[names].astype(np.int64)
    while len(pool) and (deep := pool >= base).any():
        to = np.cumsum(1 + deep) - 1 - deep
        out = np.empty(int(to[-1]) + 1 + int(deep[-1]), np.uint32)
        out[to[~deep]] = pool[~deep]
        pair = rule[pool[deep] - base]
        out[to[deep]], out[to[deep] + 1] = pair[:, 0], pair[:, 1]
        pool = out
    # terminals stand for themselves before the pool of expansions
    pool = np.concatenate((np.arange(base, dtype=np.uint32), pool))
    n, at = np.ones(base + len(rule), np.int64), np.arange(base + len(rule))
    n[base + names], at[base + names] = size, base + np.cumsum(size) - size
    n = n[x]
    ends = np.cumsum(n)
    place = np.repeat(at[x] - ends + n, n)
    place += np.arange(len(place))
    return pool[place]


def decompress(block: bytes) -> np.ndarray:
    """All ids of a block."""
    base, rule, lengths, x = _parts(block)
    return _expand(x, base, rule, lengths)


def read_ids(block: bytes, start: int, stop: int) -> np.ndarray:
    """The ids at ``start`` up to ``stop``, expanding only the symbols that cover them."""
    base, rule, lengths, x = _parts(block)
    ends = np.cumsum(np.where(x < base, 1, np.append(lengths, 1)[np.minimum(np.maximum(x, base) - base, len(lengths))]).astype(np.int64))
    first = int(np.searchsorted(ends, start, "right"))
    last = int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[first - 1]) if first else 0
    return _expand(x[first:last], base, rule, lengths)[start - before : stop - before]


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of all texts in ascending ``doc_id`` order as a table of grammar blocks.

    Whole texts are encoded and ``end_id`` is appended to each; a null text is empty, a null id sorts
    first, and rows that repeat an id follow one another by the hash of their texts.  Range partitions
    (``part``) hold consecutive blocks; the writer's commit makes retries and lost executors harmless.
    """
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    idt = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, block = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        names: list = []
        total, kind = 0, None

        def close() -> pa.RecordBatch:
            grammar = compress(np.frombuffer(b"".join(held), "<u4"))
            sizes = [len(r) // 4 for r in held]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([total], pa.int64()),
                    pa.array([names], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([grammar], pa.binary()),
                ],
                names=["part", "block", "n_ids", "doc_ids", "lengths", "grammar"],
            )

        for b in batches:
            kind = b.column(0).type
            for doc, raw in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                held.append(raw + end)
                names.append(doc)
                total += len(raw) // 4 + 1
                if total >= block_ids:
                    yield close()
                    held, names, total, block = [], [], 0, block + 1
        if held:
            yield close()

    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = text.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ordered.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=idt))
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, block, first)``: ids before each block.  One total per range partition meets at the driver."""
    sizes = spark.read.parquet(path).select("part", "block", "n_ids")
    before, at = [], 0
    for r in sorted(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        before.append((r["part"], at))
        at += r["n"]
    parts = spark.createDataFrame(before, "part int, before long")
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
    return inner.join(parts, "part").select("part", "block", (F.col("before") + F.col("inner")).alias("first"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the files: ``(doc_id, start, n_tokens, ids_crc32[, ids])`` per document."""
    blocks = spark.read.parquet(path)
    idt = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = decompress(b.column(4)[k].as_py()).astype("<u4").tobytes()
                sizes = b.column(3)[k].values.to_numpy() if b.column(3)[k].as_py() else np.zeros(0, np.int64)
                ends = np.cumsum(sizes.astype(np.int64))
                cut = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist())]
                n = len(cut)
                cols = [
                    pa.array([b.column(0)[k].as_py()] * n, pa.int32()), pa.array([b.column(1)[k].as_py()] * n, pa.int32()),
                    b.column(2)[k].values, pa.array(ends - sizes, pa.int64()), pa.array(sizes.astype(np.int64)),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                ]
                names = ["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(cut, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"part int, block int, doc_id {idt}, inner long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    docs = blocks.select("part", "block", "doc_ids", "lengths", "grammar").mapInArrow(run, schema)
    starts = block_starts(spark, path)
    tail = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), *tail)


def fetch(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """``(doc_id, ids)`` of the wanted documents: only the symbols that cover them are expanded.

    ``doc_ids`` is a list of the caller's; rows that repeat an id are all returned, unknown ids give none.
    """
    blocks = spark.read.parquet(path)
    idt = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, sizes, grammar in zip(*(b.column(k) for k in range(3))):
                ends = np.cumsum(np.array(sizes.as_py(), np.int64))
                at = [k for k, n in enumerate(names.as_py()) if n in wanted]
                raw = grammar.as_py()
                got = [read_ids(raw, int(ends[k - 1]) if k else 0, int(ends[k])).astype("<u4").tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([names.values.take(pa.array(at, pa.int64())), pa.array(got, pa.binary())], names=["doc_id", "ids"])

    some = blocks.where(F.arrays_overlap("doc_ids", F.lit(list(doc_ids)).cast(f"array<{idt}>"))) if doc_ids else blocks.limit(0)
    return some.select("doc_ids", "lengths", "grammar").mapInArrow(run, f"doc_id {idt}, ids binary")
