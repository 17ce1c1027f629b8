"""SimHash near-duplicates by the generalised pigeonhole principle.

64 bits are grouped into parts of correlated bits.  Two fingerprints within ``tau`` bits agree to
within ``t_i`` bits in at least one part ``i`` whenever ``sum(t_i + 1) = tau + 1``, so each
fingerprint probes, part by part, the values within ``t_i`` flips of its own; parts with
``t_i = -1`` are not probed.  The thresholds come from a dynamic program on estimated costs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

BITS = 64
TAU = 4
SHINGLE = 4
#: Fingerprints that cost estimates look at; results do not depend on them.
SAMPLE = 1024
#: Relative cost of moving one probe and of comparing one candidate pair.
PROBE_COST, PAIR_COST = 1.0, 0.02
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the XXH64 (seed 42) bits over all shingles of ``size`` words, repeats included.

    A-Z are lower-cased and words end at ASCII white space; fewer words give one shingle of all of
    them, none give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, z = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(a[k : k + CHUNK], z[k : k + CHUNK])], "<u8")
        ones += _bits(h).sum(0, dtype=np.int64)
    return _majority(ones, n)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits set in over half of them; 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += _bits(hashes[k : k + CHUNK]).sum(0, dtype=np.int64)
    return _majority(ones, len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long; one row per input row."""
    idt = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {idt}, fp long")


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of the 64 bits over all fingerprints (64 x 64 sums, whatever the input)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            m = _bits(x).astype(np.float32)
            both += m.T @ m
            n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both.ravel(), n).astype(np.int64))],
            names=["i", "j", "n"],
        )

    rows = fps.select("fp").mapInArrow(sums, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    got = {(r["i"], r["j"]): r["n"] for r in rows}
    n = max(1, got.get((-1, -1), 0))
    e = np.array([[got.get((i, j), 0) for j in range(BITS)] for i in range(BITS)]) / n
    p = np.diag(e)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((e - np.outer(p, p)) / np.outer(sd, sd))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Grow ``parts`` groups of near-equal size, each time by the bit most correlated with the group."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        first = max(left, key=lambda b: (sum(corr[b][c] for c in left if c != b), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            b = max(left, key=lambda b: (sum(corr[b][c] for c in group), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def flips(bits: list[int], t: int) -> list[int]:
    """All masks of at most ``t`` of the bits, as signed longs."""
    masks = (sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(bits, k))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def allocate(cost: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds with ``sum(t_i + 1) = tau + 1`` of the least total cost; ``cost[i][t]`` for t >= 0."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, min(len(row), tau + 1 - used)):
                total = c + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in nxt or total < nxt[used + t + 1][0]:
                    nxt[used + t + 1] = (total, [*ts, t])
        best = nxt
    return best.get(tau + 1, (float("inf"), []))


def plan(corr: np.ndarray, sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The cheapest ``[(bits, threshold)]`` among 2 to ``tau`` parts for ``n`` fingerprints."""
    x = sample.view(np.uint64)
    a, b = np.triu_indices(len(x), 1)
    xor = x[a] ^ x[b]
    p = _bits(sample).mean(0) if len(x) else np.full(BITS, 0.5)
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(2, max(2, tau) + 1):
        groups = group_bits(corr, parts)
        cost = []
        for bits in groups:
            mask = np.uint64(sum(1 << i for i in bits))
            apart = np.bincount(np.bitwise_count(xor & mask), minlength=BITS + 1) / max(1, len(xor))
            alone = np.array([1.0])  # distance of two fingerprints if bits were independent
            for i in bits:
                q = 2 * p[i] * (1 - p[i])
                alone = np.convolve(alone, [1 - q, q])
            row, probes = [], 0.0
            for t in range(min(3, len(bits), tau + 1)):
                probes = sum(1 for _ in flips(bits, t))
                share = max(apart[: t + 1].sum(), alone[: t + 1].sum())
                row.append(n * (1 + (probes - 1) / 2) * PROBE_COST + share * n * n / 2 * PAIR_COST)
            cost.append(row)
        total, ts = allocate(cost, tau)
        if total < best[0]:
            best = (total, list(zip(groups, ts)))
    return best[1]


def link_components(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """``(fp, root)`` for distinct fingerprints ``(fp, n)``: the smallest one reachable by links.

    First every bucket links its members to a few pivots (one aggregation, no pairs), which joins
    dense groups; the exact probe then reports links between different clusters only, so a group
    of near copies never lists its pairs.
    """
    n = fps.count()
    if n < 2:
        return fps.select("fp", F.col("fp").alias("root"))
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()], np.int64)
    layout = plan(bit_correlation(fps), sample, n, tau)
    masks = [sum(1 << b for b in bits) for bits, _ in layout]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    used = [k for k, (_, t) in enumerate(layout) if t >= 0]

    def index(df: DataFrame) -> DataFrame:
        keys = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(signed[k])).alias("key")) for k in used]
        return df.select("*", F.explode(F.array(*keys)).alias("k")).select(*df.columns, "k.part", "k.key")

    def near(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau

    buckets = index(fps)
    pivots = (
        buckets.groupBy("part", "key")
        .agg(
            F.count("*").alias("size"),
            F.max(F.struct("n", "fp"))["fp"].alias("p1"),
            F.min("fp").alias("p2"),
            F.max(F.struct(F.xxhash64("fp"), "fp"))["fp"].alias("p3"),
        )
        .where("size > 1")
    )
    stars = (
        buckets.join(pivots, ["part", "key"])
        .select("fp", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("p"))
        .where((F.col("fp") != F.col("p")) & near("fp", "p"))
        .select(F.col("fp").alias("a"), F.col("p").alias("b"))
    )
    first = connected_components(stars)
    clustered = materialize(
        fps.select("fp")
        .join(first, fps["fp"] == first["node"], "left")
        .select("fp", F.coalesce("component", "fp").alias("cluster"))
    )
    probes = None
    for k in used:
        masked = F.col("fp").bitwiseAND(F.lit(signed[k]))
        flipped = F.array(*[F.lit(m) for m in flips(layout[k][0], layout[k][1])])
        own = (
            clustered.select("fp", "cluster", masked.alias("own"), F.explode(flipped).alias("flip"))
            .select("fp", "cluster", F.lit(k).alias("part"), F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "own")
            .where("key >= own")  # each pair is found from its smaller value
            .drop("own")
        )
        probes = own if probes is None else probes.unionByName(own)
    a, b = probes.alias("a"), index(clustered).alias("b")
    links = (
        a.join(
            b,
            (F.col("a.part") == F.col("b.part"))
            & (F.col("a.key") == F.col("b.key"))
            & (F.col("a.cluster") != F.col("b.cluster"))
            & near("a.fp", "b.fp"),
        )
        .select(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b"))
        .distinct()
    )
    second = connected_components(links)
    return clustered.join(second, clustered["cluster"] == second["node"], "left").select(
        "fp", F.coalesce("component", "cluster").alias("root")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id reachable by links of ``tau`` bits.

    Rows of equal fingerprints are linked.  Null and wordless texts have fingerprint 0 and link
    like any other; a null id takes part but names no component (null if a group has no other).
    """
    fps = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    roots = materialize(link_components(distinct.select("fp", "n"), tau))
    named = distinct.join(roots, "fp")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "fp").select(
        "id", "fp", "component_id"
    )
