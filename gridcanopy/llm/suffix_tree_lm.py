"""A probabilistic suffix tree over words, learnt and applied by contexts.

A context is the last one to DEPTH words before a token (``START`` fills up before a text).  It is a
state of the tree if the distribution of its next words diverges from that of its longest suffix
that is a state: leaving each of its occurrences out in turn, it has to code the next word in
MIN_GAIN nats less, over all of its occurrences.  A token is scored by the longest suffix that is a
state, smoothed towards its own longest suffix and so on down to the word frequencies:

    P(w | s) = max(c(s, w) - d, 0) / c(s) + d distinct(s) / c(s) P(w | suffix(s))

Every token is one row of four word codes and its text, dealt by the word before it: all contexts
that end in a word meet in one bucket of some BUCKET_TOKENS rows, where they are counted, tested and
applied.  A word that would fill a quarter of a bucket or more is dealt by the class of the words before it
(a hash of the next, of two if those two together are as frequent, and so on), so many classes that each takes about
that much.  Which sequences are so frequent is told from places spread over all texts; it decides where rows go and nothing else.
Contexts whose rows so lie in several buckets are few, a few a bucket; they are counted and tested beforehand
by sums over all rows, and each bucket is told the probabilities that it needs: what is a state does
not depend on buckets.  Rows travel as packed arrays, so the shuffle moves a few large rows.  Only the counts of the CACHED
most frequent words are broadcast; a bucket is told those of the other words that it holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, release, slices
from .toxicity import held_out

DEPTH = 3
DISCOUNT, MIN_GAIN = 0.5, 3.0
CACHED = 1 << 19
BUCKET_TOKENS = 1 << 20
#: Tokens that a task counts or deals at a time (a longer text is one step of its own).
CHUNK = 1 << 20
CACHE_WORDS = 400_000
#: A sequence that is dealt in classes is seen so often, about, at the places looked at.
SAMPLED = 512
END = xxhash.xxh64_intdigest(b" ", 0)  # no word holds a blank
START = 0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.int64(0xFFFFFFFF)
_DEALT = ("bucket", "step", "row", "n", "known", "base", "id", "blob")
#: Of packed rows: the words before, the word, how many texts of its step on, whether it is learnt from; hashes of words that are not cached.
_PACKED = ["<i4"] * (DEPTH + 1) + ["<u4", "u1", "<u8"]
#: Of packed sums: how many texts of its step on; score, base and known ones of the words that are not cached.
_SUMS = ["<u4", "<u8", "<u8", "<u4"]
#: Sums of logarithms travel as whole numbers of this unit, so that they pack and their order does not matter.
_UNIT = 2.0**-36
#: Of packed questions: bucket, words before, word (NONE if it is not cached), times seen; hashes of words that are not cached.
_ASKED = ["<u2", *["<i4"] * DEPTH, "<i4", "<u4", "<u8"]
#: The frequent words before a token, the nearest first.
_CONTEXT = [f"c{k}" for k in range(1, DEPTH + 1)]
NONE = -1


class Words(dict):
    """Word -> 64-bit hash, with bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h


def chunks(texts: list[str | None], words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, tokens, tokens of each text)``: hashes of words and ends of whole texts, about CHUNK at a time."""
    parts, first, total = [], 0, 0
    for d, text in enumerate(texts):
        got = (text or "").encode("utf-8", "surrogatepass").lower().split()
        t = np.empty(len(got) + 1, np.uint64)
        t[:-1] = np.fromiter(map(words.__getitem__, got), np.uint64, len(got))
        t[-1] = END
        parts.append(t)
        total += len(t)
        if total >= CHUNK:
            yield first, np.concatenate(parts), np.array([len(p) for p in parts])
            parts, first, total = [], d + 1, 0
    if parts:
        yield first, np.concatenate(parts), np.array([len(p) for p in parts])


def _mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    h = (a.astype(np.uint64) + np.asarray(b).astype(np.uint64) * _B) * _A
    h ^= h >> np.uint64(31)
    h *= _B
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """The most frequent words by hash, their counts, and the classes that frequent ones are dealt in."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n: int, v: int, bucket: int = BUCKET_TOKENS, heavy: list[np.ndarray] | None = None):
        self.heavy = heavy  # sorted names of the frequent sequences of two words, of three; None: all those of frequent words
        order = np.argsort(-counts, kind="stable")  # small numbers for frequent words pack well
        self.keys, self.counts, self.n, self.v = keys[order], counts[order], n, v
        ends = counts[keys == np.uint64(END)]
        # by code: START stands once before each text, then the words
        times = np.concatenate(([ends[0] if len(ends) else 0], self.counts))
        self.classes = np.maximum(1, -(-times // max(1, bucket // 4))).astype(np.int32)
        self._index()

    def _index(self) -> None:
        """A table by the top of the hash; a word whose place another has taken is found by bisection."""
        bits = max(1, int(len(self.keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.place = np.full(1 << bits, -1, np.int32)
        at = (self.keys >> self.shift).astype(np.int64)
        self.place[at[::-1]] = np.arange(len(at), dtype=np.int32)[::-1]  # the most frequent of a place stays
        others = np.flatnonzero(self.place[at] != np.arange(len(at)))
        self.others = others[np.argsort(self.keys[others])]
        self.other_keys = self.keys[self.others]
        self.z = self.n + 0.5 * (self.v + 1)
        self.log_root = np.log10((self.counts + 0.5) / self.z)

    def __getstate__(self):
        return self.keys, self.counts, self.n, self.v, self.classes, self.heavy

    def __setstate__(self, state):
        self.keys, self.counts, self.n, self.v, self.classes, self.heavy = state
        self._index()

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """The rank of each token's word, -1 where it is not among these."""
        if not len(self.keys):
            return np.full(len(tokens), -1, np.int32)
        out = self.place[(tokens >> self.shift).astype(np.int64)]
        out[self.keys[out] != tokens] = -1  # an empty place reads the last key
        if len(self.others):
            miss = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(self.other_keys, tokens[miss]), len(self.others) - 1)
            hit = self.other_keys[at] == tokens[miss]
            out[miss[hit]] = self.others[at[hit]]
        return out

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Words found are numbered from 1, others are negative by 31 bits of their hash."""
        found = self.find(tokens)
        return np.where(found >= 0, found + 1, ~(tokens >> np.uint64(33)).astype(np.int32)).astype(np.int32)

    def frequent(self, code: np.ndarray) -> np.ndarray:
        """The number of classes of each code's word."""
        return np.where(code >= 0, self.classes[np.maximum(code, 0)], 1)

    def names(self, code: np.ndarray) -> np.ndarray:
        """The hashes of words that are cached, START of START."""
        out = np.zeros(len(code), np.uint64)
        word = code > 0
        out[word] = self.keys[code[word] - 1]
        return out

    def is_heavy(self, name: np.ndarray, length: int) -> np.ndarray:
        known = self.heavy[length - 2]
        if not len(known):
            return np.zeros(len(name), bool)
        return known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name


def count_words(texts: DataFrame, every: int) -> DataFrame:
    """``(length, key, n)`` of ``(text, train)``, combined before the shuffle: the tokens learnt from, by hash, and
    at one place of ``every`` in all texts the two, the three words before it, by :func:`longer`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, total, seed = Words(), [[] for _ in range(DEPTH)], 0, TaskContext.get().partitionId() << 40

        def out():
            found = [np.unique(np.concatenate(p), return_counts=True) for p in parts]
            kind = np.repeat(np.arange(1, DEPTH + 1, dtype=np.int32), [len(k) for k, _ in found])
            k, n = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(k.view(np.int64)), pa.array(n)], names=["length", "key", "n"])

        for b in (s for whole in batches for s in slices(whole, 0)):
            learn = b.column(1).to_numpy(zero_copy_only=False)
            for first, t, sizes in chunks(b.column(0).to_pylist(), words):
                own = learn[first : first + len(sizes)]
                parts[0].append(t if own.all() else t[np.repeat(own, sizes)])
                at = np.flatnonzero(_mix(np.arange(seed, seed + len(t))) % np.uint64(every) == 0)
                begin = np.cumsum(sizes) - sizes
                place = at - begin[np.searchsorted(begin, at, "right") - 1]
                name = None
                for k in range(1, DEPTH + 1):
                    word = np.where(place >= k, t[np.maximum(at - k, 0)], np.uint64(START))
                    name = word if name is None else longer(name, word)
                    if k > 1:
                        parts[k - 1].append(name)
                total, seed = total + len(t), seed + len(t)
                if total >= 4 * CHUNK:
                    yield out()
                    parts, total = [[] for _ in range(DEPTH)], 0
        if total:
            yield out()
        words.clear()
        give_back()

    return texts.mapInArrow(run, "length int, key long, n long").groupBy("length", "key").agg(F.sum("n").alias("n"))


def longer(name: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The name of a sequence with one more word before it."""
    return _mix(word, name)


def before(code: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each token the codes of the DEPTH tokens before it in its text, the nearest first."""
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for k in range(1, DEPTH + 1):
        c = np.full(len(code), START, np.int32)
        c[k:] = np.where(place[k:] >= k, code[:-k], START)
        out.append(c)
    return out


def dealt(vocabulary: Vocabulary, left: list[np.ndarray], rid: np.ndarray, buckets: int, deep: np.ndarray | None = None) -> np.ndarray:
    """The bucket of each row: by the nearest word, and the class of those before it if that is frequent."""
    deep = spread(vocabulary, left) if deep is None else deep
    h = _mix(left[0])
    at = np.flatnonzero(deep)
    if len(at):
        seed, own = np.zeros(len(at), np.uint64), deep[at]
        for length, c in enumerate(left[1:], 1):
            seed = np.where(own >= length, _mix(c[at], seed), seed)
        seed = np.where(own == DEPTH, _mix(rid[at], seed), seed)  # frequent throughout
        h[at] += seed % vocabulary.frequent(left[0][at]).astype(np.uint64)
    return (h % np.uint64(buckets)).astype(np.int64)


def parts_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What parts the rows of frequent words throughout: the word and its place, the same however texts are read."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _mix(tokens, place).view(np.int64)


def spread(vocabulary: Vocabulary, left: list[np.ndarray]) -> np.ndarray:
    """How many words before each token are a frequent sequence: contexts up to that length lie in several buckets."""
    out = np.zeros(len(left[0]), np.int8)
    at = np.flatnonzero(vocabulary.frequent(left[0]) > 1)
    out[at] = 1
    name = vocabulary.names(left[0][at])
    for length, c in enumerate(left[1:], 2):
        hit = vocabulary.frequent(c[at]) > 1
        at, name = at[hit], name[hit]
        if vocabulary.heavy is not None:
            name = longer(name, vocabulary.names(c[at]))
            hit = vocabulary.is_heavy(name, length)
            at, name = at[hit], name[hit]
        out[at] = length
    return out


def entry_key(context: list[np.ndarray], word: np.ndarray) -> np.ndarray:
    """A hash of each context (``NONE`` in unused places) and word."""
    h = word.astype(np.uint64)
    for c in context:
        h = _mix(c, h)
    return h


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays one after another, each by bytes of equal weight, deflated."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, kinds: list[str], sizes: list[int]) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind, n in zip(kinds, sizes):
        width = np.dtype(kind).itemsize
        flat = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.array(flat.T, order="C").reshape(-1).view(kind))  # a copy, of a single value too
        at += n * width
    return out


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of equal keys from 0 on, and how many there are."""
    if not len(key):
        return np.zeros(0, np.int32), 0
    order = np.argsort(key)
    key = key[order]
    ids = np.zeros(len(key), np.int32)
    np.cumsum(key[1:] != key[:-1], out=ids[1:], dtype=np.int32)
    del key
    out = np.empty(len(ids), np.int32)
    out[order] = ids
    return out, int(ids[-1]) + 1


def _key(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    key = group.astype(np.int64)
    key <<= 32
    key |= code.astype(np.int64) & _LOW
    return key


def apply_tree(left: list[np.ndarray], word: np.ndarray, train: np.ndarray, p: np.ndarray, min_gain: float = MIN_GAIN, deep: np.ndarray | None = None, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Count, test and apply the contexts of some rows: ``(probability, was seen in a state, states)``.

    ``p`` is the probability of each row's word by frequency alone, and is overwritten; rows with ``train``
    are counted.  Contexts up to a length of ``deep`` are applied already: ``p`` is that by the longest of
    them, and ``total`` how often it was seen.
    """
    seen, states = np.zeros(len(word), bool), 0
    at, group = np.arange(len(word), dtype=np.int32), np.zeros(len(word), np.int32)
    above = None
    for length, c in enumerate(left, 1):
        group, many = _dense(_key(group, c[at]))
        n = np.bincount(group, train[at], many)
        own_n = n[group]
        if deep is not None:
            own_n = np.where(deep[at] >= length, total[at], own_n)
        live = own_n >= 2
        at, group, own_n = at[live], group[live], own_n[live]
        if above is not None:
            above = above[live]
        if not len(at):
            break
        # a context that always stands in the same longer one tells nothing new
        test = np.ones(len(at), bool) if above is None else own_n < above
        if deep is not None:
            test &= deep[at] < length
        new = slice(None) if test.all() else np.flatnonzero(test)
        rows, own = at[new], group[new]
        if len(rows):
            entry, many_entries = _dense(_key(own, word[rows]))
            times = np.bincount(entry, train[rows], many_entries)
            first = np.zeros(many_entries, np.int64)
            first[entry] = np.arange(len(rows))
            of, old = own[first], p[rows[first]]
            has = times > 0
            distinct = np.bincount(of, has, many)
            c1, s1, o1 = times[has], of[has], old[has]
            left_out = (np.maximum(c1 - 1 - DISCOUNT, 0) + DISCOUNT * (distinct[s1] - (c1 == 1)) * o1) / (n[s1] - 1)
            gain = np.bincount(s1, c1 * np.log(left_out / o1), many)
            kept = gain >= min_gain
            states += int((kept & (distinct > 0)).sum())
            ok = kept[own]
            rows, own, entry = rows[ok], own[ok], entry[ok]
            p[rows] = (np.maximum(times[entry] - DISCOUNT, 0) + DISCOUNT * distinct[own] * p[rows]) / n[own]
            seen[rows] |= times[entry] > 0
        above = own_n
    return p, seen, states


def pack_questions(cols: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """``(part, blob)`` of bucket, words before, word, whether it is cached, and times seen; each question once.

    A word after a word before it goes to one part, sorted, as steps from one question to the next; a word that is
    not cached goes where its count goes, by its hash alone.
    """
    key = _mix(cols[0], entry_key(cols[1 : DEPTH + 1], cols[DEPTH + 1]))
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    if len(one) < len(key):
        times = np.bincount(of, cols[-1], len(one)).astype(np.int64)
        cols = [*(c[one] for c in cols[:-1]), times]
    del key, one, of
    part = np.where(cols[DEPTH + 2], (_mix(cols[1], cols[DEPTH + 1]) % np.uint64(parts)).astype(np.int64), cols[DEPTH + 1] % parts).astype(np.uint16)
    order = np.lexsort((cols[DEPTH + 1], cols[1], part))
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    bucket, *context, word, is_cached, times = (c[order] for c in cols)
    step = lambda x: np.diff(x, prepend=x.dtype.type(0))  # noqa: E731 - wraps, and so does the sum
    for k in np.flatnonzero(np.diff(edge)).tolist():
        at = slice(int(edge[k]), int(edge[k + 1]))
        ok = is_cached[at]
        code = np.where(ok, word[at], NONE).astype(np.int32)
        rare = word[at][~ok].view(np.uint64)
        blob = pack([bucket[at].astype(np.uint16), step(context[0][at]), *(c[at] for c in context[1:]), step(code), times[at].astype(np.uint32), step(rare)])
        yield k, np.array([len(code), len(rare)], np.int64).tobytes() + blob


def unpack_questions(blob: bytes) -> list[np.ndarray]:
    """What was packed: bucket, words before, word, whether it is cached, times seen."""
    n, rare = np.frombuffer(blob, np.int64, 2).tolist()
    bucket, *context, code, times, hashes = unpack(blob[16:], _ASKED, [n] * (DEPTH + 3) + [rare])
    context[0], code = np.cumsum(context[0], dtype=np.int32), np.cumsum(code, dtype=np.int32)
    word = code.astype(np.int64)
    word[code < 0] = np.cumsum(hashes, dtype=np.uint64).view(np.int64)
    return [bucket.astype(np.int64), *context, word, code >= 0, times.astype(np.int64)]


def gather(cols: list[np.ndarray], depth: int = DEPTH) -> list[np.ndarray]:
    """What is asked, each once a bucket: bucket, words before, word, whether it is cached; then n1, one1 and so on: how
    often the word was seen in each context of its row, of up to ``depth`` words, over all buckets, and whether the row
    is the first of that context and word."""
    bucket, *context, word, is_cached, times = cols
    order = np.lexsort((bucket, *context[:0:-1], word, is_cached, context[0]))
    bucket, word, is_cached, times = (x[order] for x in (bucket, word, is_cached, times))
    context = [c[order] for c in context]
    other = lambda x: np.append(True, x[1:] != x[:-1])
    first, new = [], other(context[0]) | other(is_cached) | other(word)
    for k in range(1, DEPTH + 1):
        new = new | other(context[k - 1])
        first.append(new)
    own = np.flatnonzero(new | other(bucket))
    out = [x[own] for x in (bucket, *context, word, is_cached)]
    for new in first[:depth]:
        begin = np.flatnonzero(new)
        n = np.add.reduceat(times, begin)
        out += [n[np.searchsorted(begin, own, "right") - 1], new[own]]
    return out


def tell(asked: DataFrame, z: float, min_gain: float, depth: int) -> DataFrame:
    """``(bucket, c1.., word, p, n)`` for words after frequent sequences, which :func:`gather` has counted.

    The probability of the word by its longest context that lies in several buckets, and how often that was seen.
    Such contexts, of up to ``depth`` words, are a few a bucket, hence fit to broadcast.
    """
    rows = asked.where(F.col("c1") != NONE).withColumns({"p": (F.coalesce("total", F.lit(0)) + 0.5) / F.lit(z), "n": F.lit(None).cast("long")})
    for k in range(1, depth + 1):
        context, c, old, n = _CONTEXT[:k], F.col(f"n{k}"), F.col("p"), F.col("own_n")
        entries = rows.where(F.col(context[-1]) != NONE).where(f"one{k}")
        sums = materialize(entries.groupBy(*context).agg(F.sum(c).alias("own_n"), F.count_if(c > 0).alias("distinct")))
        left_out = (F.greatest(c - 1 - DISCOUNT, F.lit(0.0)) + DISCOUNT * (F.col("distinct") - (c == 1).cast("int")) * old) / F.greatest(n - 1, F.lit(1))
        gain = F.sum(F.when((c > 0) & (n > 1), c * F.ln(left_out / old)))
        tested = entries.join(F.broadcast(sums), context).groupBy(*context).agg(*(F.first(x).alias(x) for x in ("own_n", "distinct")), F.first("n").alias("up"), gain.alias("gain"))
        kept = (n >= 2) & (F.col("up").isNull() | (n < F.col("up"))) & (F.coalesce("gain", F.lit(0.0)) >= min_gain)
        states = materialize(tested.select(*context, "own_n", "distinct", kept.alias("kept")))
        p = F.when(F.col("kept"), (F.greatest(c - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("distinct") * old) / n).otherwise(old)
        # rows of shorter contexts find no state and stay as they are
        rows = rows.join(F.broadcast(states), context, "left").withColumns({"p": p, "n": F.coalesce("own_n", "n")}).drop("own_n", "distinct", "kept")
    return rows.select("bucket", *_CONTEXT, "word", "p", "n")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET_TOKENS, cached: int = CACHED, min_gain: float = MIN_GAIN) -> tuple[DataFrame, int]:
    """Learn from the rows that meet ``train`` and score all rows; also the number of training tokens.

    ``(id, n_tokens, n_known, base_score, score)`` for each row, rows that repeat an id included; a
    null text is empty, and a null condition means no.  Texts are read whole.
    """
    spark = docs.sparkSession
    picked = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    idt = picked.schema["id"].dataType.simpleString()
    most = max(1, bucket // 4)
    every = max(1, most // SAMPLED)
    seen = materialize(count_words(picked.select("text", "train"), every).where((F.col("length") == 1) | (F.col("n") * every >= most)))
    words = seen.where("length = 1").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = picked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    top = words.orderBy(F.desc("n"), "key").limit(cached).toArrow()  # so many at most
    vocabulary = Vocabulary(top["key"].to_numpy().view(np.uint64), top["n"].to_numpy(), total["n"], total["v"], bucket)
    often = seen.where("length > 1").select("length", "key").toArrow()  # a few a bucket
    of = often["length"].to_numpy()
    vocabulary.heavy = [np.sort(often["key"].to_numpy().view(np.uint64)[of == k]) for k in range(2, DEPTH + 1)]
    held = spark.sparkContext.broadcast(vocabulary)
    buckets = int(min(max(1, max(total["n"], size // 6) // bucket + 1), 1 << 16))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = held.value, Words()
        step = TaskContext.get().partitionId() << 33

        def emit(at, row, ids, n, base, blobs):
            """Texts with their numbers in the step, tokens, known ones and base; or packed rows."""
            size = len(at)
            whole = [pa.array(np.asarray(x).astype(np.int64)) for x in (at, np.full(size, step), row, *n)]
            return pa.RecordBatch.from_arrays([*whole, pa.array(base, pa.float64()), ids, pa.array(blobs, pa.binary())], names=_DEALT)

        for b in (s for whole in batches for s in slices(whole, 1)):
            learn = b.column(2).to_numpy(zero_copy_only=False)
            for first, t, sizes in chunks(b.column(1).to_pylist(), known):
                code = v.codes(t)
                left = before(code, sizes)
                own = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
                row = np.arange(len(sizes))
                cached_word = code > 0
                root = np.where(cached_word, v.log_root[np.maximum(code, 1) - 1] if len(v.keys) else 0.0, 0.0)
                n = sizes, np.bincount(own, cached_word, len(sizes))
                ids = b.column(0).slice(first, len(sizes))
                yield emit(_mix(row + step) % np.uint64(buckets), row, ids, n, np.bincount(own, root, len(sizes)), [None] * len(sizes))
                del root, cached_word
                where = dealt(v, left, parts_of(t, sizes), buckets)
                order = np.argsort(where.astype(np.uint16), kind="stable")
                edge = np.searchsorted(where[order], np.arange(buckets + 1))
                del where
                cols = [c[order] for c in (*left, np.maximum(code, -1), own)]  # the hash says which other word it is
                rare = t[order]
                del t, code, left, own, order
                counted = learn[first : first + len(sizes)][cols[-1]].astype(np.uint8)
                at, blobs = [], []
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    lo, hi = int(edge[k]), int(edge[k + 1])
                    wide = rare[lo:hi][cols[DEPTH][lo:hi] < 0]
                    head = np.array([hi - lo, len(wide)], np.int64).tobytes()
                    steps = np.diff(cols[-1][lo:hi], prepend=np.uint32(0))
                    blobs.append(head + pack([*(c[lo:hi] for c in cols[:-1]), steps, counted[lo:hi], wide]))
                    at.append(k)
                none = np.zeros(len(at))
                yield emit(at, none - 1, pa.nulls(len(at), b.column(0).type), (none, none), none, blobs)
                step += len(sizes)
        known.clear()
        give_back()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each bucket has to be told: words that are not cached, and words after frequent ones, with their counts."""
        v, known = held.value, Words()
        parts, size = [], 0

        def out():
            found = list(pack_questions([np.concatenate(c) for c in zip(*parts)], buckets))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["part", "blob"])

        for b in (s for whole in batches for s in slices(whole, 0)):
            learn = b.column(1).to_numpy(zero_copy_only=False)
            for first, t, sizes in chunks(b.column(0).to_pylist(), known):
                code = v.codes(t)
                left = before(code, sizes)
                counted = np.repeat(learn[first : first + len(sizes)], sizes)
                deep = spread(v, left)
                where = dealt(v, left, parts_of(t, sizes), buckets, deep)
                word = np.where(code > 0, code, t.view(np.int64))
                for length in range(0 if asks else 1, DEPTH + 1):
                    at = np.flatnonzero(deep == length if length else code < 0)
                    if not len(at):
                        continue
                    context = [c[at] if k < length else np.full(len(at), NONE, np.int32) for k, c in enumerate(left)]
                    _, one, of = np.unique(_mix(where[at], entry_key(context, word[at])), return_index=True, return_inverse=True)
                    times = np.bincount(of, counted[at], len(one)).astype(np.int64)
                    at = at[one]
                    parts.append([where[at], *(c[one] for c in context), word[at], code[at] > 0, times])
                    size += len(one)
                    del context, one, of
                del code, left, counted, deep, where, word
                if size >= CHUNK:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()
        parts = []
        known.clear()
        give_back()

    def meet(got: pa.Table, count: pa.Table) -> pa.Table:
        """What buckets ask of some words, with the counts over all of them."""
        v = held.value
        if not len(got):
            return answer.empty_table()
        cols = [np.concatenate(c) for c in zip(*(unpack_questions(x.as_py()) for x in got["blob"]))]
        bucket, *context, word, is_cached = (found := gather(cols, depth))[: DEPTH + 3]
        del cols
        total = np.zeros(len(word), np.int64)
        total[is_cached] = v.counts[word[is_cached] - 1]
        if len(count):  # a word without a count is not learnt from
            key, n = count["word"].to_numpy(), count["total"].to_numpy()
            order = np.argsort(key)
            at = order[np.minimum(np.searchsorted(key, word, sorter=order), len(key) - 1)]
            total = np.where(~is_cached & (key[at] == word), n[at], total)
        out = pa.Table.from_arrays([*map(pa.array, (bucket, *context, word, total, *found[DEPTH + 3 :]))], schema=answer)
        del bucket, context, word, is_cached, total, found
        give_back()
        return out

    def work(got: pa.Table, told: pa.Table) -> pa.Table:
        v = held.value
        is_text = got["blob"].is_null()
        texts, blobs = got.filter(is_text), got.filter(pc.invert(is_text)).select(["step", "blob"])
        id_type = texts["id"].type
        out = [_rows(texts["step"], texts["row"], texts["id"], (texts["n"], texts["known"]), texts["base"])]
        steps = blobs["step"].to_numpy()
        parts, sizes = [], []
        for blob in blobs["blob"]:
            raw = blob.as_py()
            n, wide = np.frombuffer(raw, np.int64, 2).tolist()
            parts.append(unpack(raw[16:], _PACKED, [n] * (DEPTH + 3) + [wide]))
            np.cumsum(parts[-1][DEPTH + 1], out=parts[-1][DEPTH + 1])
            sizes.append(n)
        del got, blobs
        if not parts:
            return pa.concat_tables(out)
        cols = list(zip(*parts))
        del parts
        *left, word, own, counted, rare = (np.concatenate(cols.pop(0)) for _ in range(DEPTH + 4))
        # where each text of a step begins: rows of a step follow one another, those of a text too
        edge = np.cumsum(sizes)
        begin = np.append(True, own[1:] != own[:-1])
        begin[edge[:-1]] = True
        begin = np.flatnonzero(begin)
        answers = _Answers(told)
        del told
        other = np.flatnonzero(word < 0)
        p = 10 ** v.log_root[np.maximum(word, 1) - 1] if len(v.keys) else np.ones(len(word))
        names, of = np.unique(rare, return_inverse=True)
        times = np.zeros(len(names), np.int64)
        if len(names) and asks:
            times = answers.n[answers.find([np.full(len(names), NONE, np.int32)] * DEPTH, names.view(np.int64))]
        p[other] = ((times + 0.5) / v.z)[of]
        text = np.searchsorted(begin, other, "right") - 1
        base = np.bincount(text, np.log10(p[other]), len(begin))
        known = np.bincount(text, (times > 0)[of], len(begin)).astype(np.uint32)
        word[other] = -1 - of
        names, text, of = names.view(np.int64), None, None
        deep = spread(v, left)
        total = np.zeros(len(word), np.int64) if deep.any() else None
        for k in range(0, len(word), CHUNK // 4):
            at = k + np.flatnonzero(deep[k : k + CHUNK // 4])
            if len(at):
                word_at = word[at].astype(np.int64)
                word_at[word_at < 0] = names[-1 - word_at[word_at < 0]]
                place = answers.find([np.where(deep[at] > j, c[at], NONE) for j, c in enumerate(left)], word_at)
                p[at], total[at] = answers.p[place], answers.n[place]
        del answers, names, rare, other
        p, _, _ = apply_tree(left, word, counted.view(bool), p, min_gain, deep if total is not None else None, total)
        del left, word, counted, deep, total
        sums, base = (np.rint(x / -_UNIT).astype(np.int64).view(np.uint64) for x in (np.add.reduceat(np.log10(p), begin), base))
        names = own[begin]
        del p
        cut = np.searchsorted(begin, edge - np.array(sizes)), np.searchsorted(begin, edge)
        packed = [len(names[a:z]).to_bytes(8, "little") + pack([np.diff(names[a:z], prepend=np.uint32(0)), *(x[a:z] for x in (sums, base, known))]) for a, z in zip(*(c.tolist() for c in cut))]
        none = np.zeros(len(steps))
        out.append(_rows(steps, none, pa.nulls(len(steps), id_type), (none, none), none, packed))
        del sums, names, base, known, own, begin
        give_back()
        return pa.concat_tables(out)

    def add_up(got: pa.Table) -> pa.Table:
        """The texts of a step with the sums of all buckets."""
        is_text = got["blob"].is_null()
        texts = got.filter(is_text)
        row = texts["row"].to_numpy()
        size = int(row.max()) + 1 if len(row) else 0
        score, base, known = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        for blob in got.filter(pc.invert(is_text))["blob"]:
            raw = blob.as_py()
            n = int.from_bytes(raw[:8], "little")
            names, *more = unpack(raw[8:], _SUMS, [n] * len(_SUMS))
            names = np.cumsum(names)
            for whole, part in zip((score, base, known), more):
                whole[names] += part.view(np.int64) if part.itemsize == 8 else part
        score, base = (-_UNIT * x for x in (score, base))
        known, base = texts["known"].to_numpy() + known[row], texts["base"].to_numpy() + base[row]
        return pa.table([texts["id"], texts["n"], pa.array(known), pa.array(base), pa.array(score[row])], names=["id", "n_tokens", "n_known", "base_score", "score"])

    dealt_rows = picked.mapInArrow(deal, f"bucket long, step long, row long, n long, known long, base double, id {idt}, blob binary")
    fields = ", ".join(f"{c} int" for c in _CONTEXT)
    # a bucket has nothing to ask if all words are cached and none is frequent
    asks = total["v"] > len(vocabulary.keys)
    told = spark.createDataFrame([], f"bucket long, {fields}, word long, p double, n long")
    kept = []
    depth = 1 + sum(len(h) > 0 for h in vocabulary.heavy)
    answer = [("bucket", pa.int64()), *((c, pa.int32()) for c in _CONTEXT), ("word", pa.int64()), ("total", pa.int64())]
    answer = pa.schema([*answer, *(x for k in range(1, depth + 1) for x in ((f"n{k}", pa.int64()), (f"one{k}", pa.bool_())))])
    if asks or vocabulary.classes.max() > 1:
        asked = picked.select("text", "train").mapInArrow(ask, "part long, blob binary")
        # counts of words that are not cached, dealt as their questions are
        count = words.where(F.col("n") <= int(vocabulary.counts.min()) if len(top) else F.lit(True)).where(F.lit(asks))
        count = count.select(F.pmod("key", F.lit(buckets)).cast("long").alias("part"), F.col("key").alias("word"), F.col("n").alias("total"))
        sought = ", ".join(f"n{k} long, one{k} boolean" for k in range(1, depth + 1))
        met = asked.groupBy("part").cogroup(count.groupBy("part")).applyInArrow(meet, f"bucket long, {fields}, word long, total long, {sought}")
        kept.append(asked := materialize(met))
        other = asked.where(F.col("c1") == NONE)
        told = other.select("bucket", *_CONTEXT, "word", F.lit(None).cast("double").alias("p"), F.col("total").alias("n"))
    if vocabulary.classes.max() > 1:
        told = told.unionByName(tell(asked, vocabulary.z, min_gain, depth))
    schema = f"step long, row long, id {idt}, n long, known long, base double, blob binary"
    parts = materialize(dealt_rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(work, schema))
    for table in kept:
        release(table)
    sums = parts.groupBy("step").applyInArrow(add_up, f"id {idt}, n_tokens long, n_known long, base_score double, score double")
    return sums, total["n"]


class _Answers:
    """What a bucket is told, by context and word."""

    def __init__(self, told: pa.Table):
        key = entry_key([told[c].to_numpy() for c in _CONTEXT], told["word"].to_numpy())
        order = np.argsort(key)
        self.key, self.p, self.n = key[order], told["p"].to_numpy()[order], told["n"].to_numpy()[order]

    def find(self, context: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        key = entry_key(context, word)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        if not len(self.key) or (self.key[at] != key).any():
            raise RuntimeError("a bucket was not told all that it asked for")
        return at


def _rows(step, row, ids, n, base, blobs=None) -> pa.Table:
    size = len(step)
    whole = lambda x: x if isinstance(x, pa.ChunkedArray) else pa.array(np.asarray(x).astype(np.int64))
    base = base if isinstance(base, pa.ChunkedArray) else pa.array(base)
    blobs = pa.nulls(size, pa.binary()) if blobs is None else pa.array(blobs, pa.binary())
    cols = [whole(step), whole(row), ids, *map(whole, n), base, blobs]
    return pa.table(cols, names=["step", "row", "id", "n", "known", "base", "blob"])


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from all documents but those of remainder 1 of 5 (null ids are learnt from), and score all documents."""
    found, n = score(docs, ~held_out(1, 5))
    return found.select(
        F.col("id").alias("doc_id"), held_out(1, 5, "id").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
