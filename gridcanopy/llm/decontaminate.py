"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands.

An occurrence of an item of ``n`` characters with at most ``k`` edits shares at least
``n + 1 - q (k + 1)`` q-grams with the item, on diagonals (place in the text less place in the item)
that span no more than ``k``.  Bands of ``2 (k + 1)`` diagonals that overlap by half hold every such
span; bands with enough shared q-grams are kept and verified by a banded alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, column_at, give_back, slices

#: Edits allowed as a share of an item's characters.
EDIT_SHARE = 0.1
#: Items from LONG_ITEM characters on use q-grams of 8, others of 4; below MIN_ITEM they are found by exact search.
LONG_ITEM, MIN_ITEM = 60, 8
#: Characters of items that one pass over the documents looks for, of text in one step, pairs in one count.
BLOCK_CHARS, STEP_CHARS, STEP_PAIRS = 4_000_000, 1 << 19, 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_GAP = 0x110000  # no character: stands between texts


def _folded() -> np.ndarray:
    """Each code point's lower case where that is one code point, a blank for ASCII white space."""
    out = np.arange(0x20000, dtype=np.uint32)  # no letter beyond has case
    for k in range(len(out)):
        low = chr(k).lower()
        if len(low) == 1:
            out[k] = ord(low)
    out[9:14] = 32
    return out


FOLD = _folded()


def characters(text: str) -> np.ndarray:
    """Code points, each lower-cased by itself, so that every place stays what it was."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = FOLD.take(c, mode="clip")
    high = c >= len(FOLD)
    return np.where(high, c, low) if high.any() else low


def _text(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def qgrams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 4-grams and all 8-grams."""
    c = c.astype(np.uint64)
    if len(c) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h2 = c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:]
    h4 = h2[:-2] * np.uint64(0x165667B19E3779F9) + h2[2:]
    h8 = h4[:-4] * _MIX + h4[4:] if len(h4) > 4 else np.zeros(0, np.uint64)
    return h4, h8


def align(item: np.ndarray, region: np.ndarray, width: int, k: int) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the best place of ``item`` in ``region`` with at most ``k`` edits.

    Only diagonals 0 to ``width`` are filled.  Fewest edits first, then the leftmost start and end.
    """
    high = np.int64(1) << 32
    j = np.arange(width + 1, dtype=np.int64)
    padded = np.full(len(item) + width + 1, _GAP + 1, np.int64)
    m = min(len(region), len(padded))
    padded[:m] = region[:m]
    best = j.copy()  # edits * 2^32 + start
    for i, ch in enumerate(item.tolist()):
        step = best + np.where(padded[i : i + width + 1] == ch, 0, high)
        step[:-1] = np.minimum(step[:-1], best[1:] + high)
        best = np.minimum.accumulate(step - j * high) + j * high
        if i % 8 == 7 and best.min() >= (k + 1) * high:
            return None
    ends = len(item) + j
    best[ends > len(region)] = (k + 1) * high
    at = int(np.argmin(best))
    edits, start = divmod(int(best[at]), int(high))
    return (edits, start, min(len(region), len(item) + at)) if edits <= k else None


class ItemIndex:
    """The q-grams of a bounded block of items."""

    def __init__(self, items: list[tuple[object, str]], share: float = EDIT_SHARE):
        self.ids, self.chars, self.short = [], [], []
        short = []
        for i, t in items:
            c = characters(t or "")
            if len(c) >= MIN_ITEM:
                self.ids.append(i)
                self.chars.append(c)
            elif (word := _text(c)).strip():
                short.append((i, re.compile(rf"(?<!\w){re.escape(word)}(?!\w)")))
        for i, pattern in short:  # numbered after the others
            self.short.append((len(self.ids), pattern))
            self.ids.append(i)
        n = np.array([len(c) for c in self.chars], np.int64)
        q = np.where(n >= LONG_ITEM, 8, 4)
        self.k = np.minimum((n * share).astype(np.int64), (n // q) - 1)
        self.need = n + 1 - q * (self.k + 1)
        self.n, self.q = n, q
        self.places = int(n.max()) if len(n) else 1
        self.longest = int(n.max() + 2 * self.k.max() + 16) if len(n) else 0
        self.tables = []
        for size in (4, 8):
            own = [k for k in range(len(n)) if q[k] == size]
            grams = [qgrams(self.chars[k])[size == 8] for k in own]
            if not own:
                self.tables.append(None)
                continue
            h = np.concatenate(grams)
            item = np.repeat(own, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(keys * _MIX) >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((seen, keys, first, count, item[order], place[order]))

    def _bands(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(item, band)`` of the bands that meet their item's bound."""
        items, bands = [], []
        for table, grams in zip(self.tables, qgrams(c)):
            if table is None or not len(grams):
                continue
            seen, keys, first, count, item, place = table
            at = np.flatnonzero(seen[(grams * _MIX) >> np.uint64(64 - _FILTER_BITS)])
            slot = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            ok = keys[slot] == grams[at]
            at, slot = at[ok], slot[ok]
            pairs = np.cumsum(count[slot])
            found = []
            for lo, hi in _slices(pairs, STEP_PAIRS):
                times = count[slot[lo:hi]]
                begin = np.repeat(first[slot[lo:hi]], times)
                inner = np.arange(len(begin)) - np.repeat(np.cumsum(times) - times, times)
                it, pl = item[begin + inner], place[begin + inner]
                diagonal = np.repeat(at[lo:hi], times) - pl + self.n[it]  # never negative
                found.append(np.unique(((it << 24) | diagonal // (self.k[it] + 1)) * self.places + pl))
            if not found:
                continue
            # places of the item, each counted once in a half band whatever repeats in the text
            half, hits = np.unique(np.unique(np.concatenate(found)) // self.places, return_counts=True)
            both = np.concatenate((half, half - 1))  # a band is half b and half b + 1
            band, where = np.unique(both, return_inverse=True)
            hits = np.bincount(where, np.concatenate((hits, hits))).astype(np.int64)
            it = (band + 1) >> 24
            good = hits >= self.need[it]
            items.append(it[good])
            bands.append(band[good] - (it[good] << 24))
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(items), np.concatenate(bands)

    def scan(self, texts: list[str | None]) -> list[list[tuple[object, int, int, int]]]:
        """For each text the sorted ``(item id, start, end, edits)``; whole texts, in bounded steps.

        The characters of so many texts as fill a step are held at a time (those of a longer text by itself).
        """
        if not self.ids:
            return [[] for _ in texts]
        out, lo, size = [], 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= STEP_CHARS or hi == len(texts):
                out += self._scan(texts[lo:hi])
                lo, size = hi, 0
        return out

    def _scan(self, texts: list[str | None]) -> list[list[tuple[object, int, int, int]]]:
        out: list[dict] = [{} for _ in texts]
        gap = np.array([_GAP], np.uint32)
        chars = [characters(t or "") for t in texts]
        for found, c in zip(out, chars) if self.short else ():
            text = _text(c)
            for it, pattern in self.short:
                if places := {(0, m.start(), m.end()) for m in pattern.finditer(text)}:
                    found[it] = places
        if not self.chars:
            return [_apart(found, self.ids) for found in out]
        held: list[tuple[int, int, int]] = []  # text, offset in it, place in the step
        parts: list[np.ndarray] = []
        total = 0
        for d, c in enumerate(chars):
            for lo in range(0, max(1, len(c)), STEP_CHARS):
                piece = c[max(0, lo - self.longest) : lo + STEP_CHARS]
                held.append((d, max(0, lo - self.longest), total))
                parts += [piece, gap]
                total += len(piece) + 1
                if total >= STEP_CHARS:
                    self._step(np.concatenate(parts), held, chars, out)
                    held, parts, total = [], [], 0
        if held:
            self._step(np.concatenate(parts), held, chars, out)
        return [_apart(found, self.ids) for found in out]

    def _step(self, c: np.ndarray, held: list, chars: list[np.ndarray], out: list[dict]) -> None:
        begins = np.array([h[2] for h in held])
        for it, band in zip(*(x.tolist() for x in self._bands(c))):
            n, k = int(self.n[it]), int(self.k[it])
            low = band * (k + 1) - n  # the band's first diagonal
            width = 2 * (k + 1)
            first = max(0, int(np.searchsorted(begins, low - k, "right")) - 1)
            for d, offset, begin in held[first:]:
                if begin >= low + width + n + k:
                    break
                text = chars[d]
                start, stop = low - k - begin + offset, low - begin + offset + width + n + k
                region = text[max(0, start) : max(0, stop)].astype(np.int64)
                if len(region) < n - k:
                    continue
                lead = max(0, -start)  # the text begins inside the band
                region = np.concatenate((np.full(lead, _GAP, np.int64), region))
                got = align(self.chars[it], region, width + 2 * k, k)
                if got:
                    edits, a, z = got
                    out[d].setdefault(it, set()).add((edits, max(0, start + a), min(len(text), start + z)))


def _apart(found: dict[int, set], ids: list) -> list[tuple[object, int, int, int]]:
    """Of overlapping places of one item keep the one with fewest edits, then the leftmost."""
    kept = []
    for it, places in found.items():
        taken = Spans()
        for edits, a, z in sorted(places):
            if taken.add(a, z):
                kept.append((a, z, it, edits))
    return [(ids[it], a, z, edits) for a, z, it, edits in sorted(kept)]


def _slices(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(total):
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, "right")))
        yield lo, hi
        lo = hi


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``block_chars`` characters, one block at the driver at a time."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // block_chars)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct()
        yield sorted(((r["id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0], x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: every place of an item in a whole text, in code points.

    One pass over the documents for each bounded block of items, no shuffle.  Null and empty texts
    hold nothing; null and blank items are not looked for; an item of under MIN_ITEM characters has no
    edits and has to stand apart from other letters and digits; equal items with different ids are reported
    each, as are repeated rows.
    """
    dt, it = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {dt}, item_id {it}, start long, end long, edits int"
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)  # of bounded size

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(held.value, share)
            for b in (s for whole in batches for s in slices(whole, 1)):
                rows = [
                    (doc, *place)
                    for doc, places in zip(b.column(0).to_pylist(), index.scan(b.column(1).to_pylist()))
                    for place in places
                ]
                cols = list(zip(*rows)) or [()] * 5
                kinds = [b.column(0).type, None, pa.int64(), pa.int64(), pa.int32()]
                arrays = [pa.array(c, t) if t else pa.array(c) for c, t in zip(cols, kinds)]
                if rows:
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "start", "end", "edits"])

        found = picked.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The documents that hold no place of any item, with their own columns, filtered in the scan.

    Each row is judged by its own text: repeated rows and ids stay or go alike, null and empty texts stay.
    """
    at = column_at(docs, "text")
    for block in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(held.value, share)
            for b in (s for whole in batches for s in slices(whole, at)):
                clean = [not places for places in index.scan(b.column(at).to_pylist())]
                yield b.filter(pa.array(clean, pa.bool_()))
            del index
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
