"""Token files and packing against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridcanopy.llm import packing, repair, tokens
from gridcanopy.llm.queries import QUERIES
from gridcanopy.llm.tokens import word_encoder

ODD = ["a", "B", "é", "É", "İ", "ß", "'s", "'", "1", "½", ".", ",", "!", "|", " ", "\n", "\x1c", "\x85", "\xa0", "́", "ﬁ", "<|endoftext|>", "中", "🙂", "​", "_", "-"]


def plain(text):
    return word_encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact(text_rows):
    rng = random.Random(3)
    texts = [*list(text_rows.values())[:40], *("".join(rng.choice(ODD) for _ in range(rng.randrange(12))) for _ in range(3000))]
    for t, raw in zip(texts, word_encoder().encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == plain(t)


def test_encoder_with_small_caches(monkeypatch):
    """Words come and go; the ids do not change."""
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    monkeypatch.setattr(tokens, "YOUNG_WORDS", 90)
    rng = random.Random(4)
    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(60):
        texts = ["".join(rng.choice([*ODD, "the", "cat", "Dog,", " "]) for _ in range(rng.randrange(20))) for _ in range(20)]
        for t, raw in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == plain(t)


@given(st.lists(st.integers(0, 6), max_size=300), st.integers(2, 4))
@settings(max_examples=80, deadline=None)
def test_grammar_round_trip(ids, least):
    block = repair.compress(np.array(ids, np.uint32), min_count=least)
    assert repair.decompress(block).tolist() == ids
    for a in range(0, len(ids), 37):
        assert repair.read_ids(block, a, min(len(ids), a + 50)).tolist() == ids[a : a + 50]


def test_grammar_shrinks():
    ids = np.tile(np.arange(50, dtype=np.uint32), 2000)
    block = repair.compress(ids)
    assert len(block) < len(ids) / 4 and (repair.decompress(block) == ids).all()


def test_grammar_goes_on_until_no_pair_is_frequent():
    ids = np.random.default_rng(1).zipf(1.5, 60_000).clip(1, 300).astype(np.uint32)
    base, rule, _, x = repair._parts(repair.compress(ids, min_count=40, max_symbols=1 << 20))
    _, count = np.unique(x[:-1].astype(np.uint64) << np.uint64(32) | x[1:], return_counts=True)
    assert len(rule) and (count >= 40).sum() <= 2  # a pair cut by overlaps may stay
    assert len(repair._parts(repair.compress(ids, max_symbols=base + 5))[1]) == 5


def plain_grammar(ids, least, limit):
    """Rounds of Re-Pair by counting all pairs: the rules and what is left."""
    x, rules, symbols = list(ids), [], max(ids, default=0) + 1
    while len(x) >= 2 * least and symbols < limit:
        count = Counter(zip(x, x[1:]))
        best = sorted((p for p in count if count[p] >= least), key=lambda p: (-count[p], p))[: limit - symbols]
        chosen, taken, k = set(best), [], 0
        while k < len(x) - 1:  # from the left, without overlaps
            hit = (x[k], x[k + 1]) in chosen
            taken += [k] * hit
            k += 1 + hit
        placed = Counter((x[k], x[k + 1]) for k in taken)
        new = {p: symbols + n for n, p in enumerate(sorted(p for p in best if placed[p] >= 2))}
        if not new:
            break
        rules += sorted(new, key=new.get)
        starts = {k: new[x[k], x[k + 1]] for k in taken if (x[k], x[k + 1]) in new}
        x = [starts.get(k, v) for k, v in enumerate(x) if k - 1 not in starts]
        symbols += len(new)
    return rules, x


@pytest.mark.parametrize("shift", [0, 1 << 17])
def test_grammar_is_that_of_all_pairs(shift):
    """Only places whose pair may be frequent are sorted, by one plain sort where two symbols fit four bytes."""
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 6000) % 300 + shift).astype(np.uint32)
    limit = int(ids.max()) + 200
    base, rule, lengths, left = repair._parts(repair.compress(ids, 4, limit))
    rules, x = plain_grammar(ids.tolist(), 4, limit)
    assert list(map(tuple, rule.tolist())) == rules and left.tolist() == x
    assert (repair._expand(left, base, rule, lengths) == ids).all()


def test_later_rounds_sort_few_places(monkeypatch):
    """One pair is frequent, and its symbol then stands beside a new neighbour each time: nothing to sort."""
    ids = np.array([v for k in range(3000) for v in (0, 1, 2 + k)], np.uint32)
    sorted_places, plain = [], repair._pairs
    monkeypatch.setattr(repair, "_pairs", lambda x, at, symbols: sorted_places.append(len(at)) or plain(x, at, symbols))
    assert (repair.decompress(repair.compress(ids)) == ids).all()
    assert sorted_places and sum(sorted_places) < 4000  # 9,000 pairs, and 6,000 beside the symbol after that


def test_documents_by_id(spark, odd):
    path = repair.write_tokens(odd, block_ids=50)
    want = {r["doc_id"]: r["ids"] for r in repair.read_tokens(spark, path).collect()}
    got = repair.fetch(spark, path, [6, 7, 99]).collect()
    assert sorted(r["doc_id"] for r in got) == [6, 7, 7] and all(r["ids"] == want[r["doc_id"]] for r in got)
    assert repair.fetch(spark, path, []).count() == 0


def test_token_files(spark, sf_dir, text_rows):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op6_repair_tokens"](spark, sf_dir).collect()}
    at = 0
    for i in sorted(text_rows):
        ids = [*plain(text_rows[i]), 1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_odd_rows(spark, odd, empty):
    path = repair.write_tokens(odd, block_ids=50)
    rows = repair.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == odd.count() and [r["doc_id"] for r in rows[:2]] == [None, None]
    assert [np.frombuffer(r["ids"], "<u4")[-1] for r in rows] == [1] * len(rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert repair.read_tokens(spark, repair.write_tokens(empty)).count() == 0


def check_packed(rows, length=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by)


def test_packing(spark, sf_dir, text_rows):
    rows = QUERIES["op5_best_fit_packing"](spark, sf_dir).collect()
    want = {}
    for i, t in text_rows.items():
        ids = [*plain(t), 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    least = -(-sum(v[1] for v in want.values()) // 2048)
    assert check_packed(rows) <= least * 1.02 + 1


def test_packing_in_rounds(spark):
    """Many small groups: later rounds merge what the first leaves."""
    rng = random.Random(5)
    sizes = [rng.randrange(1, 700) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    got = packing.pack(items, 2048, group_items=100).collect()
    size = dict(enumerate(sizes))
    rows = [{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": size[r["item"]]} for r in got]
    assert len(got) == 3000 and check_packed(rows) <= -(-sum(sizes) // 2048) * 1.03 + 1


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 200)
    bins, places = packing.best_fit(sizes, 100)
    rooms: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            k = rooms.index(min(fit))
            rooms[k] -= s
        else:
            rooms.append(100 - s)
    assert len(rooms) == bins.max() + 1


def test_packing_odd_rows(odd, empty):
    rows = packing.pack_documents(odd).collect()
    check_packed(rows)
    assert sum(1 for r in rows if r["doc_id"] in (3, 4, 5) and r["length"] == 1) == 3 and sum(1 for r in rows if r["doc_id"] == 7) == 2
    assert packing.pack_documents(empty).count() == 0
