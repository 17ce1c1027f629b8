"""The suffix tree against one that is grown and walked context by context."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcanopy.llm import suffix_tree_lm as lm

D = lm.DISCOUNT


class Tree:
    """States and probabilities of small texts, straight from the definition."""

    def __init__(self, seqs, gain, depth=lm.DEPTH):
        self.uni = Counter(w for s in seqs for w in s)
        self.n, self.v, self.depth = sum(self.uni.values()), len(self.uni), depth
        self.next = defaultdict(Counter)
        for s in seqs:
            for k, w in enumerate(s):
                for d in range(1, depth + 1):
                    self.next[self.context(s, k, d)][w] += 1
        self.states = set()
        for d in range(1, depth + 1):
            for c in [c for c in self.next if len(c) == d]:
                n, own = sum(self.next[c].values()), self.next[c]
                if n < 2 or (d > 1 and n == sum(self.next[c[:-1]].values())):
                    continue
                total = 0.0
                for w, m in own.items():
                    low = self.p(c[:-1], w)
                    out = (max(m - 1 - D, 0) + D * (len(own) - (m == 1)) * low) / (n - 1)
                    total += m * math.log(out / low)
                if total >= gain:
                    self.states.add(c)

    def context(self, s, k, d):
        return tuple(s[k - j] if k >= j else "^" for j in range(1, d + 1))

    def p(self, context, w):
        if not context:
            return (self.uni[w] + 0.5) / (self.n + 0.5 * (self.v + 1))
        low = self.p(context[:-1], w)
        if context not in self.states:
            return low
        own = self.next[context]
        n = sum(own.values())
        return (max(own[w] - D, 0) + D * len(own) * low) / n

    def score(self, s):
        return sum(math.log10(self.p(self.context(s, k, self.depth), w)) for k, w in enumerate(s))


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    parts = ["the cat sat", "a dog ran", "the dog sat down", "x y z q", "x y w r", "v y z s", "q", "on the mat", "odd one %d", "one two three four five six seven"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))).replace("%d", str(rng.randrange(40))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")


def split(text):
    return [*text.lower().split(), "$"]


@pytest.mark.parametrize("gain", [0.0, 3.0, 8.0])
def test_scores_are_the_trees(spark, gain):
    texts = corpus()
    rows, n = lm.score(frame(spark, texts), F.col("doc_id") % 5 != 1, min_gain=gain)
    tree = Tree([split(t) for k, t in enumerate(texts) if k % 5 != 1], gain)
    assert n == tree.n and {len(c) for c in tree.states} == {1, 2, 3}
    got = {r["id"]: r for r in rows.collect()}
    for k, t in enumerate(texts):
        assert math.isclose(got[k]["score"], tree.score(split(t)), rel_tol=1e-9, abs_tol=1e-9), t
        assert (got[k]["n_tokens"], got[k]["n_known"]) == (len(split(t)), sum(tree.uni[w] > 0 for w in split(t)))


def test_states_are_few_and_their_next_words_sum_to_one():
    tree = Tree([split(t) for t in corpus()], 3.0)
    unknown = 0.5 / (tree.n + 0.5 * (tree.v + 1))
    for c in [(), *tree.states]:
        rest = unknown  # what a word never seen gets, through all states of the context
        for d in range(1, len(c) + 1):
            if c[:d] in tree.states:
                own = tree.next[c[:d]]
                rest *= D * len(own) / sum(own.values())
        assert math.isclose(sum(tree.p(c, w) for w in tree.uni) + rest, 1)
    assert len(tree.states) < len(tree.next) / 3


def test_kept_contexts_are_the_trees():
    seqs = [split(t) for t in corpus()]
    tree = Tree(seqs, 3.0)
    words = {w: k for k, w in enumerate(tree.uni, 1)}
    code = np.array([words[w] for s in seqs for w in s], np.int32)
    left = lm.before(code, np.array([len(s) for s in seqs]))
    p = np.array([tree.p((), w) for s in seqs for w in s])
    got, seen, states = lm.apply_tree(left, code, np.ones(len(code), bool), p, 3.0)
    assert states == len(tree.states)
    want = [tree.p(tree.context(s, k, lm.DEPTH), w) for s in seqs for k, w in enumerate(s)]
    np.testing.assert_allclose(got, want)


def test_few_cached_words(spark):
    """Words outside the cache are as known and as frequent as ever, and scores stay close to the tree's."""
    texts = corpus()
    whole = {r["id"]: r for r in lm.score(frame(spark, texts), F.lit(True))[0].collect()}
    some = {r["id"]: r for r in lm.score(frame(spark, texts), F.lit(True), cached=4)[0].collect()}
    for k, r in whole.items():
        assert math.isclose(some[k]["base_score"], r["base_score"], rel_tol=1e-9) and some[k]["n_known"] == r["n_known"] == r["n_tokens"]
    want = sum(r["score"] for r in whole.values())
    assert math.isclose(sum(r["score"] for r in some.values()), want, rel_tol=0.1)


def test_frequent_words_are_dealt_in_classes(spark):
    """No bucket holds more than a few times its rows though one word is a third of all; every token is scored."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "x", *map(str, range(40))], p=[0.34, 0.2, *[0.46 / 40] * 40], size=30)) for _ in range(300)]
    rows = lm.score(frame(spark, texts), F.lit(True), bucket=256)[0].collect()
    base = {r["id"]: r["base_score"] for r in lm.score(frame(spark, texts), F.lit(True))[0].collect()}
    assert all(r["n_tokens"] == 31 == r["n_known"] and math.isclose(r["base_score"], base[r["id"]], rel_tol=1e-9) for r in rows)
    tokens = np.concatenate([t for _, t, _ in lm.chunks(texts, lm.Words())])
    keys, counts = np.unique(tokens, return_counts=True)
    v = lm.Vocabulary(keys, counts, len(tokens), len(keys), 256)
    left = lm.before(v.codes(tokens), np.full(300, 31))
    where = lm.dealt(v, left, np.repeat(np.arange(300), 31), len(tokens) // 256)
    assert np.bincount(where).max() < 2.5 * 256


def test_words_that_share_a_place_are_found():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 5000, np.uint64)
    keys[::2] = keys[1::2] ^ np.uint64(1)  # same place in the table
    v = lm.Vocabulary(keys, rng.integers(1, 90, 5000), 10**6, 5000)
    assert (v.keys[v.find(keys)] == keys).all() and (np.diff(v.counts) <= 0).all() and (v.find(keys ^ np.uint64(2)) == -1).all()


def test_odd_rows(odd, empty):
    """Null ids, null and empty texts (one token, the end), repeats, a long text; no rows; nothing to learn from."""
    rows = lm.score(odd, F.lit(True))[0].collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["id"] in (3, 4, 5)} == {1}
    assert lm.score(empty, F.lit(True))[0].count() == 0
    got, n = lm.score(odd, F.lit(None).cast("boolean"))
    assert n == 0 and got.count() == odd.count() and got.where("n_known > 0 or score is null").count() == 0


@pytest.mark.parametrize("bucket, cached", [(64, lm.CACHED), (400, lm.CACHED), (lm.BUCKET_TOKENS, 4), (100, 30)])
def test_scores_do_not_depend_on_buckets_or_cache(spark, bucket, cached):
    """Frequent words in many classes, contexts of two and three of them, words outside the cache: the tree's scores all the same."""
    texts = [*corpus(), "the the the the cat", "The the " * 40, "x y x y x y z never seen"]
    learnt = F.col("doc_id") % 5 != 1
    rows = lm.score(frame(spark, texts), learnt, bucket=bucket, cached=cached)[0].collect()
    tree = Tree([split(t) for k, t in enumerate(texts) if k % 5 != 1], lm.MIN_GAIN)
    often = {w for w, n in tree.uni.items() if n > bucket / 4}
    assert bucket > 100 or {len(c) for c in tree.states if often.issuperset(c)} == {1, 2, 3}
    got = {r["id"]: r for r in rows}
    assert len(rows) == len(got) == len(texts)
    for k, t in enumerate(texts):
        assert math.isclose(got[k]["score"], tree.score(split(t)), rel_tol=1e-9, abs_tol=1e-9), t
        assert got[k]["n_known"] == sum(tree.uni[w] > 0 for w in split(t))


def test_contexts_part_only_if_they_are_frequent_themselves(spark):
    """Frequent words that seldom follow one another keep the contexts of two in one bucket; frequent sequences part, and scores are the tree's."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) + rng.choice(["", " p q r s" * 6]) for _ in range(120)]
    tokens = np.concatenate([t for _, t, _ in lm.chunks(texts, lm.Words())])
    keys, counts = np.unique(tokens, return_counts=True)
    bucket = 400
    found = lm.count_words(frame(spark, texts).select("text", F.lit(True).alias("train")), 1).collect()
    assert {r["key"]: r["n"] for r in found if r["length"] == 1} == dict(zip(keys.view(np.int64).tolist(), counts.tolist()))
    heavy = [np.sort(np.array([r["key"] for r in found if r["length"] == k and r["n"] >= bucket // 4], np.int64).view(np.uint64)) for k in (2, 3)]
    v = lm.Vocabulary(keys, counts, len(tokens), len(keys), bucket, heavy)
    sizes = np.array([len(split(t)) for t in texts])
    left = lm.before(v.codes(tokens), sizes)
    deep = lm.spread(v, left)
    old = lm.spread(lm.Vocabulary(keys, counts, len(tokens), len(keys), bucket), left)
    assert (old == 3).mean() > 0.9 > 2 * (deep == 3).mean() > 0
    where = lm.dealt(v, left, np.arange(len(tokens)), len(tokens) // bucket)
    for length in (2, 3):  # a context that is not spread lies in one bucket
        at = np.flatnonzero(deep < length)
        pairs = set(zip(*(c[at].tolist() for c in left[:length]), where[at].tolist()))
        assert len(pairs) == len({x[:-1] for x in pairs})
    tree = Tree([split(t) for t in texts], lm.MIN_GAIN)
    for r in lm.score(frame(spark, texts), F.lit(True), bucket=bucket)[0].collect():
        assert math.isclose(r["score"], tree.score(split(texts[r["id"]])), rel_tol=1e-9)


def questions(seed, n=20_000):
    """Questions of 40 buckets after frequent words, some of words that are not cached, repeats included."""
    rng = np.random.default_rng(seed)
    depth = rng.integers(0, 4, n)
    context = [np.where(depth >= k, rng.zipf(1.4, n) % 30, lm.NONE).astype(np.int32) for k in (1, 2, 3)]
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 50)
    is_cached = (depth > 0) & (rng.random(n) < 0.9)
    word = np.where(is_cached, 1 + rng.zipf(1.3, n) % 2000, hashes[rng.integers(0, 50, n)])
    return [rng.integers(0, 40, n), *context, word, is_cached, rng.integers(0, 3, n)]


def test_questions_are_asked_once_and_packed():
    """Each question goes once, in a few bytes, to the part that its word before it and its word tell, or the hash of a rare word."""
    cols, want = questions(1), {}
    for *key, times in zip(*(c.tolist() for c in cols)):
        want[tuple(key)] = want.get(tuple(key), 0) + times
    got, of, size = {}, {}, 0
    for part, blob in lm.pack_questions(cols, 7):
        size += len(blob)
        for *key, times in zip(*(c.tolist() for c in lm.unpack_questions(blob))):
            assert tuple(key) not in got
            got[tuple(key)] = times
            assert of.setdefault((key[1] if key[-1] else None, key[-2]), part) == part
            assert key[-1] or key[-2] % 7 == part
    assert got == want and size < 11 * len(want)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_questions_meet_over_all_buckets(depth):
    cols = questions(2)
    rows = list(zip(*(c.tolist() for c in cols)))
    sums = [{} for _ in range(depth)]
    for bucket, *context, word, is_cached, times in rows:
        for k in range(depth):
            key = (*context[: k + 1], word, is_cached)
            sums[k][key] = sums[k].get(key, 0) + times
    found = list(zip(*(c.tolist() for c in lm.gather(cols, depth))))
    assert sorted(r[:6] for r in found) == sorted({r[:6] for r in rows})
    firsts = [[] for _ in range(depth)]
    for r in found:
        for k in range(depth):
            key = (*r[1 : k + 2], r[4], r[5])
            assert r[6 + 2 * k] == sums[k][key]
            firsts[k] += [key] * r[7 + 2 * k]
    assert all(sorted(f) == sorted(s) for f, s in zip(firsts, sums))


def test_single_tokens_are_packed_and_worked(spark):
    """In a large input a step sends some buckets one token, whose arrays were read-only."""
    for kind in ("<u4", "u1", "<u8"):
        (one,) = lm.unpack(lm.pack([np.array([7], kind)]), [kind], [1])
        np.cumsum(one, out=one)
        assert one.tolist() == [7]
    texts = ["a", "b a", "", "a b", "c"] * 4
    rows = lm.score(frame(spark, texts).repartition(20, "doc_id"), F.lit(True), bucket=2)[0].collect()
    tree = Tree([split(t) for t in texts], lm.MIN_GAIN)
    assert len(rows) == 20 and all(math.isclose(r["score"], tree.score(split(texts[r["id"]])), rel_tol=1e-9) for r in rows)
