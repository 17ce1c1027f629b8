import random

import numpy as np

import corpus_pipeline
from gridcanopy.llm import near_copies
from gridcanopy.llm.simhash import majority


def sets(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def kept(rows):
    """Ids that brute force keeps: the smallest of each group linked by Jaccard 0.8 or more."""
    ids = sorted(rows)
    s = {i: sets(rows[i]) for i in ids}
    group = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {x: new if g == old else g for x, g in group.items()}
    return {i for i in ids if group[i] == i}


def edited(rng):
    """Texts whose copies differ in up to six places; a few short and wordless ones."""
    rows = {}
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows[len(rows)] = " ".join(words)
    for t in ("", None, " \n", "one two", "One two", "one two three"):
        rows[len(rows)] = t
    return rows


def test_near_dedup_against_brute_force(spark):
    rows = edited(random.Random(3))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == kept(rows)


def test_odd_rows(spark, odd, empty):
    assert near_copies.keep_one(empty).count() == 0
    out = near_copies.keep_one(odd)
    assert out.columns == odd.columns
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 6, 7, 8, 9]
    assert out.where("doc_id is null").count() == 2


def test_rows_are_told_apart_by_id_and_text(spark):
    """An id with two texts: the one like a smaller id's goes, the one that resembles nothing stays."""
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (3, b), (8, None)], "Doc_ID long, Text string")
    got = near_copies.keep_one(docs, "Doc_ID", "Text")
    assert sorted(map(tuple, got.collect())) == [(3, b), (5, a), (8, None)] and got.columns == ["Doc_ID", "Text"]


def test_blocks_find_every_open_pair(spark):
    """Keys cut into small blocks give the pairs that brute force gives, across clusters only."""
    rng = random.Random(8)
    base = [rng.randrange(2**62) for _ in range(40)]
    members = {k: sorted({*(x for x in base if rng.random() < 0.93), *(rng.randrange(2**62) for _ in range(rng.randrange(3)))}) for k in range(60)}
    cluster = {k: k % 7 if k % 3 else 0 for k in members}
    left = spark.createDataFrame([(9, k, len(m), cluster[k]) for k, m in members.items()], "key long, set long, n int, cluster long")
    sets_ = spark.createDataFrame([(k, m) for k, m in members.items()], "set long, members array<long>")
    want = {(a, b) for a in members for b in members if a < b and cluster[a] != cluster[b] and 5 * len({*members[a]} & {*members[b]}) >= 4 * len({*members[a]} | {*members[b]})}
    for block in (7, 512):
        assert {tuple(r) for r in near_copies._open_pairs(left, sets_, block).collect()} == want and want


def test_simhash_links_without_bands(spark):
    """Where no band proposes anything, sets whose fingerprints are within four bits are linked, those that only lie there are not."""
    rng, words = random.Random(6), near_copies.Words()
    rows = {}
    for _ in range(6):
        base = [f"w{rng.randrange(9000)}" for _ in range(1500)]
        for k in range(4):
            copy = list(base)
            if k:
                copy[rng.randrange(1500)] = f"x{k}"
            rows[len(rows)] = " ".join(copy)
    members = {i: near_copies.shingles(t, words) for i, t in rows.items()}
    fp = {i: majority(m) for i, m in members.items()}
    name = {i: np.array([near_copies._digest(m)], np.uint64).view(np.int64)[0].item() for i, m in members.items()}
    fp[20] = fp[0]  # a fingerprint that says copy where the sets say no
    signed = lambda x: x - 2**64 if x >> 63 else x
    distinct = spark.createDataFrame([(name[i], 1, i, len(members[i]), signed(fp[i]), []) for i in rows], "set long, copies long, least long, n int, fp long, bands array<long>")
    texts = spark.createDataFrame(list(rows.items()), "id long, text string")
    root = {r["set"]: r["root"] for r in near_copies._link(distinct, texts).collect()}
    linked = [(i, j) for i in rows for j in rows if i < j and i // 4 == j // 4 and 20 not in (i, j) and (fp[i] ^ fp[j]).bit_count() <= 4]
    assert len(linked) > 12 and all(root[name[i]] == root[name[j]] for i, j in linked)
    assert all(root.get(name[i]) != root.get(name[20], -1) for i in rows if i != 20)
