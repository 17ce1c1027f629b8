import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridcanopy.llm import simhash
from gridcanopy.llm.common import connected_components


def reference(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs: dict) -> dict:
    """Smallest id reachable, from fingerprints by id."""
    ids = sorted(pairs)
    f = np.array([pairs[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def test_fingerprint(text_rows):
    for t in [*list(text_rows.values())[:60], None, "", "  ", "One", "a B\tc", "a b c d", "É é Ä x y"]:
        assert simhash.fingerprint(t) == reference(t)


def test_allocation_sums():
    rng = random.Random(1)
    for parts in (2, 3, 4):
        cost = [sorted(rng.random() for _ in range(3)) for _ in range(parts)]
        _, ts = simhash.allocate(cost, 4)
        assert sum(t + 1 for t in ts) == 5


def test_layout_loses_no_pair():
    """Any two fingerprints within four bits share a probed part within its threshold."""
    rng = np.random.default_rng(0)
    sample = rng.integers(-(2**62), 2**62, 300)
    corr = np.abs(np.corrcoef(simhash._bits(sample).T))
    for n in (1_000, 10**6, 10**9):
        layout = simhash.plan(corr, sample, n)
        assert sorted(b for bits, _ in layout for b in bits) == list(range(64))
        for _ in range(2000):
            flipped = set(rng.choice(64, 4, replace=False).tolist())
            assert any(t >= 0 and len(flipped & set(bits)) <= t for bits, t in layout)


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    ids = {}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):
            f = centre
            for _ in range(rng.randrange(0, 5)):
                f ^= 1 << rng.randrange(64)
            ids[len(ids)] = f
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in ids.items()]
    fps = spark.createDataFrame(rows, "id long, fp long")
    roots = simhash.link_components(fps.groupBy("fp").agg(F.count("*").alias("n")))
    named = fps.join(roots, "fp").groupBy("root").agg(F.collect_list("id").alias("ids")).collect()
    got = {i: min(r["ids"]) for r in named for i in r["ids"]}
    assert got == components(ids)


def test_query(spark, sf_dir, text_rows):
    from gridcanopy.llm.queries import QUERIES

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    fp = {i: reference(t) for i, t in text_rows.items()}
    want = components(fp)
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r["id"]: r["component_id"] for r in got if r["fp"] == 0}
    assert zero[3] == zero[4] == zero[5] == 3 and zero[None] == 3
    assert {r["component_id"] for r in got if r["id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_long_chain_and_star(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert len(got) == 301 + 2000 and all(v == (0 if k <= 300 else 1000) for k, v in got.items())
