"""Hard negatives against all products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridcanopy.llm import hard_negatives
from gridcanopy.llm.hard_negatives import Side, mine, reaching, rotation

KIND = "vec_id long, embedding array<float>, label int, id string, anchor double, q int"


def _brute(rows, every=100):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, q in {(i, label, tuple(q)) for i, label, q in good if i % every == 0}:
        scored = [(sum(x * y for x, y in zip(q, p)), j, other == label) for j, other, p in good if j != i and len(p) == len(q) and q]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, j, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score]
            out += [(i, j, k, n, score, s) for k, (s, n, _) in enumerate(fits[:5], 1)]
    return sorted(out)


def _got(spark, rows, **k):
    d = spark.createDataFrame([(i, v, label, "x", 1.0, 2) for i, v, label in rows], KIND)
    found = mine(d, relabel=lambda i, own: F.when(i % 7 == 0, (own + 1) % 10).otherwise(own), **k)
    return sorted(tuple(r) for r in found.collect())


def _vectors(n, dim, seed, spread=0.6, labels=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    x = centres[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, [float(c) for c in v], int(rng.integers(0, labels))) for k, v in enumerate(x)]


def test_against_all_products(spark, monkeypatch):
    rows = _vectors(900, 12, 3)
    want = _brute(rows)
    assert len(want) > 100 and _got(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)  # several chunks and streams, small blocks
    monkeypatch.setattr(hard_negatives, "STREAM", 100)
    monkeypatch.setattr(hard_negatives, "WIDE", 17)
    monkeypatch.setattr(hard_negatives, "SIDE", 1)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 3)
    assert _got(spark, rows) == want


def test_ties_copies_and_signs(spark):
    """Many equal vectors, equal scores, zero vectors and products below zero."""
    rng = random.Random(1)
    rows = [(k, [0.5, 0.5, 0.0], k % 3) for k in range(60)] + [(k, [rng.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(3)], rng.randrange(3)) for k in range(60, 520)]
    rows += [(600, [0.0, 0.0, 0.0], 1), (700, [-0.5, -0.5, 0.0], 9), (800, [1e-9, -1e-9, 0.0], 1)]
    assert _got(spark, rows) == _brute(rows)


def test_odd_rows(spark):
    rows = _vectors(250, 5, 8)
    rows += [(300, None, 1), (400, [1.0] * 5, None), (500, [1.0, None, 0.0, 0.0, 0.0], 1), (600, [float("nan")] * 5, 1), (700, [float("inf")] * 5, 2)]
    rows += [(None, [0.5] * 5, 1), (800, [], 1), (801, [], 1), (900, [0.5, 0.5], 3), (901, [0.5, 0.4], 3), (902, [0.5, 0.45], 4), (903, [1.0], 3), (1000, [1.0], 4)]
    rows += [(100, [0.3] * 5, 2), rows[7], rows[8]]  # an id of two vectors, repeated rows
    assert _got(spark, rows) == _brute(rows)
    assert _got(spark, []) == [] and _got(spark, rows[:1]) == []
    assert _got(spark, [(k, [3e38] * 5, 1) for k in range(3)]) == []  # no 64-bit product


def test_bounds_never_lose_a_pair():
    """Windows that start or end exactly at a product, at all sizes of components."""
    rng = np.random.default_rng(5)
    for scale in (3, 300, 10**6):
        a, b = (rng.integers(-scale, scale, (n, 24)) for n in (30, 200))
        turn = rotation(b)
        one, two = (Side(np.arange(len(x)), np.zeros(len(x), np.int64), x, turn) for x in (a, b))
        s = a @ b.T
        rows = np.arange(30)
        low, high = np.sort(s, axis=1)[:, -20], np.sort(s, axis=1)[:, -3]
        i, j, found = reaching(one, rows, two, np.ones(s.shape, bool), low, high)
        want = (s >= low[:, None]) & (s <= high[:, None])
        assert len(i) == want.sum() and want[i, j].all() and (s[i, j] == found).all()
