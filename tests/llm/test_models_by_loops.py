"""The trained parts of personal data and toxicity against plain loops."""

import math
from collections import Counter

import pytest

from gridcanopy.llm import pii, toxicity
from gridcanopy.llm.toxicity import NoisyOr

# Personal data -------------------------------------------------------------------------------------
PATTERNS = [("yyyy-y", 40), ("-yy--y", 22), ("-n--nn", 31), ("yy---y", 55), ("-y-y-n", 9), ("-n---y", 17), ("----nn", 3), ("yn---y", 5)]


def _em(patterns, rounds=50):
    post = {}
    for p, _ in patterns:
        yes, no = p.count("y"), p.count("n")
        post[p] = min(0.98, max(0.02, (1 + yes) / (2 + yes + 2 * no)))
    for _ in range(rounds):
        right = sum(post[p] * n for p, n in patterns)
        wrong = sum((1 - post[p]) * n for p, n in patterns)
        prior = (right + 1) / (right + wrong + 2)
        new = {}
        for p, _ in patterns:
            odds = math.log(prior / (1 - prior))
            for k, v in enumerate(p):
                yes = (sum(post[q] * n for q, n in patterns if q[k] == v) + 1) / (right + 3)
                no = (sum((1 - post[q]) * n for q, n in patterns if q[k] == v) + 1) / (wrong + 3)
                if v == "y":
                    no = min(no, yes)
                if v == "n":
                    yes = min(yes, no)
                odds += math.log(yes) - math.log(no)
            new[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        moved = max(abs(new[p] - post[p]) for p in post)
        if moved < 1e-6:
            break
        post = new
    return post


def test_expectation_maximisation_by_loops():
    got, reliab = pii.expectation_maximisation(PATTERNS)
    want = _em(PATTERNS)
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in want)
    assert len(reliab) == 6 and got["yyyy-y"] > 0.9 and got["-n--nn"] < 0.1


def _slopes(rows, soft, scores, l2=1.0):
    """The slope of the penalised likelihood in each weight, where weights are those that give the scores."""
    import numpy as np

    names = sorted({f for p, _ in rows for f in pii._names(p)})
    x = np.array([[f in pii._names(p) for f in names] + [True] for p, _ in rows], float)
    # the penalised optimum lies in the span of the rows: w = -x' (n (p - y)) / l2
    w = [-sum(x[r][k] * n * (scores[p] - soft[p.split("|", 1)[0]]) for r, (p, n) in enumerate(rows)) / l2 for k in range(len(names) + 1)]
    return {p: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x[r])))) for r, (p, _) in enumerate(rows)}


def test_span_classifier_is_the_penalised_optimum():
    """At the optimum the weights follow from the residuals, so the scores reproduce themselves."""
    rows = [(f"{p}|{size}:{sep}:{share}", n) for p, n in PATTERNS for size, sep, share in ((3, "-.", 2), (5, " ", 4))]
    soft = _em(PATTERNS)
    scores = pii.classifier(rows, soft)
    again = _slopes(rows, soft, scores)
    assert all(math.isclose(scores[p], again[p], abs_tol=1e-5) for p in scores)


def test_found_spans_by_loops(spark):
    """Whole texts to spans: votes counted, posteriors, classifier and choice taken by loops over all texts."""
    texts = ["mail a.b@example.com or call +1 415 555 0101", "joe (at) site (dot) org", "card 4111 1111 1111 1111 and 5500 0000 0000 0004 1", "ip 10.0.0.1 version 1.2.3.4", "call 415-555-0199 now", "order no. 415-555-0188", None, "", "ref 4111111111111112", "phone: (415) 555-0123 fax 020 7946 0018"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    for t in texts:
        t = t or ""
        base = pii.base_spans(t)
        seen.append([(k, a, z, b, f"{pii.votes(k, t, a, z, b)}|{pii.shape(k, t, a, z)}") for spans, b in ((base, True), (pii.further_spans(t, base), False)) for k, a, z in spans])
    scores = {}
    for kind in pii.KINDS:
        counts = Counter(s[4] for spans in seen for s in spans if s[0] == kind)
        votes = Counter()
        for p, n in counts.items():
            votes[p.split("|", 1)[0]] += n
        if counts:
            scores[kind] = pii.classifier(sorted(counts.items()), _em(sorted(votes.items())))
    for r in pii.find(docs).collect():
        spans = [s for s in seen[r["id"]] if s[3] or scores[s[0]][s[4]] >= 0.5]
        spans.sort(key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert r["spans"] == ",".join(f"{k}:{a}:{z}" for k, a, z, _, _ in spans)


# Toxicity ------------------------------------------------------------------------------------------
ROWS = [("you vile fool. good day", 1), ("good day to all", 0), ("all is calm. so calm", 0), ("vile words here! calm day", 1), ("a good word", 0), ("fool. vile. fool", 1), ("", 0)]


def _score(text, bias, weights):
    clean = 1.0
    for _, _, words in toxicity.sentences(text):
        z = bias + sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w))
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


@pytest.mark.parametrize("text", ["", "one", "You vile fool! Good. day\nvile", "fool " * 50 + ". x" * 30])
def test_noisy_or_score_by_loops(text):
    weights = {f: 0.7 * k - 1 for k, w in enumerate(("vile", "fool", "good", "x")) for f in toxicity.features(w)}
    model = NoisyOr(-1.5, weights)
    assert math.isclose(model.score(text, {})[0], _score(text, -1.5, weights), abs_tol=1e-12)


def test_noisy_or_fit_by_loops():
    """Adam on slopes that are found by differences of the loss."""
    steps, rate, l2, positive = 25, 0.1, 0.5, 2.0
    names = sorted({f for t, _ in ROWS for _, _, words in toxicity.sentences(t) for w in words for f in toxicity.features(w)})

    def loss(b, w):
        weights = dict(zip(names, w))
        total = 0.0
        for text, label in ROWS:
            p = min(_score(text, b, weights), 1 - 1e-15)
            total -= positive * math.log(max(p, 1e-300)) if label else math.log(1 - p)
        return total / len(ROWS) + l2 / (2 * len(ROWS)) * sum(v * v for v in w)

    b, w = -5.0, [0.0] * len(names)
    m, v = [0.0] * (len(names) + 1), [0.0] * (len(names) + 1)
    for t in range(1, steps + 1):
        at = [*w, b]
        slope = []
        for k in range(len(at)):
            up, down = list(at), list(at)
            up[k] += 1e-5
            down[k] -= 1e-5
            slope.append((loss(up[-1], up[:-1]) - loss(down[-1], down[:-1])) / 2e-5)
        for k, g in enumerate(slope):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            at[k] -= rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + (1e-6 if k < len(names) else 1e-9))
        *w, b = at
    model = NoisyOr.fit(ROWS, steps=steps, rate=rate, l2=l2, min_docs=1, positive=positive)
    assert math.isclose(model.bias, b, abs_tol=5e-3)
    assert all(abs(model.weights.get(f, 0.0) - x) < 5e-3 for f, x in zip(names, w))
    assert all(abs(model.score(t, {})[0] - _score(t, b, dict(zip(names, w)))) < 5e-3 for t, _ in ROWS)
