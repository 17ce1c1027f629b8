"""The filter audit against filters applied one after another."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from gridcanopy.llm import filter_audit


def _fails(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" if len(words) < 200 else ""
    found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    found += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    return found + ("D" if re.search(r"[#$%&*|]", text) else "")


def _brute(docs, labels):
    """Apply every order step by step to lists of documents."""
    rows = []
    for doc, text, part in docs:
        text = text or ""
        later = doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, _ in docs)
        own = [x for x in labels if x[0] == doc and doc is not None]
        rows.append((part or "", _fails(text) + ("E" if later else ""), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for k, f in enumerate(order, 1):
                cut = [r for r in left if f in r[1]]
                out[part, order, k] = [
                    len(left) - len(cut), len(cut), sum(f in r[1] for r in gone), sum(f == r[1] for r in own), sum(r[2] for r in cut), sum(r[3] for r in cut),
                ]
                total[f] += len(cut)
                left, gone = [r for r in left if f not in r[1]], gone + cut
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _same(spark, docs, labels, held=filter_audit.HELD_PARTS, clash=False):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    if clash:
        d = d.withColumns({c: F.lit("x") for c in ("part", "mask", "id", "digest", "label", "first", "step", "removed1")})
    found = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in found}
    want = _brute(docs, labels)
    assert len(found) == len(got) and got == want


def test_audit_against_applied_filters(spark):
    long = " ".join(f"word{k}" for k in range(220))
    texts = ["a b", "A B C", "x # y", long, long + " |", "one " * 300, "One " * 300, "ONE $ " * 250, "", None, " \t\n", "été ÉTÉ 東京 🙂" * 60, long.upper(), "\x1c a \x85 b"]
    docs = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)] + [(100 + k, texts[k % 5], "s1") for k in range(40)]
    docs += [(None, "a b", "s0"), (None, None, None), (3, long, "s0"), (3, "other", "s2"), (200, "a b", None), (201, "a b", "")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 140, 2)]
    labels = [(a, b, int(c)) for a, b, c in labels] + [(1, 0, 0), (1, 1, 0), (3, None, 1), (None, 1, 1), (999, 1, 1), (5, None, None)]
    _same(spark, docs, labels)
    _same(spark, docs, labels, clash=True)


def test_parts_are_handed_on_in_time(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 1)
    _same(spark, [(k, "a b" if k % 4 else "A | b", f"s{k % 3}") for k in range(30)], [(4, 1, 1)])


def test_one_text_in_most_rows(spark):
    """Copies of one text, a part that holds most rows, and one label for many."""
    docs = [(k, "the same" if k % 3 else f"text {k}", "hot" if k % 10 else f"s{k}") for k in range(400)]
    _same(spark, docs, [(k, 1, k % 2) for k in range(400)])


def test_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0


def test_odd_documents(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(odd, labels).collect()
    assert len(rows) == 600 and {r["kept"] + r["removed"] for r in rows if r["step"] == 1} == {odd.count()}


def test_table_of_first_failures():
    t = filter_audit.first_failures()
    assert t.shape == (32, 120) and not t[0].any() and (t[1:] > 0).all()
    for s in range(1, 32):
        for k, order in enumerate(filter_audit.ORDERS):
            assert order[t[s, k] - 1] == next(c for c in order if s >> "ABCDE".index(c) & 1)
