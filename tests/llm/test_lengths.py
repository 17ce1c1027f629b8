import numpy as np

from gridcanopy.llm import lengths
from gridcanopy.llm.queries import QUERIES
from gridcanopy.llm.tokens import word_encoder


def test_query(spark, sf_dir, text_rows):
    n = np.array([len(word_encoder().tokenizer.encode(t or "", add_special_tokens=False).ids) for t in text_rows.values()])
    rows = QUERIES["op4_length_histogram"](spark, sf_dir).collect()
    assert sorted(r["length"] for r in rows) == sorted(set(n.tolist()))
    for r in rows:
        k = r["length"]
        assert (r["n_docs"], r["docs_from"], r["tokens_from"]) == ((n == k).sum(), (n >= k).sum(), n[n >= k].sum())
        assert (r["kept_tokens"], r["cut_docs"]) == (np.minimum(n, k).sum(), (n > k).sum())
        assert abs(r["quantile"] - (n <= k).mean()) < 1e-12 and (r["docs_all"], r["tokens_all"]) == (len(n), n.sum())


def test_any_limit_and_quantile(spark):
    n = np.random.default_rng(0).integers(0, 5000, 700)
    hist = spark.createDataFrame([(int(k), int((n == k).sum())) for k in np.unique(n)], "length long, n_docs long")
    sums = lengths.suffix_sums(hist)
    limits = [0, 1, 7, 1023, 1024, 2500, 4999, 9999]
    got = {r["limit"]: (r["kept_tokens"], r["cut_docs"]) for r in lengths.answers(sums, limits).collect()}
    assert got == {k: (np.minimum(n, k).sum(), (n > k).sum()) for k in limits}
    qs = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {r["q"]: r["length"] for r in lengths.quantiles(sums, qs).collect()}
    assert got == {q: int(np.quantile(n, q, method="inverted_cdf")) for q in qs}


def test_odd_rows(odd, empty):
    rows = lengths.token_counts(odd, end_ids=1).collect()
    assert sum(r["n_docs"] for r in rows) == odd.count() and {r["length"]: r["n_docs"] for r in rows}[1] == 4
    sums = lengths.suffix_sums(lengths.token_counts(empty))
    assert sums.count() == 0 and [tuple(r) for r in lengths.answers(sums, [5]).collect()] == [(5, 0, 0)]
