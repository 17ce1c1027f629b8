"""Toxicity, personal data, decontamination, embeddings, language model and the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from gridcanopy.llm import decontaminate, embedding_dedup, pii, toxicity
from gridcanopy.llm.queries import ORACLE_SQL, QUERIES

# Toxicity ----------------------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op9_toxicity_mil"](spark, d).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    pos = np.array([r["score"] for r in held if labels[r["doc_id"]]])
    neg = np.array([r["score"] for r in held if not labels[r["doc_id"]]])
    auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert auc > 0.95 and (pos >= 0.3).mean() > 0.65 and (neg >= 0.3).mean() < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxic_sentence_is_located():
    rows = [(f"word{k} calm and plain. another line{k} here", 0) for k in range(60)] + [(f"calm words{k}. you vile person. more text{k}", 1) for k in range(30)]
    m = toxicity.NoisyOr.fit(rows)
    text = "calm and plain. you vile person! more here"
    score, a, z, worst = m.score(text, {})
    assert score > 0.5 and text[a:z] == " you vile person" and 0 < worst <= score


def test_fit_is_bounded_whatever_repeats(spark, monkeypatch):
    """Repeated rows count once, labels without a document take no place, and characters are bounded in all."""
    read = []
    monkeypatch.setattr(toxicity.NoisyOr, "calibrated", classmethod(lambda cls, rows, **k: read.append(rows)))
    docs = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, "c" * 30), (3, None), (4, "d" * 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 200)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, max_rows=10, max_chars=1000)
    assert sorted(read[-1]) == [("", 1), ("a", 1), ("b", 1), ("c" * 30, 0)]
    toxicity.fit(docs, labels, max_rows=2, max_chars=1000)
    assert len(read[-1]) <= 3
    toxicity.fit(docs, labels, max_rows=10, max_chars=320)
    assert sum(len(t) for t, _ in read[-1]) <= 320


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None), (1, 0), (77, 1)], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert toxicity.score_documents(empty, labels).count() == 0
    kept = toxicity.drop_toxic(odd, labels.where("false"))
    assert kept.columns == odd.columns and kept.count() == odd.count()


# Personal data -----------------------------------------------------------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_exact(text_rows):
    rng = random.Random(0)
    for _ in range(20000):
        t = "".join(rng.choice("0123456789.@+-( )a0é%_1") for _ in range(rng.randrange(1, 40)))
        assert pii.base_spans(t) == base(t), t
    for t in text_rows.values():
        assert pii.base_spans(t or "") == base(t or "")


def test_pii_query(spark, sf_dir, text_rows):
    for r in QUERIES["op2_weak_pii"](spark, sf_dir).collect():
        want = [f"{k}:{a}:{z}" for k, a, z in base(text_rows[r["doc_id"]] or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == sum(w.startswith("email") for w in want) and r["n_card"] == sum(w.startswith("card") for w in want)


def test_method_adds_spans(spark):
    card = "4111 1111 1111 1111"
    rows = [(k, f"call +1 (212) 555-01{k:02d} or mail a{k}@b{k}.com, card {card}") for k in range(40)]
    rows += [(100, f"numbers {card} {card} end"), (101, "tel +1 (212) 555-0199 10.1.2.3 x"), (102, "write to joe (at) site (dot) com now"), (103, "phone (212) 555-0100 now"), (104, "section 12345 version 1.2")]
    got = {r["id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"].count("card:") == 2 and got[101]["spans"].count("phone:") == 1 and got[102]["n_added"] == 1 and got[103]["n_added"] == 1 and got[104]["spans"] == ""


def test_em_orders_labelers():
    """A labeler that agrees with the others earns a higher ratio than one that votes at random."""
    rng = random.Random(2)
    n = Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        vote = "".join(("y" if (y if rng.random() < a else not y) else "n") for a in (0.95, 0.9, 0.9, 0.8, 0.55, 0.5))
        n[vote] += 1
    post, table = pii.expectation_maximisation(sorted(n.items()))
    ratio = [t["y"][0] / t["y"][1] for t in table]
    assert ratio[0] > ratio[3] > ratio[5] and post["yyyyyy"] > 0.95 and post["nnnnnn"] < 0.05


def test_pii_odd_rows(odd, empty):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == "" for r in rows) and pii.find(empty).count() == 0


def test_pii_takes_linear_time():
    import time

    began = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 150_000):
        pii.base_spans(t)
    assert time.time() - began < 20


# Decontamination ---------------------------------------------------------------------------------


def edits(item, text):
    """Least edits of the item in any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for k, ch in enumerate(item, 1):
        new = [k]
        for j, other in enumerate(text, 1):
            new.append(min(row[j - 1] + (ch != other), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edited_passages(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "tiny"), (901, "a short item of 30 characters!")]
    index = decontaminate.ItemIndex(items)
    rng = random.Random(1)
    for n in range(40):
        k = rng.randrange(len(index.ids))
        name, text = next((i, t) for i, t in items if i == index.ids[k])
        s = list(text)
        for _ in range(rng.randrange(0, int(len(s) * 0.1) + 4)):
            p = rng.randrange(len(s))
            s[p : p + rng.randrange(2)] = [rng.choice("abc xyz")] * rng.randrange(2)
        around = "".join(rng.choice("lorem ipsum dolor ") for _ in range(150))
        doc = around[: rng.randrange(150)] + "".join(s) + around[: rng.randrange(150)]
        best = edits(decontaminate.characters(text).tolist(), decontaminate.characters(doc).tolist())
        got = [e for i, _, _, e in index.scan([doc])[0] if i == name]
        assert bool(got) == (best <= index.k[k]) and (not got or min(got) == best), n


def test_exact_passages_and_clean_rows(spark, sf_dir, text_rows):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rows = QUERIES["op7_qgram_decontamination"](spark, sf_dir).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert {(d, i) for d, t in text_rows.items() for i, x in items.items() if x in (t or "")} <= got
    for r in rows:
        assert edits(items[r["item_id"]].lower(), (text_rows[r["doc_id"]][r["start"] : r["end"]]).lower()) <= len(items[r["item_id"]]) * 0.1


def test_capitals_are_folded_one_by_one():
    """A character whose lower case is two does not switch folding off; places stay code points."""
    item = "The quick brown fox jumps over the lazy dog near the river bank"
    index = decontaminate.ItemIndex([(1, item)])
    text = "\u0130 " + item.upper() + " \u0130\u03a3"
    assert index.scan([text])[0] == [(1, 2, 2 + len(item), 0)]


def test_short_items_are_found_exactly():
    index = decontaminate.ItemIndex([(1, "x"), (2, "C3P0 up"), (3, " "), (4, None), (5, "four")])
    got = index.scan(["x, c3p0\tUP xx four4", "", None, "four fours FOUR"])
    assert got == [[(1, 0, 1, 0), (2, 3, 10, 0)], [], [], [(5, 0, 4, 0), (5, 11, 15, 0)]]


def test_places_take_linear_time():
    found = {0: {(0, 10 * k, 10 * k + 9) for k in range(60_000)}}
    begin = time.process_time()
    assert len(decontaminate._apart(found, [7])) == 60_000
    assert time.process_time() - begin < 5


def test_columns_whose_names_differ_by_case(spark):
    docs = spark.createDataFrame([(1, "some words of a text"), (1, "the quick brown fox jumps over it"), (1, "the quick brown fox jumps over it")], "Doc_id long, Text string")
    bench = spark.createDataFrame([(9, "quick brown fox jumps")], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [r["Text"] for r in left.collect()] == ["some words of a text"]


def test_long_text_in_steps():
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew potions quietly"
    index = decontaminate.ItemIndex([(1, item)])
    filler = "zq vw xk jj pq " * 60_000
    at = decontaminate.STEP_CHARS - 40
    text = filler[:at] + item + filler[:at]
    assert index.scan(["", text, None]) == [[], [(1, at, at + len(item), 0)], []]


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six")], "item_id long, text string")
    rows = decontaminate.contaminated(odd, bench).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 2]
    clean = decontaminate.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench.where("false")).count() == odd.count()


# Embeddings --------------------------------------------------------------------------------------


def vectors(seed=0, n=400, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    rows = []
    for k in range(n):
        v = base[rng.integers(len(base))] + rng.normal(size=d) * rng.choice([0.0, 0.02, 0.08])
        rows.append((k, v.astype(np.float32), int(rng.integers(3))))
    centre = rng.normal(size=d)
    rows += [(n + k, (centre + rng.normal(size=d) * 0.05).astype(np.float32), 1) for k in range(300)]
    return rows


def brute_links(rows):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    comp = list(range(len(ids)))
    while True:
        new = [min([comp[k], *(comp[j] for j in np.flatnonzero(near[k]))]) for k in range(len(ids))]
        if new == comp:
            return {i: (int(near[k].sum()), ids[comp[k]]) for k, i in enumerate(ids)}
        comp = new


def test_embeddings_against_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in rows], "vec_id long, embedding array<float>, label int")
    want = brute_links(rows)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)  # crowded cells in many blocks
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.99 * links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_embeddings_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLE_SQL['op8_multi_index']}) ORDER BY 1").fetchall()
    got = QUERIES["op8_multi_index"](spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == want


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], 2), (2, [2.0, 0.0], 1), (None, [1.0, 0.001], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnsRenamed({})
    got = [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    assert sorted(r for r in got if r[0] == 2) == [(2, 3, 1, False)] * 2 and (1, 3, 1, True) in got and (None, 3, 1, False) in got
    assert all((i, 0, i, True) in got for i in (3, 4, 5, 6, 7, 8, 9))
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embeddings_of_several_widths(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [3.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [2.0, 0.0, 0.0], 1), (5, [1.0], 1), (6, None, 1), (7, [1.0], None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), *((k, 0, k, True) for k in (5, 6, 7))]


# Language model ----------------------------------------------------------------------------------


def test_base_scores_are_exact(spark, sf_dir, text_rows):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in text_rows.items()}
    c = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op1_suffix_tree_lm"](spark, sf_dir).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        w = tokens[r["doc_id"]]
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# Pipeline ----------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, labels, learn=~toxicity.held_out(2, 4))
    left = {r["doc_id"]: r["text"] for r in docs.collect() if model.score(r["text"] or "", {})[0] < 0.3}
    from test_line_dedup import brute
    from test_near_copies import kept

    lines = brute(list(left.items()))
    one = {i: lines[i] for i in kept(lines)}
    index = decontaminate.ItemIndex(bench)
    clean = {i: t for i, t in one.items() if not index.scan([t])[0]}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(clean) and len(clean) > 0.5 * len(left)
    from test_tokens import check_packed, plain

    check_packed(rows)
    size = Counter()
    for r in rows:
        size[r["doc_id"]] += r["length"]
    assert all(size[i] == len(plain(t)) + 1 for i, t in clean.items())


def test_stages_keep_columns(spark, sf_dir, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
