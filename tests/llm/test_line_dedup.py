from collections import Counter

import duckdb

from gridcanopy.llm.line_dedup import clean_documents, dedup_lines
from gridcanopy.llm.queries import ORACLE_SQL, QUERIES


def brute(docs: list[tuple]) -> dict:
    """First copies of windows by (id, position), covered lines of later ones removed."""
    seen, gone = set(), Counter()
    cut: dict = {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                cut.setdefault(i, set()).update((p, p + 1, p + 2))
            seen.add(w)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut.get(i, ())) for i, t in docs}


def test_against_brute_force(spark, text_rows):
    lines = ["p", "q", "r", "s", ""]
    made = [(k, "\n".join(lines[(k * 7 + j * j) % 5] for j in range(k % 13 + 1))) for k in range(120)]
    docs = made + [(1000 + i, t or "") for i, t in text_rows.items()]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_odd_rows(odd, empty):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(rows[0].asDict())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["text"] is None and by[3][0]["n_lines"] == 0 and by[4][0]["text"] == "" and by[4][0]["n_lines"] == 1
    assert [r["text"] for r in by[7]] == ["a\nb\nc\nd"] * 2  # a repeated row is the same document
    assert by[8][0]["text"] == "x" and by[8][0]["n_removed"] == 3
    assert dedup_lines(empty).count() == 0


def test_clashing_names_stay(odd):
    docs = odd.withColumnRenamed("score", "n_lines").withColumnRenamed("id", "gone")
    out = clean_documents(docs)
    assert out.columns == docs.columns and out.schema["n_lines"].dataType == docs.schema["n_lines"].dataType
    assert {r["n_chars"] for r in out.where("doc_id = 8").collect()} == {1}


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({ORACLE_SQL['op10_line_windows']}) ORDER BY doc_id").fetchall()
    got = QUERIES["op10_line_windows"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
