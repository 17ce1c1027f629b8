"""The registered queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import decontaminate, embedding_dedup, filter_audit, hard_negatives, lengths, packing, pii, repair, simhash, spans, suffix_tree_lm, toxicity
from .line_dedup import dedup_lines


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after removal of later copies of three-line windows."""
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
w AS (
  SELECT doc_id, pos, line AS l1,
         lead(line, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS l2,
         lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS l3
  FROM l),
v AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS nth
  FROM w WHERE l3 IS NOT NULL AND trim(l1 || l2 || l3) <> ''),
g AS (SELECT DISTINCT doc_id, pos + k AS pos FROM v, (VALUES (0), (1), (2)) AS s(k) WHERE nth > 1),
k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
         count(*) AS n_lines, count(g.pos) AS n_removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a probabilistic suffix tree, and under word counts."""
    return suffix_tree_lm.score_documents(table(spark, sf_dir, "documents"))


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those that weak supervision adds."""
    return pii.find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded length of a document as a context limit, with the exact sums it answers."""
    return lengths.by_limit(lengths.suffix_sums(lengths.token_counts(table(spark, sf_dir, "documents"))))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written as grammar blocks and read back."""
    path = repair.write_tokens(table(spark, sf_dir, "documents"))
    return repair.read_tokens(spark, path, with_ids=False)


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a benchmark item, within its edit budget, in every document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.c),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM m LEFT JOIN n ON m.vec_id = n.vec_id
"""


def op9_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every document, with its worst sentence."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, repeat and cost in each source, for all 120 orders and every step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
first AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > first.first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN first ON d.t = first.t LEFT JOIN l ON d.doc_id = l.doc_id),
n AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (
  SELECT n.*, o.filter_order,
         least(CASE WHEN contains(fails, 'A') THEN strpos(filter_order, 'A') ELSE 9 END,
               CASE WHEN contains(fails, 'B') THEN strpos(filter_order, 'B') ELSE 9 END,
               CASE WHEN contains(fails, 'C') THEN strpos(filter_order, 'C') ELSE 9 END,
               CASE WHEN contains(fails, 'D') THEN strpos(filter_order, 'D') ELSE 9 END,
               CASE WHEN contains(fails, 'E') THEN strpos(filter_order, 'E') ELSE 9 END) AS fell
  FROM n, o),
k(step) AS (VALUES (1), (2), (3), (4), (5)),
r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
         CAST(sum(CASE WHEN fell > step THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN fell = step THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fell < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN fell = step THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN fell = step THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; every seventh id counts under the next label."""

    def label(vec_id, own):
        return F.when(vec_id % 7 == 0, (own + 1) % 10).otherwise(own)

    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel=label)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS s
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT a, b, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT pos.a AS anchor_id, pos.b AS positive_id,
       CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY p.s DESC, p.b) AS INTEGER) AS rank,
       p.b AS negative_id, pos.s AS positive_score, p.s AS negative_score
FROM pos JOIN p ON p.a = pos.a AND NOT p.same AND 80 * pos.s <= 100 * p.s AND p.s <= pos.s
QUALIFY row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY p.s DESC, p.b) <= 5
"""


def op13_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces, of what they decode to and of their source spans."""
    return spans.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_suffix_tree_lm": op1_suffix_tree_lm,
    "op2_weak_pii": op2_weak_pii,
    "op3_simhash": op3_simhash,
    "op4_length_histogram": op4_length_histogram,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_repair_tokens": op6_repair_tokens,
    "op7_qgram_decontamination": op7_qgram_decontamination,
    "op8_multi_index": op8_multi_index,
    "op9_toxicity_mil": op9_toxicity_mil,
    "op10_line_windows": op10_line_windows,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sentencepiece_spans": op13_sentencepiece_spans,
}
ORACLE_SQL = {
    "op8_multi_index": OP8_SQL,
    "op10_line_windows": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
