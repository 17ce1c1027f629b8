"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import word_encoder

#: Lengths whose sums are taken together first, so that no task orders all lengths.
SPAN = 1024


def token_counts(docs: DataFrame, text_col: str = "text", end_ids: int = 0, tokenizer: str | None = None) -> DataFrame:
    """``(length, n_docs)``: documents by encoded length, whole texts, combined in the scan.

    ``end_ids`` ids are added to each document; null and empty texts have no others.  Every row counts,
    repeated ones too, and no other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for b in batches:
            sizes = [len(raw) // 4 + end_ids for raw in encoder.encode(b.column(0).to_pylist())]
            length, n = np.unique(np.array(sizes, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], names=["length", "n_docs"])

    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return text.mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """``(length, n_docs, docs_from, tokens_from, docs_all, tokens_all)`` for each length that occurs.

    ``docs_from`` and ``tokens_from`` count documents of that length or more.  Sums over spans of
    lengths are formed first; lengths are then ordered within their span only.  The histogram, a row a
    length, is written first: it is read twice, and texts should be encoded once.
    """
    histogram = materialize(histogram)
    spans = (
        histogram.groupBy(F.expr(f"length div {SPAN}").alias("span"))
        .agg(F.sum("n_docs").alias("d"), F.sum(F.col("length") * F.col("n_docs")).alias("t"))
    )
    beyond = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # one row for 1024 lengths
    every = Window.partitionBy()
    spans = spans.select(
        "span",
        *[F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in ("d", "t")],
    )
    inner = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    own = histogram.withColumn("span", F.expr(f"length div {SPAN}")).select(
        "span", "length", "n_docs", F.sum("n_docs").over(inner).alias("d"), F.sum(F.col("length") * F.col("n_docs")).over(inner).alias("t")
    )
    return own.join(spans, "span").select(
        "length", "n_docs",
        (F.col("d") + F.col("d_after")).alias("docs_from"), (F.col("t") + F.col("t_after")).alias("tokens_from"),
        F.col("d_all").alias("docs_all"), F.col("t_all").alias("tokens_all"),
    )


def truncated(limit: Column | int = "length") -> Column:
    """Tokens that are left if texts end at ``limit``, for a limit up to a row's length and over the one before."""
    at = F.col(limit) if isinstance(limit, str) else F.lit(limit) if isinstance(limit, int) else limit
    return F.col("tokens_all") - F.col("tokens_from") + at * F.col("docs_from")


def by_limit(sums: DataFrame) -> DataFrame:
    """The sums with each length taken as a context limit, and the share of shorter or equal documents.

    ``kept_tokens``: tokens left by that limit; ``cut_docs``: documents longer than it; ``quantile``: the
    largest q whose q-quantile (lower) is this length.
    """
    cut = F.col("docs_from") - F.col("n_docs")
    return sums.select(
        "length", "n_docs", "docs_from", "tokens_from", truncated().alias("kept_tokens"), cut.alias("cut_docs"),
        (1 - cut / F.col("docs_all")).alias("quantile"), "docs_all", "tokens_all",
    )


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, kept_tokens, cut_docs)`` for any limits, present as lengths or not.

    For each limit the first longer length holds the sums; limits past the longest cut nothing.
    """
    parts = [
        F.min(F.when(F.col("length") > k, F.struct("length", truncated(k).alias("kept"), F.col("docs_from").alias("cut")))).alias(f"a{i}")
        for i, k in enumerate(limits)
    ]
    row = sums.agg(F.max("tokens_all").alias("all"), *parts)
    each = [F.struct(F.lit(k).cast("long").alias("limit"), F.coalesce(F.col(f"a{i}.kept"), F.col("all"), F.lit(0)).alias("kept_tokens"), F.coalesce(F.col(f"a{i}.cut"), F.lit(0)).alias("cut_docs")) for i, k in enumerate(limits)]
    return row.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """``(q, length)``: the lower q-quantile of lengths, the smallest with at least that share up to it."""
    below = F.col("docs_all") - F.col("docs_from") + F.col("n_docs")
    row = sums.agg(*[F.min(F.when(below >= F.greatest(F.ceil(F.lit(q) * F.col("docs_all")), F.lit(1)), F.col("length"))).alias(f"q{i}") for i, q in enumerate(qs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("length")) for i, q in enumerate(qs)])).alias("r")).select("r.*")
