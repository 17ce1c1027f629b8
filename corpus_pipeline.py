"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage reads what its predecessor kept, as written Parquet; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridcanopy.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from gridcanopy.llm.common import materialize, shared_root, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model of :mod:`toxicity`, fitted on ``labels``, does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of three-line windows; ``n_chars`` is counted anew where lines went."""
    return line_dedup.clean_documents(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: five-word shingles, SimHash and bands propose, Jaccard 0.8 or more decides."""
    return near_copies.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in training sequences."""
    return packing.pack_documents(docs, forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # trained models, XXH64 and a tokenizer are beyond SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{at}/{k}-{name}")
    return docs
