"""A corpus pipeline of five operators: language, near-duplicates, secrets, mixture and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.llm.bpe import digests
from hybridrank.llm.common import ensure_checkpoint_dir
from hybridrank.llm.language_id import predict, train
from hybridrank.llm.minhash import near_duplicates
from hybridrank.llm.mixing import emit
from hybridrank.llm.secrets import redact

#: A text whose best language holds a smaller share of its trigrams is rejected.
LEAST_SCORE = 0.25


def _named(docs: DataFrame) -> list:
    """Columns of docs, whatever is in their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes lang; where nothing is labelled, all documents as they are.

    A text that is null, without a letter or unlike every learned language goes. Other columns may have any name.
    """
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(c if c in ("text", "lang") else f"keep_{i}") for i, c in enumerate(names)])
    filters = train(safe)
    if not filters.languages:
        return docs
    judged = predict(safe, filters, safe.columns)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("lang_pred" if c == "lang" else c if c == "text" else f"keep_{i}").alias(c) for i, c in enumerate(names)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least doc_id: five words, similarity 0.8.

    Documents without words or without doc_id are no copies and stay; rows that repeat a doc_id share its fate.
    """
    gone = near_duplicates(docs, k=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_named(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    return digests(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the language filters, the near-duplicate components or the forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
