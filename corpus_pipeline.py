"""A training-data pipeline of five stages over the table `documents`.

Documents that a quality classifier rejects go; of near duplicates (five-word shingles, similarity 0.8) the one of
smallest doc_id stays; secrets are masked; sources are mixed to target weights, which repeats or leaves out documents;
what is left is encoded to token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. Nulls,
empty tables and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.llm import bpe, classifier, jaccard, mixing, secrets
from capsule.llm.common import n_words, table
from capsule.sources.staging import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, weights).where("predicted = 1").select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs).withColumn("_masked", secrets.redacted(F.col("text"), F.col("found")))
    size = F.when(F.size("found") > 0, F.length("_masked").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("_masked"), "n_chars": size}
    return found.select([new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, n_words(F.col("text")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *bpe.vocabulary_file()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Tokens, learned weights and exact joins of hashed shingles have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
