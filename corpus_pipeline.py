"""A corpus made ready for training: five stages, each one of the operators, on whole tables.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last give the columns of ``documents``.

Defined results: rows with null or empty texts pass through every filter that accepts their score (an empty text is scored like any
other, is nobody's near-duplicate, has no secret, and takes no word of the mix, so it may be repeated or left out as its
source's target asks); very long texts go through every stage whole; of repeated rows, and of near-duplicates, one row with the least id
stays, on a tie of ids the one whose text has the least digest; rows without words are never duplicates; null ids are documents
like others; columns besides those of ``documents`` are carried up to the last stage, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_duplicates, quality, secrets, sentencepiece_fst
from lodestone.llm.common import read, written


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on ``labels``, does not reject."""
    return quality.scored_rows(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8."""
    return near_duplicates.one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows, each as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded_sha256``, a digest of the text that the ids decode to."""
    return sentencepiece_fst.encode(docs).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality classifier", accepted),
    ("minhash near-dedup", deduplicated),
    ("secret scans", redacted),
    ("source mixing", mixed),
    ("sentencepiece encoding", encoded),
]

#: The classifier is fitted and the similarity join is iterative; ``tests/llm/test_twins.py`` holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
