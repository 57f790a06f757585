"""The document pipeline: STAGES in order, each a (name, function) over the rows that the one before kept.

A function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet in the shared folder and rereads them for the next,
which done, they are deleted; the last stage's rows go when the driver ends.
All stages but the last return the columns of documents.

Defined results: rows are never named by their id alone, so null and repeated
ids are fine, and columns beyond those of documents are carried along. Null and
letterless texts go in the first stage; of rows with equal text one stays. The
last stage has a row for each row before it. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterbrook.llm import bpe, decontam, langid, pii, simhash
from rasterbrook.llm.common import remove, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null texts, or no letter) go."""
    return langid.known_language(docs, langid.trained_on(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def anonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return pii.anonymise(docs, length_col="n_chars", key=pii.session_key(spark, pii.DEMO_KEY))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the bytes they decode to."""
    return bpe.digests(bpe.round_trip(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("anonymise", anonymise),
    ("tokenise", tokenise),
]

#: SQL has no XXH64, trained classifier or byte-pair merges: held against brute force in tests instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    remove(spark, base, at_exit=True)
    return docs
