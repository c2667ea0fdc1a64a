"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, segmentation.

Each stage takes what its predecessor kept and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes every stage to the shared folder and reads it back, so that a lost executor repeats one stage at most and
no stage is worked out twice. The stages take NULLs, empty texts, repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probita.llm import decontam, jaccard, langid, pieces, secrets
from probita.llm.common import table
from probita.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing label gets the language found."""
    model = langid.fit(docs.where(~langid.held_out()))
    name, _, rejected = langid.found_names(docs.columns)
    found = langid.predict(docs, model).where(~F.col(rejected))
    return found.withColumn("lang", F.coalesce("lang", name)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar by 0.8 or more, the one with the smallest id."""
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secrets.redacted(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text with their next best alternatives, and whether they decode to the text."""
    return pieces.encode(docs, pieces.Model.load(), keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("segmentation", segmentation),
]

#: SQL can neither fit centroids nor hash by XXH64; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
