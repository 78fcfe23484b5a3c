"""The corpus pipeline: STAGES, each (name, function of (spark, docs, sf_dir)) on what the stage before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.lineage import cut, removed, shared_folder, small_batches
from quoin.llm import mixing, pieces, pii, simhash, toxicity


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars anew, of changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from labelled ids not held out.

    Null and empty texts score alike (see toxicity.score), equal texts go or stay together, repeated
    rows stay, an empty table stays empty, and all columns stay.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.packed(cut(toxicity.labelled(docs, labels))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar by 0.8 or more.

    The smallest id stays (null last); null and empty texts are one group, repeated rows are one, an
    empty table stays empty, and all columns stay.
    """
    return simhash.one_of_each(docs, words=5, least=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind.

    Every row stays; null texts stay null, texts without spans are unchanged, equal texts stay equal.
    """
    return _counted(pii.mask(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each source's documents, drawn by the shards' quotas until its target in words is met, in the shards' order.

    Documents without words are never drawn; a null source is one of its own, last in order; repeated
    rows count as often as they occur; an empty table gives no rows.
    """
    return _counted(mixing.shuffled(mixing.mix(docs), docs.columns)).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): each text's piece ids; none for null and empty texts, a row for each row."""
    return pieces.encode(docs).select(F.col("id").alias("doc_id"), F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# SQL has no nearest-example scores or byte-pair merges; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet to the shared folder and read again by the next; what the last wrote stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
