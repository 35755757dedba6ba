"""Training corpus from raw documents: filter, dedupe, redact, mix, tokenize."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.llm import mixing, pieces, quality, secrets, simhash
from tripfold.llm.common import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels of documents."""
    model = quality.train(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "quality"
    )
    return docs.where(quality.score_column(F.col("text"), model) >= model.at)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (3 words) link at 3 bits or fewer."""
    return simhash.one_of_each(docs, shingle=3, distance=3)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets that look live cut out; copied examples stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.repeated(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, as piece ids that decode to its text."""
    return pieces.segmentations(docs, k=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Hashing, training and sampling have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
