"""The operators as queries over the supplied tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.llm import (
    bitslice,
    graph,
    language,
    lm,
    merkle,
    mixing,
    pieces,
    quality,
    runs,
    secrets,
    simhash,
    toxicity,
    warc,
)
from tripfold.llm.common import id_fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(id_fold("doc_id", 5) != 0)
    model = quality.train(docs, learn, "doc_id", "text", "quality", at=0.3)
    scored = docs.select("doc_id", quality.score_column(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return graph.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op4_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), id_fold("doc_id", 5) == 1)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.drop("live", "body_hash")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op7_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return bitslice.top_products(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = id_fold("doc_id", 3) != 1
    model = toxicity.train(docs.where(learn), labels.where(learn), at=0.7)
    scored = docs.select("doc_id", "lang", toxicity.score_column(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        toxicity.flagged(F.col("score"), F.col("lang"), model).alias("flagged_by_language"),
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentation_digests(table(spark, sf_dir, "documents"), k=4)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.document_runs(spark, sf_dir)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(spark, sf_dir)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (
        op1_simhash,
        op2_quality,
        op3_graph,
        op4_bilinear,
        op5_secrets,
        op6_warc,
        op7_bitslice,
        op8_mixing,
        op9_toxicity,
        op10_pieces,
        op11_runs,
        op12_language,
        op13_merkle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc": warc.PAGES_SQL,
        "op7_bitslice": bitslice.PRODUCTS_SQL,
        "op8_mixing": mixing.TAKEN_SQL,
        "op13_merkle": merkle.MANIFEST_SQL,
    }
