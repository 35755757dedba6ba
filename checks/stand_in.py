"""The supplied tables read as readings and edges (see FIXTURES.md)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.plans import job
from tripfold.schema import ISO_TIME, PLAIN_TIME, RAW_ENTITY, RAW_PLACE, RAW_READINGS, RAW_TIME, RAW_TYPE
from tripfold.session import configure, shared_folder
from tripfold.sources.readings import with_date

# The place each event type stands for, and the place numbers of the edge rule.
PLACE_OF = {
    "signup": "entrance1",
    "error": "camping2",
    "purchase": "ranger-base",
    "click": "gate3",
    "view": "general-gate4",
}
NUMBERED = ["gate3", "general-gate4", "entrance1", "ranger-base", "camping2"]


def edge_rows() -> list[tuple[str, str, float]]:
    rows = []
    for i, source in enumerate(NUMBERED):
        for j, target in enumerate(NUMBERED):
            if i == j or (i, j) == (1, 4):
                continue
            distance = 1 + ((7 * i + 3 * j) % 5) * 0.0625
            rows.append((source, target, distance))
            if (i + j) % 2:
                rows.append((source, target, distance + 0.5))
    return rows


def edge_values() -> str:
    return ", ".join(f"('{s}', '{t}', CAST({d} AS DOUBLE))" for s, t, d in edge_rows())


def edges(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {edge_values()} AS e(source, target, distance)")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger edge list with many parallel edges: brand to type, at the part's size."""
    parts = configure(spark).read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(
        F.col("p_brand").alias("source"),
        F.col("p_type").alias("target"),
        (F.col("p_size") / 16).alias("distance"),
    )


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the five places, many of them parallel: the part's number gives the source,
    its size the target and the distance."""
    names = F.array(*map(F.lit, NUMBERED))
    parts = configure(spark).read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(
        F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("source"),
        F.get(names, (F.col("p_size") % 5).cast("int")).alias("target"),
        (F.col("p_size") / 16).alias("distance"),
    )


# What stands in for every thirteenth distance and so on in `broken_edges`.
BROKEN = {13: "NaN", 11: "Infinity", 7: "far", 5: "1e21", 3: "-2"}


def broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger edge list as text, with odd distances by the part's number, most of them unusable."""
    parts = configure(spark).read.parquet(f"{sf_dir}/part.parquet")
    text = (F.col("p_size") / 16).cast("string")
    for number, wrong in sorted(BROKEN.items()):
        text = F.when(F.col("p_partkey") % number == 0, wrong).otherwise(text)
    return parts.select(F.col("p_brand").alias("source"), F.col("p_type").alias("target"), text.alias("distance"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = configure(spark).read.parquet(f"{sf_dir}/events.parquet")
    place = F.lit(None).cast("string")
    for event_type, name in PLACE_OF.items():
        place = F.when(F.col("event_type") == event_type, name).otherwise(place)
    return events.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("entity_id"),
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("entity_type"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        place.alias("place"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_date(_events(spark, sf_dir))


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as text columns, with the two time forms taking turns."""
    form = F.when(F.col("reading_id") % 2 == 0, F.date_format("ts", PLAIN_TIME)).otherwise(
        F.date_format("ts", ISO_TIME)
    )
    return _events(spark, sf_dir).select(
        "reading_id",
        form.alias(RAW_TIME),
        F.col("entity_id").cast("string").alias(RAW_ENTITY),
        F.col("entity_type").alias(RAW_TYPE),
        F.col("place").alias(RAW_PLACE),
    )


def broken_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings of which every third lacks its place, every fifth its entity, every seventh a
    readable time."""
    n = F.col("reading_id")
    return (
        raw_readings(spark, sf_dir)
        .withColumn(RAW_PLACE, F.when(n % 3 != 0, F.col(f"`{RAW_PLACE}`")))
        .withColumn(RAW_ENTITY, F.when(n % 5 != 0, F.col(f"`{RAW_ENTITY}`")))
        .withColumn(RAW_TIME, F.when(n % 7 != 0, F.col(f"`{RAW_TIME}`")).otherwise("no time"))
    )


def job_run(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, int]]:
    """The job over CSV tables of the broken readings and the edges: its folder and what it counted.

    The folder has visits and trips in JSON, and trips by date in `dated`.
    """
    folder = f"{shared_folder(configure(spark))}/job-{uuid.uuid4().hex}"
    raw = broken_readings(spark, sf_dir).select(*(F.col(f"`{c}`") for c in RAW_READINGS.names))
    raw.write.option("header", True).csv(f"{folder}/readings")
    edges(spark).write.option("header", True).csv(f"{folder}/edges")
    paths = (f"{folder}/{name}" for name in ("readings", "edges", "visits", "trips"))
    return folder, job.run(spark, *paths, dated_path=f"{folder}/dated")
