"""Reading tables: scan, normalise, reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.functions.expressions import day_of_week, parse_time, plain_time
from tripfold.schema import RAW_ENTITY, RAW_PLACE, RAW_READINGS, RAW_TIME, RAW_TYPE
from tripfold.sources.named import read_named


def read_raw_readings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of readings whose header names the columns, in any order; all text."""
    return read_named(spark, path, RAW_READINGS.names)


def read_readings(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return normalise(read_raw_readings(spark, path), strict)


def _parsed(raw: DataFrame) -> DataFrame:
    # Without an id of its own a reading is told apart by its content: equal rows then tie,
    # but are interchangeable, so every order of them gives the same trip.
    reading_id = (
        F.col("reading_id")
        if "reading_id" in raw.columns
        else F.xxhash64(*(F.col(f"`{name}`") for name in RAW_READINGS.names))
    )
    return raw.select(
        reading_id.alias("reading_id"),
        F.col(f"`{RAW_ENTITY}`").alias("entity_id"),
        F.col(f"`{RAW_TYPE}`").alias("entity_type"),
        parse_time(F.col(f"`{RAW_TIME}`")).alias("ts"),
        F.col(f"`{RAW_PLACE}`").alias("place"),
        F.col(f"`{RAW_TIME}`").alias("time_text"),
    )


def _unusable() -> Column:
    return F.col("ts").isNull() | F.col("entity_id").isNull() | F.col("place").isNull()


def _reason() -> Column:
    return (
        F.when(F.col("entity_id").isNull(), "no entity")
        .when(F.col("place").isNull(), "no place")
        .when(F.col("ts").isNull(), "unreadable time")
    )


def parsed_readings(raw: DataFrame) -> DataFrame:
    """All readings in one pass: those of `normalise` with a NULL `reason`, those of `rejected` with one."""
    return with_date(_parsed(raw)).withColumn("reason", _reason())


def normalise(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Typed readings: reading_id, entity_id, entity_type, ts, place, date.

    Rows without entity, place or readable time are left out (`rejected` lists them); with
    `strict` the first such row fails the job.
    """
    parsed = _parsed(raw)
    if strict:
        complaint = F.concat(F.lit("unusable reading at "), F.coalesce("time_text", F.lit("NULL")))
        # A condition, not a column: a query that uses no column still meets it.
        fails = F.raise_error(complaint).cast("boolean")
        parsed = parsed.where(F.when(_unusable(), fails).otherwise(F.lit(True)))
    else:
        parsed = parsed.where(~_unusable())
    return with_date(parsed.drop("time_text"))


def rejected(raw: DataFrame) -> DataFrame:
    """The raw rows `normalise` leaves out, with the reason."""
    return (
        _parsed(raw)
        .where(_unusable())
        .withColumn("reason", _reason())
        .drop("ts")
    )


def with_date(readings: DataFrame) -> DataFrame:
    return readings.withColumn("date", F.to_date("ts"))


def describe_readings(readings: DataFrame) -> DataFrame:
    """Readings with unix seconds and the canonical time text."""
    return readings.withColumn("unix_time", F.unix_seconds("ts")).withColumn(
        "datetime", plain_time(F.col("ts"))
    )


def with_day_of_week(readings: DataFrame) -> DataFrame:
    return readings.withColumn("day_of_week", day_of_week(F.col("ts")))
