"""All days of an entity in one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripfold.functions.expressions import exact_sum, speed, to_int32, whole_days
from tripfold.operators.ordering import TRIP, in_order
from tripfold.operators.segments import TRIP_ORDER, attach
from tripfold.operators.trips import (
    estimated_leg_rows,
    nested,
    trip_ends,
    trip_path_string,
    trip_summary,
)
from tripfold.operators.visits import DAILY
from tripfold.schema import DAY_SEP


def entity_path_rollup(readings: DataFrame, placed: bool = False) -> DataFrame:
    """days_span is the number of days with readings; path has them in date order."""
    return (
        trip_path_string(readings, placed)
        .groupBy("entity_id")
        .agg(
            F.max_by("entity_type", "date").alias("entity_type"),
            F.count("*").alias("days_span"),
            F.array_join(nested("days", "path", by="date")["path"], DAY_SEP).alias("path"),
        )
    )


def entity_path_rows(readings: DataFrame, spread: bool = False) -> DataFrame:
    """The rollup as a row per reading: its day's number among the entity's days with readings,
    how many those are, and its place in the day."""
    days = readings.groupBy(*TRIP).agg(F.lit(1).alias("one"))
    order = Window.partitionBy("entity_id").orderBy("date")
    numbered = days.select(
        *TRIP,
        F.row_number().over(order).alias("day"),
        F.count("*").over(Window.partitionBy("entity_id")).alias("days_span"),
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in TRIP]
    return (
        in_order(readings, spread)
        .alias("r")
        .join(numbered.alias("d"), same)
        .select(*(f"r.{c}" for c in TRIP), "days_span", "day", "pos", "place")
    )


_SLIM = ["entity_id", "date", "start_time"]


def _with_day_counters(
    trips: DataFrame, spread: bool, ends: DataFrame | None = None
) -> DataFrame:
    """Adds days_since, day_in_visit and days_to_next: completed 24 hour periods between the
    starts of neighbouring trips, and the running sum of the first."""

    def count(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("entity_id").orderBy(*TRIP_ORDER)
        start, none = F.col("start_time"), F.lit(0).cast("bigint")
        since = F.coalesce(whole_days(F.lag("start_time").over(order), start), none)
        to_next = F.coalesce(whole_days(start, F.lead("start_time").over(order)), none)
        so_far = F.sum("days_since").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return (
            rows.withColumn("days_since", since)
            .withColumn("days_to_next", to_next)
            .withColumn("day_in_visit", so_far)
        )

    return attach(trips, TRIP, _SLIM, count, spread, ends)


def itinerary_days(readings: DataFrame, lookup: DataFrame, spread: bool = False) -> DataFrame:
    """One row per daily trip of an entity, with its day counters."""
    trips = trip_summary(readings, lookup, spread=spread)
    return _with_day_counters(trips, spread, trip_ends(readings)).select(
        *TRIP, *(F.col("path_hash").alias("hash") if c == "hash" else F.col(c) for c in DAILY)
    )


def itinerary_leg_rows(readings: DataFrame, lookup: DataFrame, spread: bool = False) -> DataFrame:
    """One row per leg, with the completed 24 hour periods from its day's start to the next
    day's start."""
    columns = [*TRIP, "pos", "ts", "place", "elapsed", "distance", "speed", "days_to_next"]
    if spread:
        labels = _with_day_counters(trip_ends(readings), False).select(*TRIP, "days_to_next")
        legs = estimated_leg_rows(readings, lookup, spread=True)
        return legs.join(labels, TRIP).select(*columns)
    trips = _with_day_counters(trip_summary(readings, lookup, timed=True), False)
    return (
        trips.select(*TRIP, "days_to_next", F.posexplode("timed_path").alias("pos", "leg"))
        .select(*TRIP, "days_to_next", (F.col("pos") + 1).alias("pos"), "leg.*")
        .select(*columns)
    )


def itinerary_leg_chunks(
    readings: DataFrame, lookup: DataFrame, spread: bool = False, legs: int = 10_000
) -> DataFrame:
    """The legs of an itinerary as records of at most `legs` legs: entity, chunk (from 0), timed_path.

    A chunk's legs joined to those of the next, in order, are the itinerary's timed_path. The number
    of a leg among an entity's is made from its place in the day and the days' counts, which are short
    rows, so no cell and no window holds an entity's legs.
    """
    counts = readings.groupBy(*TRIP).agg(F.count("*").alias("n"))
    before = Window.partitionBy("entity_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*TRIP, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = itinerary_leg_rows(readings, lookup, spread).alias("r")
    numbered = rows.join(starts.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in TRIP]).select(
        "r.*", (F.col("before") + F.col("pos") - 1).alias("number")
    )
    return (
        numbered.withColumn("chunk", F.floor(F.col("number") / legs))
        .groupBy("entity_id", "chunk")
        .agg(nested("timed_path", "ts", "place", "elapsed", "distance", "speed", "days_to_next", by="number"))
    )


#: A day of an itinerary without the text of its path.
DAILY_TOTALS = [c for c in DAILY if c != "path"]


def itinerary_day_chunks(totals: DataFrame, days: int = 1_000) -> DataFrame:
    """The days of an itinerary, from `trip_totals`, as records of at most `days` days, counters running
    on from chunk to chunk: entity, chunk (from 0), daily_records."""
    order = Window.partitionBy("entity_id").orderBy(*TRIP_ORDER)
    rows = _with_day_counters(totals, False).withColumn("number", F.row_number().over(order) - 1)
    return (
        rows.withColumn("hash", F.col("path_hash"))
        .withColumn("chunk", F.floor(F.col("number") / days))
        .groupBy("entity_id", "chunk")
        .agg(nested("daily_records", *DAILY_TOTALS, by="number"))
    )


ITINERARY = [
    "entity_id",
    "entity_type",
    "total_days",
    "total_time",
    "total_distance",
    "avg_speed",
    "daily_records",
    "timed_path",
    "path",
    "path_hash",
    "start_place",
    "end_place",
    "start_time",
    "end_time",
]


def itinerary(readings: DataFrame, lookup: DataFrame, spread: bool = False) -> DataFrame:
    """One row per entity over all its daily trips."""
    trips = trip_summary(readings, lookup, spread=spread, timed=True)
    days = _with_day_counters(trips, spread, trip_ends(readings))
    members = F.col("members")
    first, last = F.element_at(members, 1), F.element_at(members, -1)

    def record(m: Column) -> Column:
        return F.struct(*(m["path_hash" if c == "hash" else c].alias(c) for c in DAILY))

    def labelled(m: Column) -> Column:
        return F.transform(
            m["timed_path"], lambda leg: leg.withField("days_to_next", m["days_to_next"])
        )

    fields = [c for c in DAILY if c != "hash"]
    return (
        days.groupBy("entity_id")
        .agg(
            F.sum("total_time").alias("total_time"),
            exact_sum(F.col("total_distance")).alias("total_distance"),
            _days_hash(),
            nested(
                "members",
                *fields,
                "path_hash",
                "entity_type",
                "timed_path",
                "days_to_next",
                by="start_time",
            ),
        )
        .select(
            "*",
            last["entity_type"].alias("entity_type"),
            last["day_in_visit"].alias("total_days"),
            speed(F.col("total_distance"), F.col("total_time")).alias("avg_speed"),
            F.transform(members, record).alias("daily_records"),
            F.flatten(F.transform(members, labelled)).alias("timed_path"),
            F.array_join(members["path"], DAY_SEP).alias("path"),
            first["start_place"].alias("start_place"),
            last["end_place"].alias("end_place"),
            first["start_time"].alias("start_time"),
            last["end_time"].alias("end_time"),
        )
        .select(*ITINERARY)
    )


#: An itinerary without records, legs and the text of its path.
ITINERARY_TOTALS = [c for c in ITINERARY if c not in ("daily_records", "timed_path", "path")]


def _days_hash() -> Column:
    """Aggregate: the path hash of an itinerary, from those of its days."""
    return to_int32(F.sum(F.col("path_hash").cast("bigint") * 31)).alias("path_hash")


def itinerary_totals(totals: DataFrame) -> DataFrame:
    """One row per entity over its `trip_totals`: no lists."""
    return (
        _with_day_counters(totals, False)
        .groupBy("entity_id")
        .agg(
            F.max_by("entity_type", "start_time").alias("entity_type"),
            F.sum("days_since").alias("total_days"),
            F.sum("total_time").alias("total_time"),
            exact_sum(F.col("total_distance")).alias("total_distance"),
            F.min_by("start_place", "start_time").alias("start_place"),
            F.max_by("end_place", "start_time").alias("end_place"),
            F.max_by("end_time", "start_time").alias("end_time"),
            F.min("start_time").alias("start_time"),
            _days_hash(),
        )
        .withColumn("avg_speed", speed(F.col("total_distance"), F.col("total_time")))
        .select(*ITINERARY_TOTALS)
    )
