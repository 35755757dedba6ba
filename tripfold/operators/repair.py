"""Good and stranded trips, and stitching the stranded ones together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions.expressions import day_of_week, exact_sum, path_hash, round3, speed
from tripfold.operators.prints import joined_print, print_hash
from tripfold.operators.segments import add_segment, attach
from tripfold.operators.trips import TRIP_SUMMARY, TRIP_TOTALS, nested
from tripfold.schema import STOP_SEP, PlaceRules


def is_good(rules: PlaceRules = PlaceRules()) -> Column:
    """A trip that starts and ends at a boundary place, and takes time; not if a place is NULL."""
    good = (
        rules.is_boundary(F.col("start_place"))
        & rules.is_boundary(F.col("end_place"))
        & (F.col("start_time") != F.col("end_time"))
    )
    return F.coalesce(good, F.lit(False))


def good_trips(trips: DataFrame, rules: PlaceRules = PlaceRules()) -> DataFrame:
    return trips.where(is_good(rules))


def stranded_trips(trips: DataFrame, rules: PlaceRules = PlaceRules()) -> DataFrame:
    return trips.where(~is_good(rules))


def ends_stitch(rules: PlaceRules = PlaceRules()) -> Column:
    end, jumped = F.col("end_place"), F.col("prev_end_place") != F.col("start_place")
    return rules.at_entrance(end) | (rules.at_base(end) & jumped)


_MEMBER = [
    "entity_type",
    "date",
    "avg_speed",
    "path",
    "path_rev",
    "path_hash",
    "start_place",
    "end_place",
    "start_time",
    "end_time",
]


def _merged_ends() -> list[Column]:
    return [
        F.min("date").alias("date"),
        F.min("start_time").alias("start_time"),
        F.min_by("start_place", "start_time").alias("start_place"),
        F.max_by("end_place", "start_time").alias("end_place"),
    ]


def hash_of_members(members: Column) -> Column:
    """The hash of `path` and `path_rev`, joined from those of members that have their own."""
    joined = path_hash(F.col("path"), F.col("path_rev"))
    return F.when(F.size(members) == 1, F.element_at(members, 1)["path_hash"]).otherwise(joined)


def _merged(segments: DataFrame, spread: bool, *also: str) -> DataFrame:
    """One record per segment of trips. On the spread plan its ends are aggregates of their own,
    so that a step that needs only them makes no lists there."""
    members = F.col("members")
    first, last = F.element_at(members, 1), F.element_at(members, -1)
    totals = [
        F.sum("total_time").alias("total_time"),
        # Of distances that are rounded already, and rounded again below.
        exact_sum(F.col("total_distance")).alias("distance"),
        nested("members", *_MEMBER, by="start_time"),
    ]
    if spread:
        merged = segments.groupBy("entity_id", *also, "segment").agg(*totals, *_merged_ends())
    else:
        merged = segments.groupBy("entity_id", *also, "segment").agg(*totals)
        merged = merged.select(
            "*",
            *(first[c].alias(c) for c in ("date", "start_time", "start_place")),
            last["end_place"].alias("end_place"),
        )
    return merged.select(
        "*",
        first["entity_type"].alias("entity_type"),
        F.array_join(members["path"], STOP_SEP).alias("path"),
        # The days' reverses in forward order: not the reverse of the whole path.
        F.array_join(members["path_rev"], STOP_SEP).alias("path_rev"),
        day_of_week(F.col("start_time")).alias("day_of_week"),
        last["end_time"].alias("end_time"),
        round3(F.col("distance")).alias("total_distance"),
        speed(F.col("distance"), F.col("total_time")).alias("avg_speed"),
        # A trip that stays alone keeps its path, and so its hash.
    ).withColumn("path_hash", hash_of_members(members))


_SLIM = ["entity_id", "date", "start_time", "start_place", "end_place", "good"]


def _short(ends: DataFrame | None, rules: PlaceRules) -> DataFrame | None:
    return None if ends is None else ends.withColumn("good", is_good(rules)).select(*_SLIM)


def stitched_trips(
    trips: DataFrame,
    rules: PlaceRules = PlaceRules(),
    spread: bool = False,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Stranded trips of an entity, put together into longer ones.

    `ends` (see `trip_ends`) spares the spread plan a second copy of the trips.
    """
    stranded = stranded_trips(trips, rules).withColumn("good", F.lit(False))
    short = None if ends is None else _short(ends, rules).where("NOT good")
    segments = attach(
        stranded,
        ["entity_id", "date"],
        _SLIM,
        lambda t: add_segment(t, ["entity_id"], ends_stitch(rules)),
        spread,
        short,
    )
    return _merged(segments, spread).select(*TRIP_SUMMARY)


def _numbered(trips: DataFrame, rules: PlaceRules) -> DataFrame:
    """Adds `segment`, over trips with `good`; each good trip is a segment of its own."""
    rows = add_segment(trips, ["entity_id", "good"], ends_stitch(rules))
    own = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint")
    return rows.withColumn("segment", F.when(F.col("good"), own).otherwise(F.col("segment")))


def repair_trips(
    trips: DataFrame,
    rules: PlaceRules = PlaceRules(),
    spread: bool = False,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Good trips as they are, and stranded ones stitched.

    One pass over the trips: good and stranded ones are kept apart by a partition key. `ends` (see
    `trip_ends`) spares the spread plan a second copy of the trips.
    """
    marked = trips.withColumn("good", is_good(rules))
    segments = attach(
        marked,
        ["entity_id", "date"],
        _SLIM,
        lambda t: _numbered(t, rules),
        spread,
        _short(ends, rules),
    )
    # A good trip keeps its own average speed, taken from the unrounded distance.
    own_speed = F.element_at("members", 1)["avg_speed"]
    return (
        _merged(segments, spread, "good")
        .withColumn("avg_speed", F.when(F.col("good"), own_speed).otherwise(F.col("avg_speed")))
        .select(*TRIP_SUMMARY)
    )



def repaired_ends(ends: DataFrame, rules: PlaceRules = PlaceRules()) -> DataFrame:
    """One short row per repaired trip, from the `trip_ends` of the daily ones."""
    return (
        _numbered(_short(ends, rules), rules)
        .groupBy("entity_id", "good", "segment")
        .agg(*_merged_ends())
        .drop("good", "segment")
    )


def repaired_totals(totals: DataFrame, rules: PlaceRules = PlaceRules()) -> DataFrame:
    """Repaired trips without the texts of paths, from `trip_totals`: rows are short, there are no lists."""
    keys = ["entity_id", "good", "segment"]
    segments = _numbered(totals.withColumn("good", is_good(rules)), rules)
    segments, prints, path_print = joined_print(segments, keys, "start_time", STOP_SEP)
    merged = segments.groupBy(*keys).agg(
        *_merged_ends(),
        *prints,
        F.min_by("entity_type", "start_time").alias("entity_type"),
        F.max_by("end_time", "start_time").alias("end_time"),
        F.sum("total_time").alias("total_time"),
        exact_sum(F.col("total_distance")).alias("distance"),
        # A good trip is alone, and keeps its speed.
        F.min("avg_speed").alias("own_speed"),
    )
    own, both = F.col("own_speed"), speed(F.col("distance"), F.col("total_time"))
    return merged.select(
        "*",
        round3(F.col("distance")).alias("total_distance"),
        F.when(F.col("good"), own).otherwise(both).alias("avg_speed"),
        day_of_week(F.col("start_time")).alias("day_of_week"),
        path_print.alias("path_print"),
        print_hash(path_print).alias("path_hash"),
    ).select(*TRIP_TOTALS)
