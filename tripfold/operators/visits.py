"""Visits: an entity's trips from coming in to going out, over several days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions.expressions import calendar_days, exact_sum, speed
from tripfold.operators.prints import joined_print, print_hash
from tripfold.operators.repair import hash_of_members
from tripfold.operators.segments import add_segment, attach
from tripfold.operators.trips import nested
from tripfold.schema import DAY_SEP, DESTINATION_SEP, PlaceRules

VISIT = [
    "entity_id",
    "entity_type",
    "total_days",
    "total_time",
    "total_distance",
    "avg_speed",
    "daily_records",
    "path",
    "path_hash",
    "start_place",
    "end_place",
    "start_time",
    "end_time",
    "destinations",
    "destination_string",
]

DAILY = [
    "start_place",
    "end_place",
    "days_since",
    "day_in_visit",
    "start_time",
    "end_time",
    "path",
    "hash",
    "total_distance",
    "total_time",
    "avg_speed",
    "day_of_week",
]


def is_visit_candidate(rules: PlaceRules = PlaceRules()) -> Column:
    """A trip that does not both start and end at an outer place; a NULL place is not outer."""

    def outer(place: str) -> Column:
        return F.coalesce(rules.is_outer(F.col(place)), F.lit(False))

    return ~outer("start_place") | ~outer("end_place")


def visit_candidates(trips: DataFrame, rules: PlaceRules = PlaceRules()) -> DataFrame:
    return trips.where(is_visit_candidate(rules))


def ends_visit(rules: PlaceRules = PlaceRules()) -> Column:
    return rules.at_entrance(F.col("end_place")) | rules.at_base(F.col("end_place"))


# A trip's record has its own columns but for these.
_DAYS_SINCE = (
    "bigint(datediff(date(m.start_time), date(element_at(members, greatest(i, 1)).start_time)))"
)
_DAY_IN_VISIT = "bigint(datediff(date(m.start_time), date(members[0].start_time)))"
_RENAMED = {"days_since": _DAYS_SINCE, "day_in_visit": _DAY_IN_VISIT, "hash": "m.path_hash"}
_RECORD = ", ".join(f"{_RENAMED.get(c, 'm.' + c)} AS {c}" for c in DAILY)


_SLIM = ["entity_id", "date", "start_time", "start_place", "end_place"]

_MEMBER = [
    "entity_type",
    "start_place",
    "end_place",
    "start_time",
    "end_time",
    "path",
    "path_rev",
    "path_hash",
    "total_distance",
    "total_time",
    "avg_speed",
    "day_of_week",
]


VISIT_TOTALS = [
    c
    for c in VISIT
    if c not in ("daily_records", "path", "destinations", "destination_string")
]


def visit_totals(totals: DataFrame, rules: PlaceRules = PlaceRules()) -> DataFrame:
    """Visits without their records and the texts of paths, from `repaired_totals`: no lists."""
    keys = ["entity_id", "segment"]
    segments = add_segment(visit_candidates(totals, rules), ["entity_id"], ends_visit(rules))
    segments, prints, path_print = joined_print(segments, keys, "start_time", DAY_SEP)
    whole = (
        segments.groupBy(*keys)
        .agg(
            *prints,
            F.min_by("entity_type", "start_time").alias("entity_type"),
            F.sum("total_time").alias("total_time"),
            exact_sum(F.col("total_distance")).alias("total_distance"),
            F.min_by("start_place", "start_time").alias("start_place"),
            F.max_by("end_place", "start_time").alias("end_place"),
            F.max("start_time").alias("last_start"),
            F.max_by("end_time", "start_time").alias("end_time"),
            F.min("start_time").alias("start_time"),
        )
    )
    return whole.select(
        "*",
        print_hash(path_print).alias("path_hash"),
        calendar_days(F.col("start_time"), F.col("last_start")).alias("total_days"),
        speed(F.col("total_distance"), F.col("total_time")).alias("avg_speed"),
    ).select(*VISIT_TOTALS)


def visits(
    trips: DataFrame,
    rules: PlaceRules = PlaceRules(),
    spread: bool = False,
    ends: DataFrame | None = None,
) -> DataFrame:
    """One row per visit, over repaired trips.

    `ends` (see `repaired_ends`) spares the spread plan a second copy of the trips.

    Trips of a visit may overlap, so its end is that of the trip that starts last. The day
    counters are in calendar days.
    """
    segments = attach(
        visit_candidates(trips, rules),
        ["entity_id", "date"],
        _SLIM,
        lambda t: add_segment(t, ["entity_id"], ends_visit(rules)),
        spread,
        None if ends is None else visit_candidates(ends, rules),
    )
    members = F.col("members")
    first, last = F.element_at(members, 1), F.element_at(members, -1)

    whole = segments.groupBy("entity_id", "segment").agg(
        F.sum("total_time").alias("total_time"),
        exact_sum(F.col("total_distance")).alias("total_distance"),
        nested("members", *_MEMBER, by="start_time"),
    )
    whole = whole.select(
        "*",
        first["entity_type"].alias("entity_type"),
        calendar_days(first["start_time"], last["start_time"]).alias("total_days"),
        speed(F.col("total_distance"), F.col("total_time")).alias("avg_speed"),
        F.expr(f"transform(members, (m, i) -> struct({_RECORD}))").alias("daily_records"),
        F.array_join(members["path"], DAY_SEP).alias("path"),
        F.array_join(members["path_rev"], DAY_SEP).alias("path_rev"),
        first["start_place"].alias("start_place"),
        last["end_place"].alias("end_place"),
        first["start_time"].alias("start_time"),
        last["end_time"].alias("end_time"),
        F.slice(members["end_place"], F.lit(1), F.size(members) - 1).alias("destinations"),
    )
    return whole.select(
        "*",
        hash_of_members(members).alias("path_hash"),
        F.array_join("destinations", DESTINATION_SEP).alias("destination_string"),
    ).select(*VISIT)


def visit_days(visits: DataFrame) -> DataFrame:
    """One row per trip of a visit; the visit is known by entity and start."""
    return visits.select(
        "entity_id",
        F.col("start_time").alias("visit_start"),
        F.posexplode("daily_records").alias("pos", "day"),
    ).select("entity_id", "visit_start", (F.col("pos") + 1).alias("pos"), "day.*")


def visit_destinations(visits: DataFrame) -> DataFrame:
    """One row per destination: the places where the trips of a visit end, but for the last."""
    return visits.select(
        "entity_id",
        F.col("start_time").alias("visit_start"),
        F.posexplode("destinations").alias("pos", "destination"),
    ).withColumn("pos", F.col("pos") + 1)
