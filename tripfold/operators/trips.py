"""Daily trips: the readings of one entity on one calendar day.

Operators named *_rows give one row per reading, leg or candidate; they scale to any trip.
Operators named *_records give one row per trip with the list nested in it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.functions.expressions import any_order_sum, day_of_week, path_hash, round3, speed
from tripfold.operators.ordering import READING_ORDER, TRIP, in_order
from tripfold.operators.prints import PATH_SUMS, faced, print_hash, trip_aggregates, with_place_terms
from tripfold.schema import SPEED_LIMIT, STOP_SEP
from tripfold.sources.edges import distance_bin, edge_cells, edge_reach


def nested(name: str, *fields: str, by: str = "pos", descending: bool = False) -> Column:
    """Aggregate: the rows of a group as an array of `fields`, ordered by `by`."""
    row = f"struct({by}, struct({', '.join(fields)}) AS row)"
    return F.expr(f"sort_array(collect_list({row}), {not descending}).row").alias(name)


def last_type(order) -> Column:
    return F.max_by("entity_type", order).alias("entity_type")


# Timelines and paths.


def trip_timeline_rows(readings: DataFrame, spread: bool = False) -> DataFrame:
    return in_order(readings, spread).select(*TRIP, "entity_type", "pos", "ts", "place")


def trip_timeline(readings: DataFrame) -> DataFrame:
    """One row per trip, timed_path holding (ts, place)."""
    return (
        in_order(readings)
        .groupBy(*TRIP)
        .agg(last_type("pos"), nested("timed_path", "ts", "place"))
    )


def trip_timeline_elapsed_rows(readings: DataFrame, spread: bool = False) -> DataFrame:
    """Timeline with the seconds since the previous reading: 0 for the first reading of a
    trip, and after a reading at or before the Unix epoch."""
    since = F.unix_seconds("ts") - F.unix_seconds("prev_ts")
    elapsed = F.when(F.unix_seconds("prev_ts") > 0, since).otherwise(F.lit(0).cast("bigint"))
    return in_order(readings, spread).select(
        *TRIP, "entity_type", "pos", "ts", "place", elapsed.alias("elapsed")
    )


def trip_timeline_elapsed(readings: DataFrame) -> DataFrame:
    """One row per trip, timed_path holding (ts, place, elapsed), latest reading first."""
    return (
        trip_timeline_elapsed_rows(readings)
        .groupBy(*TRIP)
        .agg(
            last_type("pos"),
            (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("total_time"),
            nested("timed_path", "ts", "place", "elapsed", descending=True),
        )
    )


def trip_path_rows(readings: DataFrame, spread: bool = False) -> DataFrame:
    return in_order(readings, spread).select(*TRIP, "entity_type", "pos", "place")


def trip_path_array(readings: DataFrame, placed: bool = False) -> DataFrame:
    """One row per trip, path holding its places in time order.

    Lists do not shrink by being combined before the shuffle, so readings that are not `placed`
    by trip or entity yet are moved first, and grouped once where they arrive.
    """
    visited = F.sort_array(F.collect_list(F.struct(*READING_ORDER, "place")))
    readings = readings if placed else readings.repartition(*TRIP)
    return readings.groupBy(*TRIP).agg(
        last_type(F.struct(*READING_ORDER)), visited["place"].alias("path")
    )


def trip_path_string(readings: DataFrame, placed: bool = False) -> DataFrame:
    return trip_path_array(readings, placed).withColumn("path", F.array_join("path", STOP_SEP))


def _path_both_ways(readings: DataFrame) -> DataFrame:
    return trip_path_array(readings).select(
        *TRIP,
        "entity_type",
        F.array_join("path", STOP_SEP).alias("path"),
        F.array_join(F.reverse("path"), STOP_SEP).alias("path_rev"),
    )


def path_frequency(readings: DataFrame) -> DataFrame:
    """How many trips take a path, in either direction; path is the greater of the two texts."""
    return (
        _path_both_ways(readings)
        .groupBy(F.greatest("path", "path_rev").alias("path"))
        .agg(F.count("*").alias("count"))
    )


def path_signature(readings: DataFrame) -> DataFrame:
    return _path_both_ways(readings).select(
        "*",
        path_hash(F.col("path"), F.col("path_rev")).alias("path_hash"),
        day_of_week(F.col("date")).alias("day_of_week"),
    )


# Legs: a reading together with the way from the one before it.


def _located_legs(
    readings: DataFrame, lookup: DataFrame, spread: bool, sums: Mapping[str, str] | None = None
) -> DataFrame:
    """Ordered readings with elapsed seconds and the lookup's columns for the leg's two ends."""
    elapsed = F.unix_seconds("ts") - F.unix_seconds("prev_ts")
    rows = in_order(readings, spread, sums=sums).withColumn(
        "elapsed", F.coalesce(elapsed, F.lit(0).cast("bigint"))
    )
    ends = (F.col("prev_place") == F.col("source")) & (F.col("place") == F.col("target"))
    return rows.join(lookup, ends, "left")


_LEG = ["pos", "ts", "place", "elapsed"]


def trip_leg_rows(readings: DataFrame, lookup: DataFrame, spread: bool = False) -> DataFrame:
    """Legs with a single distance, the least; 0 where there is no edge."""
    distance = F.coalesce("min_distance", F.lit(0.0))
    return _located_legs(readings, edge_reach(lookup), spread).select(
        *TRIP,
        "entity_type",
        *_LEG,
        distance.alias("distance"),
        speed(distance, F.col("elapsed")).alias("speed"),
    )


def trip_candidate_legs(readings: DataFrame, lookup: DataFrame, spread: bool = False) -> DataFrame:
    """Legs with every candidate (distance, speed, copies, before), by ascending distance.

    Equal candidates are one, with their number and how many come before.
    """
    candidates = F.transform(
        F.coalesce("runs", F.array().cast("array<struct<distance:double,copies:bigint,before:bigint>>")),
        lambda r: F.struct(
            r["distance"].alias("distance"),
            speed(r["distance"], F.col("elapsed")).alias("speed"),
            r["copies"].alias("copies"),
            r["before"].alias("before"),
        ),
    )
    return _located_legs(readings, lookup, spread).select(
        *TRIP, "entity_type", *_LEG, candidates.alias("candidates")
    )


#: The numbers, from 1, of the edges that a candidate `way` stands for; NULL where there is none.
CANDIDATE_NUMBERS = "sequence(way.before + 1, way.before + way.copies)"


def trip_leg_candidate_rows(
    readings: DataFrame, lookup: DataFrame, spread: bool = False
) -> DataFrame:
    """One row per leg and candidate, equal ones written out; a leg without any has one row, with NULLs."""
    ways = trip_candidate_legs(readings, lookup, spread).select(
        *TRIP, "entity_type", *_LEG, F.explode_outer("candidates").alias("way")
    )
    return ways.select(
        *TRIP,
        "entity_type",
        *_LEG,
        F.expr(f"explode_outer({CANDIDATE_NUMBERS})").alias("candidate"),
        "way.distance",
        "way.speed",
    )


def estimated_leg_rows(
    readings: DataFrame,
    lookup: DataFrame,
    pick: str = "lowest",
    limit: float = SPEED_LIMIT,
    spread: bool = False,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Legs with one chosen candidate: the one of the lowest speed, or of the speed closest to
    `limit`. Distance and speed are 0 without a candidate or without elapsed time. `sums` are
    carried along (see `in_order`).

    Within a leg the time is the same for all, so the lowest speed is the least distance.
    """
    if pick not in ("lowest", "closest"):
        raise ValueError(f"pick must be 'lowest' or 'closest', not {pick!r}")
    legs = _located_legs(readings, edge_reach(lookup), spread, sums)
    if pick == "lowest":
        chosen = F.col("min_distance")
    else:
        legs, chosen = _nearest(legs, lookup, limit)
    distance = F.when(F.col("elapsed") > 0, F.coalesce(chosen, F.lit(0.0))).otherwise(F.lit(0.0))
    return legs.withColumn("distance", distance).select(
        *TRIP,
        "entity_type",
        *_LEG,
        "distance",
        F.coalesce(speed(F.col("distance"), F.col("elapsed")), F.lit(0.0)).alias("speed"),
        *(f"{name}_{part}" for name in sums or () for part in ("before", "total")),
    )


def _nearest(legs: DataFrame, lookup: DataFrame, limit: float) -> tuple[DataFrame, Column]:
    """Legs joined to the distance whose speed is nearest to `limit`, and that distance as a column.

    The wanted distance (limit times elapsed) falls into one cell of its pair, and the leg meets the
    cells of its bin only: no list of distances travels with a leg. The speeds of the cell's distance
    and its two neighbours decide, the lesser distance on a tie.
    """
    wanted = F.lit(limit) * F.col("elapsed") / 3600
    legs = legs.withColumn("wanted", F.when(F.col("elapsed") > 0, wanted)).withColumn(
        "wanted_bin", distance_bin(F.col("wanted"), F.col("min_distance"), F.col("max_distance"), F.col("n_distances"))
    )
    cells = edge_cells(lookup).select(
        F.col("source").alias("cell_source"),
        F.col("target").alias("cell_target"),
        "bin",
        "from",
        "to",
        *(F.col(c).alias(f"cell_{c}") for c in ("lower", "distance", "upper")),
    )
    inside = (
        (F.col("prev_place") == F.col("cell_source"))
        & (F.col("place") == F.col("cell_target"))
        & (F.col("wanted_bin") == F.col("bin"))
        & (F.col("wanted") >= F.col("from"))
        & (F.col("wanted") < F.col("to"))
    )

    def off(side: str) -> Column:
        d = F.col(f"cell_{side}")
        return F.when(d.isNotNull(), F.struct(F.abs(speed(d, F.col("elapsed")) - limit).alias("off"), d.alias("distance")))

    best = F.least(off("lower"), off("distance"), off("upper"))
    return legs.join(cells, inside, "left"), best["distance"]


# Whole trips.


def _ends(*order: str) -> list[Column]:
    """Aggregates: a trip's ends, from its readings in any order."""
    place = F.struct(*order)
    return [
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.min_by("place", place).alias("start_place"),
        F.max_by("place", place).alias("end_place"),
        F.max_by("entity_type", place).alias("entity_type"),
    ]


def trip_ends(readings: DataFrame) -> DataFrame:
    """One short row per trip, combined before its shuffle: no order, distances or lists."""
    return readings.groupBy(*TRIP).agg(*_ends(*READING_ORDER))


def _trips_of(legs: DataFrame, stop: list[str], spread: bool, *more: Column) -> DataFrame:
    """One row per trip: stops as structs of at least `stop`, what derives from them, and `more`.

    A single list is the cheapest aggregate that gives everything. On the spread plan the ends
    are aggregates of their own, so that a step that needs only them makes no lists there.
    """
    stops = F.col("stops")
    fields = list(dict.fromkeys([*stop, "place", "ts", *([] if spread else ["entity_type"])]))
    first, last = F.element_at(stops, 1), F.element_at(stops, -1)
    if spread:
        trips = legs.groupBy(*TRIP).agg(nested("stops", *fields), *_ends("pos"), *more)
    else:
        trips = legs.groupBy(*TRIP).agg(nested("stops", *fields), *more)
        trips = trips.select(
            "*",
            first["ts"].alias("start_time"),
            last["ts"].alias("end_time"),
            first["place"].alias("start_place"),
            last["place"].alias("end_place"),
            last["entity_type"].alias("entity_type"),
        )
    return trips.select(
        "*",
        (F.unix_seconds("end_time") - F.unix_seconds("start_time")).alias("total_time"),
        F.array_join(stops["place"], STOP_SEP).alias("path"),
        F.array_join(F.reverse(stops["place"]), STOP_SEP).alias("path_rev"),
        day_of_week(F.col("date")).alias("day_of_week"),
    ).withColumn("path_hash", path_hash(F.col("path"), F.col("path_rev")))


def _timed_path(*fields: str) -> Column:
    """The stops with `fields` only."""
    row = ", ".join(f"s.{field} AS {field}" for field in fields)
    return F.expr(f"transform(stops, s -> struct({row}))").alias("timed_path")


def _trip_records(legs: DataFrame, spread: bool, *leg_fields: str) -> DataFrame:
    return _trips_of(legs, list(leg_fields), spread).select(
        *TRIP,
        "entity_type",
        "total_time",
        _timed_path(*leg_fields),
        "path",
        "path_rev",
        "path_hash",
        "day_of_week",
    )


def trip_legs(readings: DataFrame, lookup: DataFrame, spread: bool = False) -> DataFrame:
    """One row per trip, timed_path holding (ts, place, elapsed, distance, speed)."""
    rows = trip_leg_rows(readings, lookup, spread)
    return _trip_records(rows, spread, "ts", "place", "elapsed", "distance", "speed")


def trip_leg_candidates(readings: DataFrame, lookup: DataFrame, spread: bool = False) -> DataFrame:
    """One row per trip, timed_path holding (ts, place, elapsed, candidates).

    A candidate is (distance, speed, copies, before); see `trip_candidate_legs`.
    """
    rows = trip_candidate_legs(readings, lookup, spread)
    return _trip_records(rows, spread, "ts", "place", "elapsed", "candidates")


TRIP_SUMMARY = [
    "entity_id",
    "entity_type",
    "date",
    "total_time",
    "total_distance",
    "avg_speed",
    "path",
    "path_rev",
    "path_hash",
    "day_of_week",
    "start_place",
    "end_place",
    "start_time",
    "end_time",
]


def trip_summary(
    readings: DataFrame,
    lookup: DataFrame,
    pick: str = "lowest",
    limit: float = SPEED_LIMIT,
    spread: bool = False,
    timed: bool = False,
) -> DataFrame:
    """One row per trip with its totals, path, ends; with `timed` also its chosen legs."""
    stop = ["ts", "place", "elapsed", "distance", "speed"] if timed else []
    legs = estimated_leg_rows(readings, lookup, pick, limit, spread)
    trips = _trips_of(legs, stop, spread, any_order_sum(F.col("distance")).alias("distance")).select(
        "*",
        round3(F.col("distance")).alias("total_distance"),
        speed(F.col("distance"), F.col("total_time")).alias("avg_speed"),
    )
    return trips.select(*TRIP_SUMMARY, *([_timed_path(*stop)] if timed else []))


#: A trip without the texts of its path; path_print is what longer paths' hashes are made of.
TRIP_TOTALS = [*(c for c in TRIP_SUMMARY if c not in ("path", "path_rev")), "path_print"]


def trip_totals(
    readings: DataFrame,
    lookup: DataFrame,
    pick: str = "lowest",
    limit: float = SPEED_LIMIT,
    spread: bool = False,
) -> DataFrame:
    """Trips with their times, distances, ends and path hash, from sums and least values: no lists."""
    legs = estimated_leg_rows(readings, lookup, pick, limit, spread, PATH_SUMS)
    exact = F.when(F.col("face.own"), F.col("distance").cast("decimal(38,18)"))
    pairs = [
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.min(F.struct("pos", "place")).alias("first_stop"),
        F.max(F.struct("pos", "place", "entity_type")).alias("last_stop"),
        F.sum(exact).alias("exact"),
    ]
    whole = [
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.min("first_stop").alias("first_stop"),
        F.max("last_stop").alias("last_stop"),
        F.sum("exact").cast("double").alias("distance"),
    ]
    trips = trip_aggregates(faced(with_place_terms(legs)), pairs, whole)
    seconds = F.unix_seconds("end_time") - F.unix_seconds("start_time")
    return trips.withColumn("total_time", seconds).select(
        *TRIP,
        "last_stop.entity_type",
        "total_time",
        round3(F.col("distance")).alias("total_distance"),
        speed(F.col("distance"), F.col("total_time")).alias("avg_speed"),
        day_of_week(F.col("date")).alias("day_of_week"),
        F.col("first_stop.place").alias("start_place"),
        F.col("last_stop.place").alias("end_place"),
        "start_time",
        "end_time",
        print_hash(F.col("path_print")).alias("path_hash"),
        "path_print",
    ).select(*TRIP_TOTALS)
