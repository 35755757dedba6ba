"""Whole plans, from readings to trips, repaired trips, visits and itineraries.

Each keeps ordinary entities on a single shuffle by entity, and builds the entities named in
`hot` (see `hot_entities`) on the spread plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from tripfold.operators.hot import by_heat
from tripfold.operators.prints import count_paths, path_words
from tripfold.operators.repair import (
    repair_trips,
    repaired_ends,
    repaired_totals,
    stitched_trips,
)
from tripfold.operators.rollups import (
    entity_path_rollup,
    entity_path_rows,
    itinerary,
    itinerary_day_chunks,
    itinerary_days,
    itinerary_leg_chunks,
    itinerary_leg_rows,
    itinerary_totals,
)
from tripfold.operators.trips import trip_ends, trip_summary, trip_totals
from tripfold.operators.visits import visit_totals, visits
from tripfold.schema import PlaceRules


def by_entity(readings: DataFrame, spread: bool) -> DataFrame:
    """Readings placed by entity, so that no later step per entity shuffles again; spread
    readings are left where they are, to be placed by slice of a day."""
    return readings if spread else readings.repartition("entity_id")


def _trips(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    return trip_summary(by_entity(readings, spread), lookup, spread=spread)


def journey_stitched(
    readings: DataFrame,
    lookup: DataFrame,
    rules: PlaceRules = PlaceRules(),
    hot: Sequence[Any] = (),
) -> DataFrame:
    def build(rows: DataFrame, spread: bool) -> DataFrame:
        return stitched_trips(_trips(rows, lookup, spread), rules, spread, trip_ends(rows))

    return by_heat(readings, hot, build)


def journey_repaired(
    readings: DataFrame,
    lookup: DataFrame,
    rules: PlaceRules = PlaceRules(),
    hot: Sequence[Any] = (),
) -> DataFrame:
    def build(rows: DataFrame, spread: bool) -> DataFrame:
        return repair_trips(_trips(rows, lookup, spread), rules, spread, trip_ends(rows))

    return by_heat(readings, hot, build)


def journey_visits(
    readings: DataFrame,
    lookup: DataFrame,
    rules: PlaceRules = PlaceRules(),
    hot: Sequence[Any] = (),
) -> DataFrame:
    def build(rows: DataFrame, spread: bool) -> DataFrame:
        ends = trip_ends(rows)
        repaired = repair_trips(_trips(rows, lookup, spread), rules, spread, ends)
        return visits(repaired, rules, spread, repaired_ends(ends, rules))

    return by_heat(readings, hot, build)


def visits_of(
    repaired: DataFrame, rules: PlaceRules = PlaceRules(), hot: Sequence[Any] = ()
) -> DataFrame:
    """Visits from repaired trips that are there already."""
    return by_heat(repaired, hot, lambda r, spread: visits(r, rules, spread))


def journey_path_rollup(readings: DataFrame, hot: Sequence[Any] = ()) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: entity_path_rollup(by_entity(r, s), not s))


def journey_itinerary(
    readings: DataFrame, lookup: DataFrame, hot: Sequence[Any] = ()
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: itinerary(by_entity(r, s), lookup, s))


def journey_itinerary_days(
    readings: DataFrame, lookup: DataFrame, hot: Sequence[Any] = ()
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: itinerary_days(by_entity(r, s), lookup, s))


def journey_itinerary_legs(
    readings: DataFrame, lookup: DataFrame, hot: Sequence[Any] = ()
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: itinerary_leg_rows(by_entity(r, s), lookup, s))


# Without paths and records. Trips come to the windows as short rows, so hot entities differ only
# in how their readings are ordered.


def _totals(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    return trip_totals(by_entity(readings, spread), lookup, spread=spread)


def journey_trip_totals(
    readings: DataFrame, lookup: DataFrame, hot: Sequence[Any] = ()
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: _totals(r, lookup, s))


def journey_repaired_totals(
    readings: DataFrame,
    lookup: DataFrame,
    rules: PlaceRules = PlaceRules(),
    hot: Sequence[Any] = (),
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: repaired_totals(_totals(r, lookup, s), rules))


def journey_visit_totals(
    readings: DataFrame,
    lookup: DataFrame,
    rules: PlaceRules = PlaceRules(),
    hot: Sequence[Any] = (),
) -> DataFrame:
    def build(rows: DataFrame, spread: bool) -> DataFrame:
        return visit_totals(repaired_totals(_totals(rows, lookup, spread), rules), rules)

    return by_heat(readings, hot, build)


def journey_itinerary_totals(
    readings: DataFrame, lookup: DataFrame, hot: Sequence[Any] = ()
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: itinerary_totals(_totals(r, lookup, s)))


def journey_itinerary_leg_chunks(
    readings: DataFrame, lookup: DataFrame, hot: Sequence[Any] = (), legs: int = 10_000
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: itinerary_leg_chunks(by_entity(r, s), lookup, s, legs))


def journey_itinerary_day_chunks(
    readings: DataFrame, lookup: DataFrame, hot: Sequence[Any] = (), days: int = 1_000
) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: itinerary_day_chunks(_totals(r, lookup, s), days))


def journey_path_rows(readings: DataFrame, hot: Sequence[Any] = ()) -> DataFrame:
    return by_heat(readings, hot, lambda r, s: entity_path_rows(by_entity(r, s), s))


def journey_path_frequency(readings: DataFrame, hot: Sequence[Any] = ()) -> DataFrame:
    """Path counts as a row per word, without a path in one value; see `count_paths`."""
    return count_paths(by_heat(readings, hot, lambda r, s: path_words(by_entity(r, s), s)))
