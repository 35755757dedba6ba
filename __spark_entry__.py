"""

Columns are flat, times in unix seconds and dates as text, so that both engines' values can be
compared one by one.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle, stand_in
from tripfold.functions.expressions import iso_time, plain_date, plain_time
from tripfold.operators import repair, trips
from tripfold.operators import visits as visiting
from tripfold.operators.hot import by_heat, hot_entities
from tripfold.operators.prints import count_paths, path_words
from tripfold.plans import journeys
from tripfold.sources.dated import read_days
from tripfold.sources.edges import (
    edge_candidates,
    edge_distance_rows,
    edge_lookup,
    parsed_edges,
    unusable_edges,
    usable_edges,
)
from tripfold.sources.readings import describe_readings, normalise, rejected, with_day_of_week

try:  # the corpus operators are optional, and so is what they import
    import corpus_pipeline
    from tripfold.llm import queries as corpus
except ModuleNotFoundError as missing:
    warnings.warn(f"corpus queries are left out: {missing}", stacklevel=2)
    corpus = corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP_DIR = "/root/testdata/sf0.001"


def _flat(rows: DataFrame) -> DataFrame:
    """Times as unix seconds, dates as text, counts as bigint, nested columns left out."""

    def flat(name: str, kind: str) -> Column:
        column = F.col(name)
        if kind == "timestamp":
            column = F.unix_seconds(column)
        elif kind == "date":
            column = plain_date(column)
        elif kind == "int":
            column = column.cast("bigint")
        return column.alias(name)

    return rows.select(*(flat(n, k) for n, k in rows.dtypes if not k.startswith(("array", "struct"))))


def _per_reading(operator) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stand_in.readings(spark, sf_dir)
        return _flat(by_heat(rows, hot_entities(rows), operator))

    return query


def _per_leg(operator, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stand_in.readings(spark, sf_dir)
        lookup = edge_lookup(stand_in.edges(spark))
        return _flat(
            by_heat(
                rows, hot_entities(rows), lambda r, s: operator(r, lookup, spread=s, **options)
            )
        )

    return query


def _per_entity(plan, then=lambda rows: rows) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stand_in.readings(spark, sf_dir)
        lookup = edge_lookup(stand_in.edges(spark))
        return _flat(then(plan(rows, lookup, hot=hot_entities(rows))))

    return query


def _paths(operator) -> Query:
    return lambda spark, sf_dir: _flat(operator(stand_in.readings(spark, sf_dir)))


def _text(*parts: Column) -> Column:
    return F.concat_ws("@", *parts)


def _timeline_records(readings: DataFrame) -> DataFrame:
    stops = F.transform("timed_path", lambda s: _text(plain_time(s["ts"]), s["place"]))
    return trips.trip_timeline(readings).withColumn("timeline", F.array_join(stops, ";"))


def _timeline_elapsed_records(readings: DataFrame) -> DataFrame:
    stops = F.transform(
        "timed_path",
        lambda s: _text(plain_time(s["ts"]), s["place"], s["elapsed"].cast("string")),
    )
    return trips.trip_timeline_elapsed(readings).withColumn("timeline", F.array_join(stops, ";"))


def _readings_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = describe_readings(normalise(stand_in.raw_readings(spark, sf_dir)))
    return _flat(typed.drop("ts"))


def _readings_dow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(with_day_of_week(stand_in.readings(spark, sf_dir)))


def _edge_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(edge_distance_rows(stand_in.part_edges(spark, sf_dir)))


def _edges_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(unusable_edges(parsed_edges(stand_in.broken_edges(spark, sf_dir))))


def _edges_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(usable_edges(parsed_edges(stand_in.broken_edges(spark, sf_dir))))


def _edge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(edge_candidates(stand_in.part_edges(spark, sf_dir)))


def _entity_path_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stand_in.readings(spark, sf_dir)
    return _flat(journeys.journey_path_rollup(rows, hot_entities(rows)))


def _all_spread(operator) -> Query:
    """Every entity treated as a hot one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lookup = edge_lookup(stand_in.edges(spark))
        return _flat(operator(stand_in.readings(spark, sf_dir), lookup, spread=True))

    return query


def _spread_visits(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    summary, ends = trips.trip_summary(readings, lookup, spread=spread), trips.trip_ends(readings)
    repaired = repair.repair_trips(summary, spread=spread, ends=ends)
    return visiting.visits(repaired, spread=spread, ends=repair.repaired_ends(ends))


def _list_rows(name: str, *keys: str) -> Callable[[DataFrame], DataFrame]:
    """The structs of a nested list as rows, numbered from 1."""

    def rows(records: DataFrame) -> DataFrame:
        each = records.select(*keys, F.posexplode(name).alias("at", "item"))
        return each.select(*keys, (F.col("at") + 1).alias("pos"), "item.*")

    return rows


def _legs_list(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    return _list_rows("timed_path", "entity_id", "date")(trips.trip_legs(readings, lookup, spread))


def _candidates_list(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    records = trips.trip_leg_candidates(readings, lookup, spread)
    legs = _list_rows("timed_path", "entity_id", "date")(records)
    keys = ["entity_id", "date", "pos", "ts", "place", "elapsed"]
    each = legs.select(*keys, F.explode_outer("candidates").alias("way"))
    number = F.expr(f"explode_outer({trips.CANDIDATE_NUMBERS})").alias("candidate")
    return each.select(*keys, number, "way.distance", "way.speed")


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips whose edges come from a supplied table."""
    rows = stand_in.readings(spark, sf_dir)
    lookup = edge_lookup(stand_in.place_edges(spark, sf_dir))
    return _flat(
        by_heat(rows, hot_entities(rows), lambda r, s: trips.trip_summary(r, lookup, spread=s))
    )


def _entity_path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stand_in.readings(spark, sf_dir)
    return _flat(journeys.journey_path_rows(rows, hot_entities(rows)))


def _path_frequency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stand_in.readings(spark, sf_dir)
    return _flat(journeys.journey_path_frequency(rows, hot_entities(rows)))


def _path_frequency_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity treated as a hot one."""
    return _flat(count_paths(path_words(stand_in.readings(spark, sf_dir), spread=True)))


def _shuffled_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = edge_lookup(stand_in.edges(spark), max_bytes=0)
    return _flat(trips.trip_summary(stand_in.readings(spark, sf_dir), lookup))


def _readings_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rejected(stand_in.broken_readings(spark, sf_dir)))


def _visits_export(visits: DataFrame) -> DataFrame:
    """Visits with their times as the JSON sink writes them."""
    return visits.select(
        "entity_id",
        iso_time(F.col("start_time")).alias("start_time"),
        iso_time(F.col("end_time")).alias("end_time"),
        "destination_string",
    )


def _job_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits as the job writes them, from CSV to JSON."""
    folder, _ = stand_in.job_run(spark, sf_dir)
    return spark.read.json(f"{folder}/visits").select(
        "entity_id", "start_time", "end_time", "total_time", "total_distance", "path", "path_hash", "destination_string"
    )


def _job_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired trips as the job writes them, from CSV to JSON."""
    folder, _ = stand_in.job_run(spark, sf_dir)
    return spark.read.json(f"{folder}/trips").select(
        "entity_id", "date", "start_time", "end_time", "total_time", "total_distance", "path", "path_hash", "day_of_week"
    )


def _job_dated_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired trips of some days from the job's table by date."""
    folder, _ = stand_in.job_run(spark, sf_dir)
    return _flat(read_days(spark, f"{folder}/dated", *oracle.SOME_DAYS).select("entity_id", "date", "path", "path_hash"))


def _job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job read, rejected and made."""
    _, counts = stand_in.job_run(spark, sf_dir)
    return spark.createDataFrame(sorted(counts.items()), "what string, n bigint")


def _chunks(plan, name: str, **size) -> Query:
    """Chunks of an entity's records as rows, numbered through."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stand_in.readings(spark, sf_dir)
        chunks = plan(rows, edge_lookup(stand_in.edges(spark)), hot=hot_entities(rows), **size)
        each = chunks.select("entity_id", "chunk", F.posexplode(name).alias("at", "item"))
        number = F.col("chunk") * next(iter(size.values())) + F.col("at") + 1
        return _flat(each.select("entity_id", number.alias("pos"), "item.*"))

    return query


def queries() -> dict[str, Query]:
    found = corpus.queries() | {"pipeline": corpus_pipeline.run} if corpus else {}
    return trip_queries() | found


def trip_queries() -> dict[str, Query]:
    return {
        "readings_normalised": _readings_normalised,
        "readings_dow": _readings_dow,
        "readings_rejected": _readings_rejected,
        "edges_usable": _edges_usable,
        "edges_rejected": _edges_rejected,
        "edge_candidates": _edge_candidates,
        "edge_distances": _edge_distances,
        "trip_timeline": _per_reading(trips.trip_timeline_rows),
        "trip_timeline_records": _paths(_timeline_records),
        "trip_timeline_elapsed": _per_reading(trips.trip_timeline_elapsed_rows),
        "trip_timeline_elapsed_records": _paths(_timeline_elapsed_records),
        "trip_path_array": _per_reading(trips.trip_path_rows),
        "trip_path_string": _paths(trips.trip_path_string),
        "path_frequency": _paths(trips.path_frequency),
        "path_frequency_rows": _path_frequency_rows,
        "path_frequency_spread": _path_frequency_spread,
        "path_signature": _paths(trips.path_signature),
        "trip_legs": _per_leg(trips.trip_leg_rows),
        "trip_legs_records": _per_leg(trips.trip_legs),
        "trip_leg_candidates": _per_leg(trips.trip_leg_candidate_rows),
        "trip_leg_candidates_records": _per_leg(_candidate_records),
        "trip_summary": _per_leg(trips.trip_summary),
        "trip_summary_spread": _all_spread(trips.trip_summary),
        "trip_summary_shuffled_lookup": _shuffled_lookup,
        "trip_summary_closest": _per_leg(trips.trip_summary, pick="closest"),
        "good_trips": _per_leg(_good_trips),
        "stranded_trips": _per_leg(_stranded_trips),
        "stitched_trips": _per_entity(journeys.journey_stitched),
        "repaired_trips": _per_entity(journeys.journey_repaired),
        "visit_candidates": _per_entity(journeys.journey_repaired, visiting.visit_candidates),
        "visits": _per_entity(journeys.journey_visits),
        "visits_spread": _all_spread(_spread_visits),
        "visits_export": _per_entity(journeys.journey_visits, _visits_export),
        "visit_days": _per_entity(journeys.journey_visits, visiting.visit_days),
        "visit_destinations": _per_entity(journeys.journey_visits, visiting.visit_destinations),
        "entity_path_rollup": _entity_path_rollup,
        "itinerary": _per_entity(journeys.journey_itinerary),
        "itinerary_days": _per_entity(journeys.journey_itinerary_days),
        "itinerary_legs": _per_entity(journeys.journey_itinerary_legs),
        "itinerary_timed_path": _per_entity(
            journeys.journey_itinerary, _list_rows("timed_path", "entity_id")
        ),
        "itinerary_daily_records": _per_entity(
            journeys.journey_itinerary, _list_rows("daily_records", "entity_id")
        ),
        "trip_legs_list": _per_leg(_legs_list),
        "trip_leg_candidates_list": _per_leg(_candidates_list),
        "trip_summary_part_edges": _part_edges,
        "trip_totals": _per_entity(journeys.journey_trip_totals),
        "trip_totals_spread": _all_spread(trips.trip_totals),
        "repaired_totals": _per_entity(journeys.journey_repaired_totals),
        "visit_totals": _per_entity(journeys.journey_visit_totals),
        "itinerary_totals": _per_entity(journeys.journey_itinerary_totals),
        "entity_path_rows": _entity_path_rows,
        "itinerary_leg_chunks": _chunks(journeys.journey_itinerary_leg_chunks, "timed_path", legs=7),
        "itinerary_day_chunks": _chunks(journeys.journey_itinerary_day_chunks, "daily_records", days=3),
        "job_visits": _job_visits,
        "job_trips": _job_trips,
        "job_dated_trips": _job_dated_trips,
        "job_counts": _job_counts,
    }


def _candidate_records(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    several = "aggregate(leg.candidates, 0L, (n, c) -> n + c.copies)"
    counts = F.expr(f"transform(timed_path, leg -> string({several}))")
    records = trips.trip_leg_candidates(readings, lookup, spread)
    return records.withColumn("candidate_counts", F.array_join(counts, ";"))


def _good_trips(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    return repair.good_trips(trips.trip_summary(readings, lookup, spread=spread))


def _stranded_trips(readings: DataFrame, lookup: DataFrame, spread: bool) -> DataFrame:
    return repair.stranded_trips(trips.trip_summary(readings, lookup, spread=spread))


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | (corpus.oracle_sql() if corpus else {})


def entry(spark: SparkSession) -> DataFrame:
    """Visits over the smallest test data."""
    return queries()["visits"](spark, FLAGSHIP_DIR)
