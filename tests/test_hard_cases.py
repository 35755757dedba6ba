"""NULLs, odd distances and plans: what must not depend on the size of the input."""

import json

import pytest
from pyspark.sql import functions as F

from tests.data import edge_list, random_readings, readings_frame
from tripfold.functions.expressions import text_hash
from tripfold.operators.hot import by_heat, hot_entities
from tripfold.operators.repair import good_trips, stranded_trips
from tripfold.operators.trips import path_signature, trip_summary
from tripfold.plans import journeys
from tripfold.plans.job import run
from tripfold.plans.journeys import journey_visits
from tripfold.schema import HotRule
from tripfold.sources.edges import edge_candidates, edge_lookup, read_edges, rejected_edges
from tripfold.sources.readings import read_raw_readings, read_readings, rejected


def odd_edges(spark):
    rows = [(s, t, d / 3 + 0.1) for s, t, d in edge_list()]
    return spark.createDataFrame(rows, "source string, target string, distance double")


def odd_readings(spark):
    rows = readings_frame(spark, random_readings(21, 40))
    n = F.pmod(F.xxhash64("reading_id"), F.lit(10))
    return rows.withColumn("place", F.when(n > 0, F.col("place"))).withColumn(
        "entity_id", F.when(n != 1, F.col("entity_id"))
    )


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def test_rows_without_entity_stay_whatever_is_hot(spark):
    readings = odd_readings(spark)
    hot = readings.where("entity_id IS NOT NULL").first().entity_id
    kept = by_heat(readings, [hot], lambda r, spread: r)
    assert kept.count() == readings.count()
    nameless = readings.withColumn("entity_id", F.lit(None).cast("bigint"))
    assert hot_entities(nameless, HotRule(buckets=16, min_rows=1)) == []


def test_plain_and_spread_plans_give_equal_values(spark):
    readings = odd_readings(spark).where("entity_id IS NOT NULL")
    lookup = edge_lookup(odd_edges(spark))
    plain = rows_of(trip_summary(readings, lookup))
    assert plain == rows_of(trip_summary(readings, lookup, spread=True))
    assert plain == rows_of(trip_summary(readings, edge_lookup(odd_edges(spark), max_bytes=0)))


@pytest.mark.parametrize("name", ["trip", "repaired", "visit", "itinerary"])
def test_totals_are_equal_whatever_is_hot(spark, name):
    readings = odd_readings(spark)
    lookup = edge_lookup(odd_edges(spark))
    build = getattr(journeys, f"journey_{name}_totals")
    plain = build(readings, lookup)
    hot = [r.entity_id for r in readings.where("entity_id IS NOT NULL").select("entity_id").distinct().take(3)]
    assert rows_of(plain) == rows_of(build(readings, lookup, hot=hot))


def test_a_null_place_keeps_a_trip_stranded(spark):
    trips = trip_summary(odd_readings(spark), edge_lookup(odd_edges(spark)))
    assert good_trips(trips).count() + stranded_trips(trips).count() == trips.count()


def test_null_distances_are_no_candidates(spark):
    edges = spark.createDataFrame(
        [("a", "b", None), ("a", "b", 2.0), ("a", "b", 3.0)],
        "source string, target string, distance double",
    )
    assert sorted(r.distance for r in edge_candidates(edges).collect()) == [2.0, 3.0]


def test_text_hash_is_the_jvms(spark):
    texts = ["", "a", "entrance1:gate3", "ñandú", "日本", "🎉x🎉", "a" * 1000]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.h for r in frame.select("t", text_hash(F.col("t")).alias("h")).collect()}
    jvm = spark.sparkContext._jvm.java.util.Objects
    assert got == {t: jvm.hashCode(t) for t in texts} | {None: None}


@pytest.mark.parametrize("what", ["entity_id = 3", "date = DATE'2015-05-02'"])
def test_filters_pass_the_path_hash(spark, tmp_path, what):
    readings_frame(spark, random_readings(3, 10)).write.parquet(str(tmp_path / "r"))
    readings = spark.read.parquet(str(tmp_path / "r"))
    for frame in (path_signature(readings), trip_summary(readings, edge_lookup(odd_edges(spark)))):
        plan = frame.where(what)._jdf.queryExecution().optimizedPlan().toString()
        filters = [i for i, line in enumerate(plan.split("\n")) if "Filter" in line]
        grouped = [i for i, line in enumerate(plan.split("\n")) if "Aggregate" in line]
        assert filters and grouped and filters[-1] > grouped[0]


def test_visits_push_an_entity_to_the_scan(spark, tmp_path):
    readings_frame(spark, random_readings(3, 10)).write.parquet(str(tmp_path / "r"))
    visits = journey_visits(spark.read.parquet(str(tmp_path / "r")), edge_lookup(odd_edges(spark)))
    plan = visits.where("entity_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(entity_id,3)" in plan


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "extra,gate-name,Timestamp,car-type,car-id\nx,entrance3,2015-05-01 00:43:28,4,17\n"
    )
    (tmp_path / "e.csv").write_text("id,distance,source,target\n1,2.5,a,b\n2,far,a,c\n3,,a,d\n")
    row = read_readings(spark, str(tmp_path / "r.csv")).first()
    assert (row.entity_id, row.entity_type, row.place) == ("17", "4", "entrance3")
    edges = read_edges(spark, str(tmp_path / "e.csv"))
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 2.5)]
    lost = rejected_edges(spark, str(tmp_path / "e.csv")).collect()
    assert sorted((r.target, r.distance_text) for r in lost) == [("c", "far"), ("d", None)]


def test_a_missing_column_fails(spark, tmp_path):
    (tmp_path / "e.csv").write_text("from,target,distance\na,b,1\n")
    with pytest.raises(ValueError, match="source"):
        read_edges(spark, str(tmp_path / "e.csv"))


def test_strict_ingest_fails_whatever_is_asked(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Timestamp,car-id,car-type,gate-name\nnever,1,4,gate8\n")
    rows = read_readings(spark, str(tmp_path / "r.csv"), strict=True)
    for ask in (lambda: rows.count(), lambda: rows.groupBy("place").count().collect()):
        with pytest.raises(Exception, match="unusable reading"):
            ask()


def test_the_job_writes_and_counts_rejects(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "Timestamp,car-id,car-type,gate-name\n2015-05-01 00:43:28,1,4,gate8\nnever,1,4,gate8\n"
    )
    (tmp_path / "e.csv").write_text("source,target,distance\na,b,NaN\n")
    counts = run(spark, str(tmp_path / "r.csv"), str(tmp_path / "e.csv"), str(tmp_path / "v"), str(tmp_path / "t"))
    assert counts == {
        "readings": 1, "rejected_readings": 1, "edges": 0, "rejected_edges": 1, "repaired_trips": 1, "visits": 1
    }
    kept = spark.read.parquet(str(tmp_path / "v.work" / "readings")).where("status = 'rejected'")
    assert [r.reason for r in kept.collect()] == ["unreadable time"]
    assert rejected(read_raw_readings(spark, str(tmp_path / "r.csv"))).count() == 1
    trips = [json.loads(x) for f in (tmp_path / "t").glob("*.json") for x in f.read_text().splitlines()]
    assert len(trips) == 1 and trips[0]["avg_speed"] is None
