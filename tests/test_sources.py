"""Ingest, edges, sinks and the batch job."""

import json
from datetime import datetime

import pytest

from tests import fold
from tests.data import edge_list, random_readings, readings_frame
from tripfold.operators.trips import trip_summary
from tripfold.plans.job import run
from tripfold.sinks.files import write_json, write_parquet
from tripfold.sources.edges import edge_candidates, edge_distance_rows, edge_distances, edge_lookup, read_edges
from tripfold.sources.readings import (
    describe_readings,
    normalise,
    read_raw_readings,
    read_readings,
    rejected,
    with_day_of_week,
)

HEADER = "Timestamp,car-id,car-type,gate-name\n"


@pytest.fixture
def readings_csv(tmp_path):
    path = tmp_path / "readings.csv"
    path.write_text(
        HEADER
        + "2015-05-01 00:43:28,20154301,4,entrance3\n"
        + "2015-05-01T01:03:48Z,20154301,4,general-gate1\n"
        + "1 May 2015,20154301,4,gate8\n"
        + ",20154301,4,gate8\n"
        + "2015-05-01 01:10:00,,4,gate8\n"
        + "2015-05-01 01:10:00,20154301,4,\n"
    )
    return str(path)


def test_normalise(spark, readings_csv):
    rows = describe_readings(with_day_of_week(read_readings(spark, readings_csv)))
    first, second = rows.orderBy("ts").collect()
    assert first.entity_id == "20154301" and first.entity_type == "4"
    assert first.place == "entrance3" and first.ts == datetime(2015, 5, 1, 0, 43, 28)
    assert first.unix_time == 1430441008 and first.datetime == "2015-05-01 00:43:28"
    assert first.day_of_week == "friday" and str(first.date) == "2015-05-01"
    assert second.ts == datetime(2015, 5, 1, 1, 3, 48)


def test_rejects_are_listed(spark, readings_csv):
    raw = read_raw_readings(spark, readings_csv)
    reasons = sorted(r.reason for r in rejected(raw).collect())
    assert reasons == ["no entity", "no place", "unreadable time", "unreadable time"]
    assert normalise(raw).count() + rejected(raw).count() == raw.count()


def test_strict_ingest_fails(spark, readings_csv):
    with pytest.raises(Exception, match="unusable reading"):
        read_readings(spark, readings_csv, strict=True).collect()


def test_reading_id_is_stable(spark, readings_csv):
    ids = [
        {r.reading_id for r in read_readings(spark, readings_csv).repartition(n).collect()}
        for n in (1, 3)
    ]
    assert ids[0] == ids[1] and len(ids[0]) == 2


def test_edges(spark, tmp_path):
    path = tmp_path / "edges.csv"
    path.write_text("source,target,distance\na,b,2.5\nb,a,1\na,b,0.5\na,b,2.5\n")
    edges = read_edges(spark, str(path))
    got = {(r.source, r.target): ([tuple(run) for run in r.runs], r.min_distance) for r in edge_distances(edges).collect()}
    assert got == {("a", "b"): ([(0.5, 1, 0), (2.5, 2, 1)], 0.5), ("b", "a"): ([(1.0, 1, 0)], 1.0)}
    each = sorted((r.source, r.pos, r.distance) for r in edge_distance_rows(edges).collect())
    assert each == [("a", 0, 0.5), ("a", 1, 2.5), ("a", 2, 2.5), ("b", 0, 1.0)]
    copies = {(r.source, r.distance): r.copies for r in edge_candidates(edges).collect()}
    assert copies == {("a", 0.5): 1, ("a", 2.5): 2, ("b", 1.0): 1}


def test_large_edge_tables_are_not_broadcast(spark):
    rows = random_readings(5, 10)
    edges = spark.createDataFrame(edge_list(), "source string, target string, distance double")
    readings = readings_frame(spark, rows)
    small = trip_summary(readings, edge_lookup(edges))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = trip_summary(readings, edge_lookup(edges, max_bytes=10))
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        got = sorted(map(tuple, large.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == sorted(map(tuple, small.collect()))


def write_csv(path, header, rows):
    path.write_text(header + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def test_job(spark, tmp_path):
    rows = random_readings(11, 25)
    rows = [(n, f"car{r[1]}", r[2], r[3], r[4]) for n, r in enumerate(rows)]
    # Readings of a file have no id of their own, so equal times would be a matter of taste.
    rows = list({(r[1], r[3]): r for r in rows}.values())
    readings = write_csv(tmp_path / "r.csv", HEADER, [(r[3], r[1], r[2], r[4]) for r in rows])
    edges = write_csv(tmp_path / "e.csv", "source,target,distance\n", edge_list())
    run(spark, readings, edges, str(tmp_path / "visits"), str(tmp_path / "trips"), single_file=True)

    summary = fold.summary(rows, fold.multimap(edge_list()))
    want = fold.visits(fold.repaired(summary))
    files = list((tmp_path / "visits").glob("*.json"))
    assert len(files) == 1
    got = [json.loads(line) for line in files[0].read_text().splitlines()]

    def iso(t):
        return t.strftime("%Y-%m-%dT%H:%M:%SZ")

    assert {
        (v["entity_id"], v["start_time"], v["end_time"], v["path_hash"], v["destination_string"])
        for v in got
    } == {
        (v["entity_id"], iso(v["start_time"]), iso(v["end_time"]), v["path_hash"],
         v["destination_string"])
        for v in want
    }
    assert len(got) == len(want)
    assert all(d["start_time"].endswith("Z") for v in got for d in v["daily_records"])
    trips = spark.read.json(str(tmp_path / "trips"))
    assert trips.count() == len(fold.repaired(summary))


def test_sinks_do_not_overwrite(spark, tmp_path):
    rows = spark.range(3)
    write_json(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        write_json(rows, str(tmp_path / "out"))


def test_partitioned_trips_prune(spark, tmp_path, lookup):
    trips = trip_summary(readings_frame(spark, random_readings(2, 8)), lookup)
    write_parquet(trips, str(tmp_path / "trips"), partition_by=["date"])
    back = spark.read.parquet(str(tmp_path / "trips"))
    day = back.first().date
    one_day = back.where(back.date == day)
    assert "PartitionFilters: [isnotnull(date" in one_day._jdf.queryExecution().toString()
    assert one_day.count() == trips.where(trips.date == day).count() > 0
