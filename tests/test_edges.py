"""Edges as runs, the nearest of many distances, and distances that are none."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import fold
from tests.data import readings_frame
from tripfold.operators import trips
from tripfold.operators.visits import is_visit_candidate
from tripfold.sources.edges import (
    edge_cells,
    edge_distances,
    edge_lookup,
    read_edges,
    rejected_edges,
    store_edges,
    stored_edges,
)

EDGES = "source string, target string, distance double"


def two_places(n: int, seed: int = 4) -> list[tuple]:
    rng, time, rows = random.Random(seed), datetime(2015, 5, 1), []
    for i in range(n):
        rows.append((i, i % 7, "t", time, rng.choice(["gate1", "gate3"])))
        time += timedelta(seconds=rng.choice([0, 1, 3, 60, 400]))
    return rows


def leg_distances(spark, rows, edges, **options):
    lookup = edge_lookup(spark.createDataFrame(edges, EDGES))
    legs = trips.estimated_leg_rows(readings_frame(spark, rows), lookup, pick="closest", **options)
    return {(r.entity_id, r.date, r.pos): r.distance for r in legs.collect()}


def best_distances(rows, edges):
    found = {}
    for (entity, date), own in fold.by_trip(rows).items():
        for pos, leg in enumerate(fold.legs(own, fold.multimap(edges), "closest")):
            found[entity, date, pos + 1] = leg[3]
    return found


def test_nearest_of_many_distances(spark):
    rng = random.Random(3)
    some = sorted({round(rng.uniform(0, 5), 3) for _ in range(400)})
    crowded = [1 + i / 1e6 for i in range(300)]
    edges = [("gate1", "gate3", d) for d in some] + [("gate3", "gate1", d) for d in (*crowded, 900.0, -3.0)]
    edges += [("gate1", "gate1", 2.0)] * 5
    rows = two_places(600)
    assert leg_distances(spark, rows, edges) == best_distances(rows, edges)


@pytest.mark.parametrize("distances", [[7.0], [0.0, 0.0], [1.0, 3.0], [0.0, 1e9]])
def test_nearest_of_few_distances(spark, distances):
    edges = [("gate1", "gate3", d) for d in distances]
    rows = two_places(80, 5)
    assert leg_distances(spark, rows, edges) == best_distances(rows, edges)


def test_a_pair_of_100_000_distances(spark):
    """Legs meet a bin of a few cells, and no list travels with them."""
    rows = two_places(300, 6)
    many = spark.range(100_000).select(
        F.lit("gate1").alias("source"), F.lit("gate3").alias("target"), (F.col("id") / 30_000).alias("distance")
    )
    lookup = edge_lookup(many)
    cells = edge_cells(lookup).groupBy("bin").count()
    assert cells.agg(F.max("count")).first()[0] <= 4 and cells.agg(F.sum("count")).first()[0] <= 200_000
    legs = trips.estimated_leg_rows(readings_frame(spark, rows), lookup, pick="closest")
    got = {(r.entity_id, r.date, r.pos): r.distance for r in legs.collect()}
    for (entity, date), own in fold.by_trip(rows).items():
        for pos, (before, row) in enumerate(zip(own, own[1:]), 2):
            elapsed = (row[3] - before[3]).total_seconds()
            on_way = (before[4], row[4]) == ("gate1", "gate3") and elapsed > 0
            want = min(25 * elapsed / 3600, 99_999 / 30_000) if on_way else 0.0
            assert abs(got[entity, date, pos] - want) <= (0.5000001 / 30_000 if on_way else 0)
    plan = legs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [line for line in plan if "Join " in line]
    outputs = legs._jdf.queryExecution().optimizedPlan().output().mkString(",")
    assert len(joins) == 2 and "runs" not in outputs


def test_equal_edges_are_a_count(spark):
    """Ten million equal edges are one run; written out only as rows."""
    many = spark.range(10_000_000).select(F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit(2.5).alias("distance"))
    row = edge_distances(many).first()
    assert [tuple(r) for r in row.runs] == [(2.5, 10_000_000, 0)]
    legs = trips.trip_candidate_legs(
        readings_frame(spark, [(1, 1, "t", datetime(2015, 5, 1, 1), "a"), (2, 1, "t", datetime(2015, 5, 1, 2), "b")]),
        edge_distances(many),
    )
    assert [len(r.candidates) for r in legs.orderBy("pos").collect()] == [0, 1]


def test_distances_that_are_none(spark, tmp_path):
    texts = ["1.5", "NaN", "Infinity", "-Infinity", "1e21", "-1e10", "far", "", "-2", "0", "1e9"]
    (tmp_path / "e.csv").write_text("source,target,distance\n" + "".join(f"a,b{i},{t}\n" for i, t in enumerate(texts)))
    assert sorted(r.distance for r in read_edges(spark, str(tmp_path / "e.csv")).collect()) == [-2.0, 0.0, 1.5, 1e9]
    reasons = {r.distance_text: r.reason for r in rejected_edges(spark, str(tmp_path / "e.csv")).collect()}
    assert reasons == {
        "NaN": "distance not finite", "Infinity": "distance not finite", "-Infinity": "distance not finite",
        "1e21": "distance out of range", "-1e10": "distance out of range", "far": "unreadable distance",
        None: "unreadable distance",
    }


def test_many_of_the_largest_distances(spark):
    """More than a number of 64 bits holds in millionths."""
    time = datetime(2015, 5, 1)
    rows = [(i, 1, "t", time + timedelta(seconds=i), ["x", "y"][i % 2]) for i in range(12_001)]
    lookup = edge_lookup(spark.createDataFrame([("x", "y", 1e9), ("y", "x", 1e9)], EDGES))
    totals = trips.trip_totals(readings_frame(spark, rows), lookup)
    from tripfold.operators.repair import repaired_totals

    (row,) = repaired_totals(totals).collect()
    assert row.total_distance == 12_000 * 1e9


def test_a_null_place_is_not_outer(spark):
    rows = spark.createDataFrame(
        [(None, "entrance1"), ("entrance1", None), (None, None), ("entrance1", "entrance2"), ("gate1", None)],
        "start_place string, end_place string",
    )
    assert [r.c for r in rows.select(is_visit_candidate().alias("c")).collect()] == [True, True, True, False, True]


def test_stored_edges_do_not_move(spark, tmp_path):
    rng = random.Random(5)
    edges = [(rng.choice("ab") + str(i % 40), "gate3", rng.uniform(0, 9)) for i in range(500)]
    edges += [("gate1", "gate3", 1.5), ("gate3", "gate1", 0.5), ("gate1", "gate3", 1.5)]
    frame = spark.createDataFrame(edges, EDGES)
    store_edges(frame, "some_edges", 8, str(tmp_path / "edges"))
    readings = readings_frame(spark, two_places(200))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (trips.trip_summary, trips.trip_totals):
            kept = make(readings, stored_edges(spark, "some_edges"))
            plan = kept._jdf.queryExecution().executedPlan().toString()
            # The legs go to the edges: no shuffle has the edges' columns.
            assert "SortMergeJoin" in plan and "hashpartitioning(prev_place" in plan
            assert "hashpartitioning(source" not in plan
            assert sorted(map(repr, kept.collect())) == sorted(map(repr, make(readings, edge_lookup(frame)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE some_edges")
