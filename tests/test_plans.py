"""What the physical plans look like."""

import re

import pytest

import __spark_entry__ as contract
from checks import stand_in
from tripfold.plans import journeys

SF_DIR = "/root/testdata/sf0.001"


def final_plan(frame) -> str:
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    return plan.finalPhysicalPlan().treeString() if "Adaptive" in plan.nodeName() else plan.treeString()


def shuffles(plan: str) -> list[str]:
    keys = re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*)\)", plan)
    return [re.sub(r"#\d+L?", "", k).rsplit(",", 1)[0] for k in keys]


@pytest.mark.parametrize("name", list(contract.trip_queries()))
def test_no_python_and_no_nested_loops(spark, name):
    plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Arrow", "CartesianProduct", "NestedLoop", "SinglePartition"):
        assert node not in plan


@pytest.mark.parametrize(
    "name", ["stitched_trips", "repaired_trips", "visits", "visit_days", "itinerary", "itinerary_legs"]
)
def test_one_shuffle_by_entity(spark, name):
    plan = final_plan(contract.queries()[name](spark, SF_DIR))
    assert shuffles(plan) == ["entity_id", "source, target"]
    assert plan.count("BroadcastHashJoin") == 1


@pytest.mark.parametrize(
    "name, keys",
    [
        ("trip_timeline", ["entity_id, date"]),
        ("trip_path_string", ["entity_id, date"]),
        ("trip_summary", ["entity_id, date", "source, target"]),
        ("entity_path_rollup", ["entity_id"]),
    ],
)
def test_one_shuffle_by_trip(spark, name, keys):
    assert shuffles(final_plan(contract.queries()[name](spark, SF_DIR))) == keys


def test_path_counts_are_combined_before_their_shuffle(spark):
    plan = final_plan(contract.queries()["path_frequency"](spark, SF_DIR))
    # A hash of the path text, over partial counts; and the readings by trip.
    assert len(shuffles(plan)) == 2 and shuffles(plan)[1] == "entity_id, date"
    assert "partial_count" in plan


def test_scan_reads_only_what_is_used(spark):
    plan = contract.queries()["visits"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_hot_entities_never_gather_readings_by_entity(spark, lookup):
    rows = stand_in.readings(spark, SF_DIR)
    lines = final_plan(journeys.journey_visits(rows, lookup, hot=[1, 2])).splitlines()
    spread = lines[[n for n, line in enumerate(lines) if "Project" in line and line.startswith("+-")][-1] :]
    moved = [
        (re.sub(r"#\d+L?", "", line), spread[n + 1])
        for n, line in enumerate(spread)
        if re.search(r" Exchange hashpartitioning", line) and "ReusedExchange" not in line
    ]
    assert any("entity_id, date, slice" in line for line, _ in moved)
    by_entity = [
        below
        for line, below in moved
        if re.search(r"hashpartitioning\(entity_id(, good)?, \d", line)
    ]
    assert len(by_entity) == 2
    for below in by_entity:
        # Short rows, one per trip.
        assert "Project" in below and "start_time" in below
        assert not re.search(r"path|members|reading_id", below)


def test_nothing_hot_means_the_plain_plan(spark, lookup):
    rows = stand_in.readings(spark, SF_DIR)
    assert "Union" not in final_plan(journeys.journey_visits(rows, lookup))


@pytest.mark.parametrize("name", ["trip", "repaired", "visit", "itinerary"])
@pytest.mark.parametrize("hot", [[], [1, 2]])
def test_totals_make_no_lists(spark, lookup, name, hot):
    rows = stand_in.readings(spark, SF_DIR)
    plan = final_plan(getattr(journeys, f"journey_{name}_totals")(rows, lookup, hot=hot))
    assert "collect_list" not in plan and "array_join" not in plan


def test_hot_plan_reads_little(spark, lookup):
    """Readings by slice, slices' last readings and trips' ends; edges joined once a branch."""
    rows = stand_in.readings(spark, SF_DIR)
    plan = final_plan(journeys.journey_visits(rows, lookup, hot=[1, 2]))
    # The plain branch reads once.
    assert len(re.findall(r"Scan parquet", plan)) <= 1 + 3
    # A broadcast side that is used again shows as a join only.
    assert len(re.findall(r"HashJoin|SortMergeJoin", plan)) - plan.count("min_distance IS") <= 1 + 4
