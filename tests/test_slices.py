"""Order within an entity-day whose readings crowd into one second."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.data import edge_list, readings_frame
from tests.test_hard_cases import rows_of
from tripfold.operators.ordering import in_order, placed_in_slices
from tripfold.operators.prints import PATH_SUMS
from tripfold.operators.trips import trip_summary, trip_totals
from tripfold.session import shared_folder
from tripfold.sources.edges import edge_lookup


def one_second(n: int = 20_000) -> list[tuple]:
    """All readings of an entity in a second, and a few of others around it."""
    rng, time = random.Random(2), datetime(2015, 5, 1, 12)
    rows = [(i, 1, "t", time, rng.choice(["gate1", "gate3", "camping2"])) for i in range(n)]
    rng.shuffle(rows)
    return [*rows, (n, 1, "t", datetime(2015, 5, 1, 11), "gate1"), (n + 1, 1, "t", datetime(2015, 5, 1, 13), "gate3"),
            (n + 2, 2, "t", time, "gate1")]


def test_a_second_is_cut_into_slices_of_like_size(spark):
    placed = placed_in_slices(readings_frame(spark, one_second()))
    sizes = [r["count"] for r in placed.groupBy("slice").count().collect()]
    # Small ranges are put together, none holds more than its part.
    assert len(sizes) > 2 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_order_in_slices_is_the_plain_order(spark):
    readings = readings_frame(spark, one_second(3_000))
    assert rows_of(in_order(readings, True, PATH_SUMS)) == rows_of(in_order(readings, False, PATH_SUMS))


def test_equal_readings_are_cut_as_well(spark):
    """Readings that tie in time and id are interchangeable, and still go to several tasks."""
    rows = [(7, 1, "t", datetime(2015, 5, 1, 12), "gate1")] * 9_000
    readings = readings_frame(spark, rows)
    # Ranges this small would be put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in placed_in_slices(readings).groupBy("slice").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * 9_000 / len(sizes)
    found = in_order(readings, True).agg(F.count_distinct("pos"), F.max("pos"), F.count_if(F.col("prev_place").isNull())).first()
    assert tuple(found) == (9_000, 9_000, 1)


@pytest.mark.parametrize("make", [trip_summary, trip_totals])
def test_trips_of_a_crowded_second(spark, make):
    lookup = edge_lookup(spark.createDataFrame(edge_list(), "source string, target string, distance double"))
    readings = readings_frame(spark, one_second(3_000))
    assert rows_of(make(readings, lookup, spread=True)) == rows_of(make(readings, lookup))


def test_a_cluster_must_name_its_shared_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere)
