"""Hand-computed cases."""

import itertools
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests import fold
from tests.data import trip_rows
from tripfold.functions import expressions as X
from tripfold.operators.repair import ends_stitch, is_good, repair_trips
from tripfold.operators.segments import add_segment
from tripfold.operators.visits import ends_visit, is_visit_candidate, visits
from tripfold.sources.edges import edge_lookup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


CASES = {
    "closer ends it": ([("gate3", "gate5"), ("gate5", "entrance1")], [2], [2]),
    "first never closes": ([("gate3", "entrance1"), ("gate3", "entrance2")], [2], [2]),
    "alternation": ([("gate3", "entrance1")] * 3, [2, 1], [2, 1]),
    "base, continuous": (
        [("gate5", "gate3"), ("gate3", "ranger-base"), ("gate1", "ranger-base")],
        [3],
        [2, 1],
    ),
    "never closed": ([("gate3", "gate5"), ("gate5", "camping2")], [2], [2]),
    "single": ([("gate3", "gate5")], [1], [1]),
}


@pytest.mark.parametrize("name", CASES)
def test_segments(spark, name):
    trips, by_stitch, by_visit = CASES[name]
    for closes, want in [(ends_stitch(), by_stitch), (ends_visit(), by_visit)]:
        rows = add_segment(trip_rows(spark, trips), ["entity_id"], closes).collect()
        rows.sort(key=lambda r: r.start_time)
        sizes = [len(list(g)) for _, g in itertools.groupby(rows, key=lambda r: r.segment)]
        assert sizes == want
        assert [r.segment for r in rows] == sorted(r.segment for r in rows)


def test_segments_for_all_flag_series(spark):
    """Every series of up to ten trips that may or may not close."""
    series = [s for n in range(1, 11) for s in itertools.product([False, True], repeat=n)]
    rows = [
        (k, i, "entrance1" if flag else "gate1")
        for k, flags in enumerate(series)
        for i, flag in enumerate(flags)
    ]
    frame = spark.createDataFrame(rows, "entity_id int, start_time int, end_place string")
    frame = frame.withColumn("date", F.col("start_time"))
    got = {}
    for r in add_segment(frame, ["entity_id"], ends_visit()).collect():
        got.setdefault(r.entity_id, {})[r.start_time] = r.segment
    for k, flags in enumerate(series):
        trips = [{"start_time": i, "end_place": "entrance" if f else ""} for i, f in enumerate(flags)]
        want = {
            t["start_time"]: n
            for n, group in enumerate(fold.segments(trips, fold.ends_visit))
            for t in group
        }
        assert got[k] == want


@pytest.mark.parametrize("text", ["abc", "polygenelubricants", "", "gateé", "\U0001f600 on"])
def test_text_hash(spark, text):
    known = {"abc": 96354, "polygenelubricants": -2147483648, "": 0}
    got = one(spark, X.text_hash(F.lit(text)))
    assert got == known.get(text, fold.java_hash(text)) == fold.java_hash(text)


def test_path_hash(spark):
    ab, ba = F.lit("a:b"), F.lit("b:a")
    assert one(spark, X.path_hash(ab, ba)) == one(spark, X.path_hash(ba, ab)) == 3044576


def test_scalars(spark):
    ts = lambda s: F.to_timestamp(F.lit(s))
    late, later = ts("2015-05-01 23:00:00"), ts("2015-05-02 22:59:59")
    assert one(spark, X.round3(F.lit(0.0625))) == 0.062
    assert one(spark, X.round3(F.lit(0.1875))) == 0.188
    assert one(spark, X.whole_days(late, later)) == 0
    assert one(spark, X.calendar_days(late, later)) == 1
    assert one(spark, X.day_of_week(F.lit(date(2015, 5, 1)))) == "friday"
    assert one(spark, X.day_of_week(ts("2015-05-03 10:00:00"))) == "sunday"
    assert one(spark, X.speed(F.lit(2.0), F.lit(360))) == 20
    assert one(spark, X.speed(F.lit(2.0), F.lit(0))) is None
    assert one(spark, X.iso_time(late)) == "2015-05-01T23:00:00Z"
    assert one(spark, X.plain_time(late)) == "2015-05-01 23:00:00"
    assert one(spark, X.parse_date(F.lit("2015-05-01"))) == date(2015, 5, 1)
    assert one(spark, X.parse_date(F.lit("no"))) is None
    for text in ("2015-05-01 00:43:28", "2015-05-01T00:43:28Z"):
        assert one(spark, X.parse_time(F.lit(text))) == datetime(2015, 5, 1, 0, 43, 28)
    assert one(spark, X.parse_time(F.lit("1 May"))) is None


@pytest.mark.parametrize(
    "seconds, pick, want",
    [
        (360, "lowest", (2.0, 20.0)),
        (360, "closest", (2.4, 24.0)),
        (0, "lowest", (0.0, 0.0)),
        (0, "closest", (0.0, 0.0)),
    ],
)
def test_leg_choice(spark, seconds, pick, want):
    from datetime import timedelta

    from tests.data import readings_frame
    from tripfold.operators.trips import estimated_leg_rows

    begin = datetime(2015, 5, 1, 8)
    rows = [(1, 1, "t", begin, "a"), (2, 1, "t", begin + timedelta(seconds=seconds), "b"),
            (3, 1, "t", begin + timedelta(hours=1), "c")]
    edges = spark.createDataFrame(
        [("a", "b", 2.4), ("a", "b", 3.0), ("a", "b", 2.0), ("b", "a", 0.1)],
        "source string, target string, distance double",
    )
    legs = estimated_leg_rows(readings_frame(spark, rows), edge_lookup(edges), pick).collect()
    got = {r.place: (r.distance, r.speed) for r in legs}
    assert got["b"] == pytest.approx(want)
    assert got["a"] == got["c"] == (0.0, 0.0)


def test_classification(spark):
    rows = trip_rows(
        spark,
        [("entrance1", "camping2"), ("entrance1", "ranger-base"), ("gate3", "entrance1"),
         ("camping2", "camping2")],
    ).withColumn(
        "end_time",
        F.when(F.col("start_place") == "camping2", F.col("start_time")).otherwise(F.col("end_time")),
    )
    got = [
        (r.good, r.candidate)
        for r in rows.orderBy("date")
        .select(is_good().alias("good"), is_visit_candidate().alias("candidate"))
        .collect()
    ]
    assert got[:3] == [(True, True), (True, False), (False, True)]
    assert got[3][0] is False


def test_trips_may_overlap_in_a_visit(spark):
    """A stitched trip from day 1 to day 8 around a good trip on day 5."""
    trips = trip_rows(spark, [("camping2", "gate1"), ("x", "x"), ("x", "x"), ("x", "x"),
                              ("camping2", "entrance1"), ("x", "x"), ("x", "x"),
                              ("gate1", "gate3")])
    trips = trips.where("start_place <> 'x'")
    repaired = repair_trips(trips)
    assert sorted((r.start_place, r.end_place) for r in repaired.collect()) == [
        ("camping2", "entrance1"), ("camping2", "gate3")
    ]
    (visit,) = visits(repaired).collect()
    assert visit.end_place == "entrance1"
    assert visit.end_time == datetime(2015, 5, 5, 10, 10)
    assert visit.destinations == ["gate3"]
    assert (visit.total_days, len(visit.daily_records)) == (4, 2)


def test_merged_distance_is_rounded_again(spark):
    trips = trip_rows(spark, [("gate3", "gate5"), ("gate5", "entrance1")])
    trips = trips.withColumn("total_distance", F.lit(0.0005))
    (row,) = repair_trips(trips).collect()
    assert row.total_distance == 0.001
    assert row.avg_speed == pytest.approx(0.001 * 3600 / 1200)
    assert row.path == "gate3:gate5:gate5:entrance1"
    assert row.path_rev == "gate5:gate3:entrance1:gate5"
