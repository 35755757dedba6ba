"""Whole plans against plain loops, on random readings; hot entities against ordinary ones."""

import pytest

from tests import fold
from tests.data import crowded_day, edge_list, random_readings, readings_frame
from tripfold.operators import trips
from tripfold.plans import journeys
from tripfold.sources.edges import edge_lookup

ROWS = [*random_readings(), *crowded_day()]
EDGES = fold.multimap(edge_list())
SUMMARY = fold.summary(ROWS, EDGES)
HOTS = [(), (1_000, 3, 5, 7, 11)]


@pytest.fixture(scope="module")
def readings(spark):
    return readings_frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def lookup(spark):
    return edge_lookup(spark.createDataFrame(edge_list(), "source string, target string, distance double"))


def by_key(rows, *keys):
    found = {tuple(r[k] for k in keys): r for r in rows}
    assert len(found) == len(rows)
    return found


def assert_same(got, want, keys, fields):
    got, want = by_key([r.asDict(True) for r in got], *keys), by_key(want, *keys)
    assert got.keys() == want.keys()
    for key, row in want.items():
        for f in fields:
            value = row[f]
            if isinstance(value, float):
                value = pytest.approx(value, rel=1e-12, abs=1e-12)
            assert got[key][f] == value, (key, f)


@pytest.mark.parametrize("pick", ["lowest", "closest"])
@pytest.mark.parametrize("spread", [False, True])
def test_trip_summary(readings, lookup, pick, spread):
    got = trips.trip_summary(readings, lookup, pick, spread=spread).collect()
    assert_same(got, fold.summary(ROWS, EDGES, pick), ["entity_id", "date"], trips.TRIP_SUMMARY)


@pytest.mark.parametrize("spread", [False, True])
def test_leg_rows(readings, lookup, spread):
    got = sorted(
        (r.entity_id, r.date, r.pos, r.ts, r.place, r.elapsed, r.distance, r.speed)
        for r in trips.estimated_leg_rows(readings, lookup, spread=spread).collect()
    )
    want = sorted(
        (entity, date, i + 1, *leg)
        for (entity, date), rows in fold.by_trip(ROWS).items()
        for i, leg in enumerate(fold.legs(rows, EDGES))
    )
    assert got == want


@pytest.mark.parametrize("spread", [False, True])
def test_candidate_rows(readings, lookup, spread):
    got = sorted(
        (r.entity_id, str(r.date), r.pos, r.candidate or 0, r.distance or 0.0, r.speed or 0.0)
        for r in trips.trip_leg_candidate_rows(readings, lookup, spread).collect()
    )
    want = []
    for (entity, date), rows in fold.by_trip(ROWS).items():
        for i, row in enumerate(rows):
            before = rows[i - 1] if i else None
            found = sorted(EDGES.get((before[4], row[4]), [])) if before else []
            elapsed = fold.seconds(row[3]) - fold.seconds(before[3]) if before else 0
            for n, d in enumerate(found):
                want.append((entity, str(date), i + 1, n + 1, d, fold.speed(d, elapsed) or 0.0))
            if not found:
                want.append((entity, str(date), i + 1, 0, 0.0, 0.0))
    assert got == sorted(want)


@pytest.mark.parametrize("hot", HOTS)
def test_stitched(readings, lookup, hot):
    got = journeys.journey_stitched(readings, lookup, hot=hot).collect()
    assert_same(got, fold.stitched(SUMMARY), ["entity_id", "date"], trips.TRIP_SUMMARY)


@pytest.mark.parametrize("hot", HOTS)
def test_repaired(readings, lookup, hot):
    got = journeys.journey_repaired(readings, lookup, hot=hot).collect()
    assert_same(got, fold.repaired(SUMMARY), ["entity_id", "date"], trips.TRIP_SUMMARY)


@pytest.mark.parametrize("hot", HOTS)
def test_visits(readings, lookup, hot):
    got = [r.asDict(True) for r in journeys.journey_visits(readings, lookup, hot=hot).collect()]
    want = fold.visits(fold.repaired(SUMMARY))
    days = {(v["entity_id"], v["start_time"]): v["days"] for v in want}
    for visit in got:
        assert days[visit["entity_id"], visit["start_time"]] == [
            (d["days_since"], d["day_in_visit"], d["start_time"], d["hash"], d["total_distance"])
            for d in visit["daily_records"]
        ]
    found = by_key(got, "entity_id", "start_time")
    assert found.keys() == by_key(want, "entity_id", "start_time").keys()
    for row in want:
        visit = found[row["entity_id"], row["start_time"]]
        for field in row.keys() - {"days"}:
            value = row[field]
            value = pytest.approx(value, rel=1e-12) if isinstance(value, float) else value
            assert visit[field] == value, field


@pytest.mark.parametrize("hot", HOTS)
def test_itinerary(readings, lookup, hot):
    want = {i["entity_id"]: i for i in fold.itineraries(SUMMARY)}
    rows = journeys.journey_itinerary(readings, lookup, hot=hot).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.entity_id]
        for field in w.keys() - {"days", "legs"}:
            value = w[field]
            value = pytest.approx(value, rel=1e-12) if isinstance(value, float) else value
            assert r[field] == value, field
        assert [
            (d.days_since, d.day_in_visit, d.start_time, d.hash) for d in r.daily_records
        ] == w["days"]
        assert [tuple(leg) for leg in r.timed_path] == w["legs"]


@pytest.mark.parametrize("hot", HOTS)
def test_itinerary_long_forms(readings, lookup, hot):
    want = fold.itineraries(SUMMARY)
    days = journeys.journey_itinerary_days(readings, lookup, hot=hot).collect()
    assert sorted((r.entity_id, r.start_time, r.days_since, r.day_in_visit) for r in days) == sorted(
        (i["entity_id"], d[2], d[0], d[1]) for i in want for d in i["days"]
    )
    legs = journeys.journey_itinerary_legs(readings, lookup, hot=hot).collect()
    got = sorted(
        (r.entity_id, r.ts, r.pos, r.place, r.elapsed, r.distance, r.speed, r.days_to_next)
        for r in legs
    )
    expected = []
    for i in want:
        pos, day = 0, None
        for time, *rest in i["legs"]:
            pos = pos + 1 if time.date() == day else 1
            day = time.date()
            expected.append((i["entity_id"], time, pos, *rest))
    assert got == sorted(expected)


@pytest.mark.parametrize("hot", HOTS)
def test_path_rollup(readings, hot):
    trips_of = fold.per_entity(SUMMARY)
    for r in journeys.journey_path_rollup(readings, hot).collect():
        own = sorted(trips_of[r.entity_id], key=lambda t: t["date"])
        assert r.days_span == len(own)
        assert r.path == "||".join(t["path"] for t in own)


def test_stitching_keeps_trips_time_and_distance(readings, lookup):
    rows = journeys.journey_repaired(readings, lookup).collect()
    assert sum(r.total_time for r in rows) == sum(t["total_time"] for t in SUMMARY)
    assert sum(r.total_distance for r in rows) == pytest.approx(
        sum(t["total_distance"] for t in SUMMARY), abs=0.001 * len(rows)
    )
    assert sum(r.path.count(":") + 1 for r in rows) == len(ROWS)


def test_records_hold_the_rows(readings, lookup):
    """Nested forms against the long forms."""
    for long, record, fields in [
        (trips.trip_timeline_rows(readings), trips.trip_timeline(readings), ["ts", "place"]),
        (
            trips.trip_timeline_elapsed_rows(readings),
            trips.trip_timeline_elapsed(readings),
            ["ts", "place", "elapsed"],
        ),
        (
            trips.trip_leg_rows(readings, lookup),
            trips.trip_legs(readings, lookup),
            ["ts", "place", "elapsed", "distance", "speed"],
        ),
        (
            trips.trip_candidate_legs(readings, lookup),
            trips.trip_leg_candidates(readings, lookup),
            ["ts", "place", "elapsed", "candidates"],
        ),
    ]:
        want = {}
        for r in sorted(long.collect(), key=lambda r: r.pos):
            want.setdefault((r.entity_id, r.date), []).append(tuple(r[f] for f in fields))
        got = {(r.entity_id, r.date): [tuple(s[f] for f in fields) for s in r.timed_path] for r in record.collect()}
        if "total_time" in record.columns and "path" not in record.columns:
            got = {k: v[::-1] for k, v in got.items()}
        assert got == want


def test_paths(readings):
    rows = {(r.entity_id, r.date): r for r in trips.path_signature(readings).collect()}
    arrays = {(r.entity_id, r.date): r.path for r in trips.trip_path_array(readings).collect()}
    counts = {}
    for t in SUMMARY:
        key = t["entity_id"], t["date"]
        assert rows[key].path_hash == t["path_hash"]
        assert (rows[key].path, rows[key].path_rev) == (t["path"], t["path_rev"])
        assert ":".join(arrays[key]) == t["path"]
        canonical = max(t["path"], t["path_rev"])
        counts[canonical] = counts.get(canonical, 0) + 1
    got = {r["path"]: r["count"] for r in trips.path_frequency(readings).collect()}
    assert got == counts
