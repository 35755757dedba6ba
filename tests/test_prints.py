"""Path hashes and path counts without texts, against the text forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import fold
from tests.data import edge_list, random_readings, readings_frame
from tests.test_plans import final_plan
from tripfold.functions.expressions import power31, times32, utf16_length
from tripfold.operators.prints import count_paths, path_words
from tripfold.operators.trips import path_frequency, path_signature, trip_totals
from tripfold.plans import journeys
from tripfold.sources.edges import edge_lookup

# Names with the separator inside, that begin one another, wide characters, empty and missing ones.
NAMES = ["a", "a0", "a:b", "b", "b:a", ":", "", "é", "🎉x", "gate1", "gate10", None]


def odd_readings(seed: int, trips: int = 250) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for trip in range(trips):
        time = datetime(2015, 5, 1 + trip % 20, 1)
        names = rng.sample(NAMES, rng.choice([1, 2, 3]))
        half = [rng.choice(names) for _ in range(rng.randint(1, 5))]
        # Many paths that read the same in both directions, and many that nearly do.
        places = half + half[::-1] if rng.random() < 0.5 else half
        if rng.random() < 0.3:
            places[rng.randrange(len(places))] = rng.choice(NAMES)
        for place in places:
            rows.append((len(rows), trip // 20, "t", time, place))
            time += timedelta(seconds=rng.choice([1, 50, 100]))
    return rows


@pytest.fixture(scope="module")
def lookup(spark):
    return edge_lookup(spark.createDataFrame(edge_list(), "source string, target string, distance double"))


def test_powers(spark):
    exponents = [0, 1, 2, 511, 512, 513, 2**18 - 1, 2**27 + 5, 2**31, 10**12, -1, -2, -(10**9)]
    rows = spark.createDataFrame([(e,) for e in exponents], "e bigint")
    for r in rows.select("e", power31(F.col("e")).alias("p")).collect():
        assert r.p == pow(31, r.e, 1 << 32)
    pairs = [(2**32 - 1, 2**32 - 1), (2**32 - 1, 2**31 + 7), (0, 5), (65_536, 65_537)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in rows.select("a", "b", times32(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == r.a * r.b % 2**32


def test_lengths(spark):
    texts = ["", "abc", "é", "🎉x", "▁🎉🎉"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{utf16_length('t')} AS n")
    assert {r.t: r.n for r in rows.collect()} == {t: len(t.encode("utf-16-be")) // 2 for t in texts}


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_hash_without_text_is_that_of_the_text(spark, lookup, spread, seed):
    readings = readings_frame(spark, odd_readings(seed))
    want = {(r.entity_id, r.date): r for r in path_signature(readings).collect()}
    got = trip_totals(readings, lookup, spread=spread).collect()
    assert len(got) == len(want)
    for r in got:
        text = want[r.entity_id, r.date]
        assert r.path_hash == text.path_hash, text
        sign = (text.path.encode() > text.path_rev.encode()) - (text.path.encode() < text.path_rev.encode())
        assert r.path_print.turn == sign, text
        assert r.path_print.units == len(text.path.encode("utf-16-be")) // 2


@pytest.mark.parametrize("hot", [(), (0, 3, 5)])
def test_longer_paths_hash_alike(spark, lookup, hot):
    readings = readings_frame(spark, random_readings(5, 40))
    for totals, whole in [
        (journeys.journey_repaired_totals, journeys.journey_repaired),
        (journeys.journey_visit_totals, journeys.journey_visits),
        (journeys.journey_itinerary_totals, journeys.journey_itinerary),
    ]:
        found = {(r.entity_id, r.start_time, r.end_time, r.path_hash) for r in totals(readings, lookup, hot=hot).collect()}
        want = {(r.entity_id, r.start_time, r.end_time, r.path_hash) for r in whole(readings, lookup, hot=hot).collect()}
        assert found == want and len(want) > 10


def text_counts(readings):
    return {r["path"]: r["count"] for r in path_frequency(readings).collect()}


def joined_counts(rows):
    paths = {}
    for r in sorted(rows.collect(), key=lambda r: r.pos):
        paths.setdefault((r.entity_id, r.date), ([], r["count"]))[0].append(r.place)
    found = {":".join(words): n for words, n in paths.values()}
    assert len(found) == len(paths)
    return found


@pytest.mark.parametrize("spread", [False, True])
def test_counts_without_text_are_those_of_the_texts(spark, spread):
    for rows in (odd_readings(3), random_readings(4, 30)):
        readings = readings_frame(spark, rows)
        got = joined_counts(count_paths(path_words(readings, spread)))
        assert got == text_counts(readings) and max(got.values()) > 1


def test_counts_over_hot_and_ordinary_entities(spark):
    readings = readings_frame(spark, random_readings(6, 30))
    assert joined_counts(journeys.journey_path_frequency(readings, hot=[1, 4])) == text_counts(readings)
    assert journeys.journey_path_frequency(readings.limit(0)).count() == 0


def test_a_shared_fingerprint_fails(spark, monkeypatch):
    from tripfold.operators import prints

    readings = readings_frame(spark, random_readings(4, 30))
    monkeypatch.setattr(prints, "_fingerprint", lambda at, salt: [F.lit(0).cast("bigint")] * 4)
    with pytest.raises(Exception, match="share a fingerprint"):
        count_paths(path_words(readings)).collect()


def test_no_lists_of_places(spark):
    readings = readings_frame(spark, random_readings(4, 30))
    plan = final_plan(journeys.journey_path_frequency(readings, hot=[1]))
    assert "collect_list" not in plan and "array_join" not in plan and "partial_count" in plan


def test_a_long_day_in_slices(spark, lookup):
    """One entity's day of 30,000 readings over 500 minutes, against the plain loop's hash."""
    rng, day = random.Random(1), datetime(2015, 5, 1)
    times = sorted(rng.randrange(30_000) for _ in range(30_000))
    rows = [(i, 1, "t", day + timedelta(seconds=t), rng.choice(["gate1", "gate3", "camping2"])) for i, t in enumerate(times)]
    places = [r[4] for r in rows]
    path, back = ":".join(places), ":".join(places[::-1])
    readings = readings_frame(spark, rows)
    (total,) = trip_totals(readings, lookup, spread=True).collect()
    assert total.path_hash == fold.path_hash(path, back)
    counted = count_paths(path_words(readings, spread=True)).orderBy("pos").collect()
    assert ":".join(r.place for r in counted) == max(path, back)
