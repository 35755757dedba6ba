"""Small tables for tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from checks.stand_in import edge_rows
from tripfold.sources.readings import with_date

READING = "reading_id bigint, entity_id bigint, entity_type string, ts timestamp, place string"
PLACES = ["gate1", "gate3", "general-gate4", "entrance1", "entrance2", "ranger-base",
          "old-ranger-base-2", "camping2"]


def random_readings(seed: int = 7, entities: int = 60) -> list[tuple]:
    """(reading_id, entity, type, time, place), with ties in time and days of one reading."""
    rng = random.Random(seed)
    rows = []
    for entity in range(entities):
        for _ in range(rng.choice([1, 3, 12, 40])):
            time = datetime(2015, 5, 1) + timedelta(days=rng.randrange(25))
            time += timedelta(seconds=rng.randrange(86_400))
            for _ in range(rng.choice([1, 1, 2, 4])):
                rows.append((len(rows), entity, f"t{entity % 3}", time, rng.choice(PLACES)))
                time += timedelta(seconds=rng.choice([0, 1, 30, 600, 5_000]))
    rng.shuffle(rows)
    return rows


def crowded_day(n: int = 400) -> list[tuple]:
    """One entity's day with several readings in many seconds, and long gaps."""
    rng = random.Random(3)
    times = [datetime(2015, 5, 3) + timedelta(seconds=rng.choice([5, 5, 60, 61, 3_600, 80_000])
                                              + rng.randrange(40)) for _ in range(n)]
    return [(i, 1_000, "t9", t, rng.choice(PLACES)) for i, t in enumerate(times)]


def edge_list() -> list[tuple]:
    return [*edge_rows(), ("gate1", "gate3", 0.0), ("gate1", "entrance2", 2.5),
            ("gate1", "entrance2", 2.5), ("entrance2", "gate1", 40.0)]


def readings_frame(spark, rows):
    return with_date(spark.createDataFrame(rows, READING))


def trip_rows(spark, trips: list[tuple[str, str]], entity: int = 1):
    """Trips of one entity as (start, end) places, one per day in this order."""
    rows = []
    for day, (start, end) in enumerate(trips):
        begin = datetime(2015, 5, 1, 10) + timedelta(days=day)
        rows.append((entity, "t", begin.date(), 600, 1.5, 9.0, f"{start}:{end}", f"{end}:{start}",
                     0, "friday", start, end, begin, begin + timedelta(minutes=10)))
    return spark.createDataFrame(
        rows,
        "entity_id bigint, entity_type string, date date, total_time bigint, "
        "total_distance double, avg_speed double, path string, path_rev string, path_hash int, "
        "day_of_week string, start_place string, end_place string, start_time timestamp, "
        "end_time timestamp",
    )
