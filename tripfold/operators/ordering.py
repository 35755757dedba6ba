"""Readings of an entity-day in time order, each with its predecessor."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripfold.session import kept

TRIP = ["entity_id", "date"]
READING_ORDER = ["ts", "reading_id"]


def in_order(
    readings: DataFrame,
    spread: bool = False,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds pos (1, 2, ...), prev_ts and prev_place within (entity, date).

    `sums` names SQL expressions of a row; for each, name_before is its sum over the readings before
    and name_total that over the whole day. With `spread` a day is cut into slices that are ordered in
    separate tasks, however many readings fall into a minute or a second.
    """
    if spread:
        return _in_sliced_order(readings, sums or {})
    totals = (f"sum({e}) OVER (PARTITION BY {', '.join(TRIP)}) AS {n}_total" for n, e in (sums or {}).items())
    return _numbered(readings, TRIP, sums or {}).selectExpr("*", *totals)


def _numbered(readings: DataFrame, keys: list[str], sums: Mapping[str, str]) -> DataFrame:
    order = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(READING_ORDER)}"
    before = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return readings.selectExpr(
        "*",
        f"row_number() OVER ({order}) AS pos",
        f"lag(ts) OVER ({order}) AS prev_ts",
        f"lag(place) OVER ({order}) AS prev_place",
        *(f"coalesce(sum({e}) OVER ({before}), 0L) AS {n}_before" for n, e in sums.items()),
    )


def placed_in_slices(readings: DataFrame) -> DataFrame:
    """Readings with `slice`: the number of their range of (entity, date, time, reading).

    Ranges hold about equal numbers of readings, as a number of its own per reading is the last part
    of the order: neither a crowded second nor readings that tie fill one. Where the bounds lie is
    drawn, and no result depends on it; the placement is written down once, so that later steps agree.
    """
    number = readings.withColumn("number", F.monotonically_increasing_id())
    placed = number.repartitionByRange(*TRIP, *READING_ORDER, "number").drop("number")
    return kept(placed.withColumn("slice", F.spark_partition_id()))


def _in_sliced_order(readings: DataFrame, sums: Mapping[str, str]) -> DataFrame:
    slices = [*TRIP, "slice"]
    sliced = placed_in_slices(readings)

    # What each slice hands to the next one: its last reading, how many came before, and sums.
    # Counts and last readings are combined before the shuffle, so this stays one small row
    # per slice, and a window over a day's slices sees no readings.
    ends = sliced.groupBy(*slices).agg(
        F.count("*").alias("n"),
        F.max_by(F.struct("ts", "place"), F.struct(*READING_ORDER)).alias("tail"),
        *(F.sum(F.expr(e)).alias(f"{n}_sum") for n, e in sums.items()),
    )
    over_slices = Window.partitionBy(*TRIP).orderBy("slice")
    before = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *slices,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.lag("tail").over(over_slices).alias("tail_before"),
        *(F.coalesce(F.sum(f"{n}_sum").over(before), F.lit(0)).alias(f"{n}_carried") for n in sums),
        *(F.sum(f"{n}_sum").over(Window.partitionBy(*TRIP)).alias(f"{n}_total") for n in sums),
    )

    # Only a slice's first reading has its predecessor in another slice; its place may be NULL.
    is_first = F.col("pos") == 1
    return _numbered(sliced, slices, sums).join(carried, slices).select(
        *readings.columns,
        (F.col("pos") + F.col("n_before")).cast("int").alias("pos"),
        F.when(is_first, F.col("tail_before.ts")).otherwise(F.col("prev_ts")).alias("prev_ts"),
        F.when(is_first, F.col("tail_before.place")).otherwise(F.col("prev_place")).alias("prev_place"),
        *((F.col(f"{n}_before") + F.col(f"{n}_carried")).alias(f"{n}_before") for n in sums),
        *(f"{n}_total" for n in sums),
    )
