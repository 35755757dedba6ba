"""Cutting an ordered series of trips into segments, with windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIP_ORDER = ["start_time", "date"]


def add_segment(trips: DataFrame, keys: list[str], closes: Column) -> DataFrame:
    """Adds `segment` (0, 1, ...) within `keys`, over trips in start order.

    A trip opens a segment if none is open, and then never closes it. Otherwise it joins the
    open segment, and closes it if `closes` holds; `closes` may use the trip's columns and
    `prev_end_place`.

    So among neighbouring trips for which `closes` holds, every second one closes: the first
    closes, the next one opens and cannot, and so on. That is the parity of their running count
    since the last trip for which it does not hold. All windows share one sort.
    """
    order = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(TRIP_ORDER)}"
    so_far = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    does_close = "may_close AND (n_may - n_at_break) % 2 = 1"
    return (
        trips.selectExpr(
            "*",
            f"lag(end_place) OVER ({order}) AS prev_end_place",
            f"row_number() OVER ({order}) AS nth",
        )
        .withColumn("may_close", (F.col("nth") > 1) & closes)
        .selectExpr("*", f"count_if(may_close) OVER ({so_far}) AS n_may")
        .selectExpr("*", f"max(IF(may_close, NULL, n_may)) OVER ({so_far}) AS n_at_break")
        .selectExpr("*", f"count_if({does_close}) OVER ({before}) AS segment")
        .drop("prev_end_place", "nth", "may_close", "n_may", "n_at_break")
    )


def attach(
    trips: DataFrame,
    keys: list[str],
    slim: list[str],
    mark,
    spread: bool,
    ends: DataFrame | None = None,
) -> DataFrame:
    """mark(trips), where `mark` adds columns by windows over an entity's trips.

    With `spread` the windows see only the `slim` columns, one short row per trip and so at most
    one per calendar day, and their result is joined back; the wide columns, with the paths,
    never gather by entity. `ends` may hold the short rows, where they are had more cheaply than
    from the trips.
    """
    if not spread:
        return mark(trips)
    marked = mark((trips if ends is None else ends).select(*slim))
    return trips.join(marked.drop(*(c for c in slim if c not in keys)), keys)
