"""Entities that hold an outsized share of the readings, and how to treat them apart.

Everything here works per entity, so the result for a table is the union of the results for
any split of its entities. Ordinary entities take the short plan: one shuffle by entity, then
windows. Hot ones take the spread plan: no step there gathers more than a slice of an entity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.schema import HotRule


def hot_entities(readings: DataFrame, rule: HotRule = HotRule()) -> list[Any]:
    """Ids of the hot entities: at most buckets/factor, mostly none.

    Reads the id column only. Counting hash buckets instead of entities keeps the shuffle at
    `buckets` rows per task however many entities there are; single entities are counted only
    inside the few buckets that are too full.
    """
    bucket = F.pmod(F.xxhash64("entity_id"), F.lit(rule.buckets))
    counts = readings.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # One row, of at most `buckets` structs.
    full = F.when(F.col("n") > rule.min_rows, F.struct("bucket", "n"))
    total, buckets = counts.agg(F.sum("n"), F.collect_list(full)).first()
    limit = max(rule.min_rows, rule.factor * (total or 0) / rule.buckets)
    suspects = [b["bucket"] for b in buckets if b["n"] > limit]
    if not suspects:
        return []
    heavy = (
        readings.where(bucket.isin(suspects) & F.col("entity_id").isNotNull())
        .groupBy("entity_id")
        .count()
        .where(F.col("count") > limit)
        .select("entity_id")
    )
    return sorted(row[0] for row in heavy.collect())


def by_heat(
    rows: DataFrame, hot: Sequence[Any], build: Callable[[DataFrame, bool], DataFrame]
) -> DataFrame:
    """build(rows, spread=False), with hot entities, if any, built apart with spread=True.

    Rows without an entity are never hot, and stay with the others.
    """
    if not hot:
        return build(rows, False)
    is_hot = F.coalesce(F.col("entity_id").isin(list(hot)), F.lit(False))
    return build(rows.where(~is_hot), False).unionByName(build(rows.where(is_hot), True))
