"""Vector tables dealt into shards, and query blocks dealt to every shard."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripfold.llm.common import checkpoint

KEYS = ("dim", "shard", "block")


def usable(rows: DataFrame, key: str, vector: str, most: float, zero: bool) -> DataFrame:
    """`vec_id, vec` (doubles) of rows with an id and a vector of numbers below `most` in size.

    A NULL or empty vector, a NULL or non-finite component and, unless `zero`, a vector of zeros
    alone leave a row out.
    """
    vec = F.col(vector).cast("array<double>")
    small: Callable[[Column], Column] = lambda x: F.coalesce(F.abs(x) < most, F.lit(False)) & ~F.isnan(x)
    out = rows.select(F.col(key).cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", small)
    )
    return out if zero else out.where(F.exists("vec", lambda x: x != 0))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """With `dim` (components) and `shard`; rows of one id and length share a shard."""
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    return rows.withColumn("dim", F.size("vec")).withColumn("shard", shard)


def shard_count(rows: DataFrame, shard_rows: int, least: int = 8) -> int:
    return max(least, -(-rows.count() // shard_rows))


def one_vector_each(queries: DataFrame) -> DataFrame:
    """A query id that repeats asks with the smallest of its vectors."""
    return checkpoint(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")))


def one_row_each(rows: DataFrame) -> DataFrame:
    """Of an id and length that repeat, the smallest vector; combined before the shuffle."""
    dim = F.size("vec").alias("dim")
    return checkpoint(rows.groupBy("vec_id", dim).agg(F.min("vec").alias("vec")).select("vec_id", "vec"))


def in_blocks(queries: DataFrame, shards: int, block_rows: int) -> tuple[DataFrame, int]:
    """Queries in blocks of about `block_rows`, each block once for every shard."""
    blocks = max(1, -(-queries.count() // block_rows))
    out = (
        queries.withColumn("dim", F.size("vec"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    return out, blocks


def per_block(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def best(found: DataFrame, k: int, nearest: bool) -> DataFrame:
    """Each query's k best of what its shards returned (k rows a shard at most)."""
    order = F.col("score").asc() if nearest else F.col("score").desc()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct_ids(frame: pd.DataFrame) -> pd.DataFrame:
    """Sorted by id; an id that repeats keeps the smallest of its vectors."""
    frame = frame.sort_values("vec_id", kind="stable", ignore_index=True)
    twice = frame["vec_id"].duplicated(keep=False)
    if not twice.any():
        return frame
    order = sorted(range(len(frame)), key=lambda i: (frame["vec_id"][i], tuple(frame["vec"][i])))
    return frame.iloc[order].drop_duplicates("vec_id", ignore_index=True)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)
