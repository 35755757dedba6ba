"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.session import kept, shared_folder

#: A word is a run of other characters than these six: blank and x09 to x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; fails on a cluster that names none."""
    return shared_folder(spark)


def checkpoint(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder now, so that what follows survives lost executors."""
    return kept(rows)


def id_fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def utf8_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8. None has none.

    Of bytes, lower() and split() know ASCII only: A-Z, and exactly the six separators.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def by_bytes(texts: Iterable[str | None], limit: int) -> Iterator[list[str | None]]:
    """Consecutive texts in blocks of about `limit` characters; a longer text is alone."""
    block: list[str | None] = []
    held = 0
    for text in texts:
        size = len(text or "")
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append(text)
        held += size
    if block:
        yield block


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def one_text_each(rows: DataFrame, keys: list[str], body: str, *others: str) -> DataFrame:
    """One row per `keys`, that of the smallest text hash; combined before the shuffle.

    Many rows of one key cost a row per task. `others` come with the text and part equal texts.
    """
    first = F.min(F.struct(F.xxhash64(body).alias("hash"), body, *others)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, *(F.col(f"first.{c}").alias(c) for c in (body, *others)))


def bounded_sample(rows: DataFrame, key: str, limit: int, salt: str = "sample") -> DataFrame:
    """At most about `limit` rows, the same on each run; all of them where there are no more.

    Keeps the rows whose id hash is below limit / count, which needs no sort of the table. A sample of a
    sample needs a `salt` of its own.
    """
    total = rows.count()
    if total <= limit:
        return rows
    share = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) / F.lit(1 << 30)
    return rows.where(share < limit / total)
