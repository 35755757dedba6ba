"""CSV columns by the names in the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_named(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """The named columns of a CSV table as text, wherever they stand; fails if one is missing."""
    raw = spark.read.option("header", True).csv(path)
    missing = [n for n in names if n not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {raw.columns}")
    return raw.select(*(F.col(f"`{n}`") for n in names))
