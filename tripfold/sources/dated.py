"""Tables that are kept by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.functions.expressions import parse_date


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The rows of a table by date from one day to another, both included; days as yyyy-MM-dd.

    Only the folders of those days are read. A text that is no day fails.
    """
    days = spark.range(1).select(*(parse_date(F.lit(t)).alias(n) for n, t in (("first", first), ("last", last)))).first()
    wrong = [text for text, day in zip((first, last), days) if day is None]
    if wrong:
        raise ValueError(f"no days: {wrong}")
    return spark.read.parquet(path).where(F.col("date").between(F.lit(days["first"]), F.lit(days["last"])))
