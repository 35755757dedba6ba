"""Writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation

from tripfold.schema import DATE, ISO_TIME


def write_json(
    rows: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False
) -> None:
    """JSON lines; every timestamp, nested ones too, as ISO text with a literal Z.

    A single file means a single task writes everything, so it is for small results only; making
    them is not drawn into that task. NULL fields are written as null.
    """
    rows = rows.repartition(1) if single_file else rows
    writer = rows.write.mode(mode).option("timestampFormat", ISO_TIME)
    writer = writer.option("ignoreNullFields", False)
    writer.option("dateFormat", DATE).json(path)


def write_parquet(
    rows: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    only_these: bool = False,
    counts: Mapping[str, Column] | None = None,
) -> dict[str, int]:
    """Parquet; partitioned by date, trips can be read back a day at a time. Returns the `counts`.

    Rows are placed by partition first, so that a date is a few files, and a large date is split.
    With `only_these` an overwrite replaces the partitions that rows has, and leaves the others.
    `counts` are aggregates taken while the rows are written, in the task that writes them.
    """
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    seen = Observation()
    if counts:
        rows = rows.observe(seen, *(column.alias(name) for name, column in counts.items()))
    writer = rows.write.mode(mode).partitionBy(*partition_by)
    if only_these:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return dict(seen.get) if counts else {}
