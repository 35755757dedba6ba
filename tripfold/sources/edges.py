"""Directed distances between places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripfold.sources.named import read_named

# What may be sent to every executor: measured before the hint is given.
BROADCAST_BYTES = 64 * 1024 * 1024


# A distance beyond this is an error of the source. Up to it, sums over any number of legs stay exact.
MOST_DISTANCE = 1e9


EDGE_COLUMNS = ["source", "target", "distance"]


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A CSV edge list whose header names source, target and distance, in any order.

    Edges without a usable distance are left out; `rejected_edges` lists them.
    """
    return usable_edges(parsed_edges(read_named(spark, path, EDGE_COLUMNS)))


def rejected_edges(spark: SparkSession, path: str) -> DataFrame:
    return unusable_edges(parsed_edges(read_named(spark, path, EDGE_COLUMNS)))


def parsed_edges(raw: DataFrame) -> DataFrame:
    """Edges from text columns: source, target, distance, distance_text, and `reason` where unusable.

    A distance must be a finite number of MOST_DISTANCE at most, either way; NaN and Infinity are
    numbers to a cast, but would turn every sum they enter into nothing.
    """
    text, number = F.col("distance"), F.col("distance").try_cast("double")
    reason = (
        F.when(number.isNull(), "unreadable distance")
        .when(F.isnan(number) | (F.abs(number) == float("inf")), "distance not finite")
        .when(F.abs(number) > MOST_DISTANCE, "distance out of range")
    )
    return raw.select("source", "target", number.alias("distance"), text.alias("distance_text"), reason.alias("reason"))


def usable_edges(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("distance_text", "reason")


def unusable_edges(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NOT NULL").drop("distance")


def edge_candidates(edges: DataFrame) -> DataFrame:
    """One row per (source, target, distance), with the number of equal parallel edges.

    Edges with a NULL distance are no candidates.
    """
    return edges.where("distance IS NOT NULL").groupBy("source", "target", "distance").agg(F.count("*").alias("copies"))


def edge_distances(edges: DataFrame) -> DataFrame:
    """One row per (source, target): `runs` of its distances, ascending, and the least.

    A run is a distance, the number of edges that have it, and how many stand before it. Equal edges
    are counted before the shuffle and stay a count.
    """
    order = Window.partitionBy("source", "target").orderBy("distance")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = F.array_sort(F.collect_list(F.struct("distance", "copies", "before"))).alias("runs")
    return (
        edge_candidates(edges)
        .withColumn("before", before)
        .groupBy("source", "target")
        .agg(runs, F.min("distance").alias("min_distance"))
    )


def edge_distance_rows(edges: DataFrame) -> DataFrame:
    """The distances written out: a row per edge, numbered from 0 by ascending distance."""
    each = edge_distances(edges).select("source", "target", "min_distance", F.explode("runs").alias("run"))
    return each.select(
        "source",
        "target",
        "min_distance",
        F.explode(F.expr("sequence(run.before, run.before + run.copies - 1)")).alias("pos"),
        "run.distance",
    )


def edge_reach(lookup: DataFrame) -> DataFrame:
    """Of `edge_distances`: source, target, the least and the greatest distance and their number."""
    return lookup.select(
        "source",
        "target",
        "min_distance",
        F.element_at("runs", -1)["distance"].alias("max_distance"),
        F.size("runs").alias("n_distances"),
    )


def distance_bin(wanted: Column, least: Column, greatest: Column, n: Column) -> Column:
    """Which of n equal parts of [least, greatest] a distance falls into; beyond either end the last part."""
    part = F.floor(F.try_divide((wanted - least) * n, greatest - least))
    return F.coalesce(F.greatest(F.lit(0), F.least(n - 1, part)), F.lit(0)).cast("bigint")


def edge_cells(lookup: DataFrame) -> DataFrame:
    """For finding the distance nearest to a wanted one: a row per distance and `bin` that it may serve.

    Of `edge_distances`. A distance serves from the middle to its lower neighbour up to the middle to
    its upper one (`from`, `to`); its neighbours come along. A pair has as many bins as distances, so
    rows are at most twice the distances.
    """
    rows = lookup.select(
        "source",
        "target",
        F.col("min_distance").alias("least"),
        F.element_at("runs", -1)["distance"].alias("greatest"),
        F.size("runs").alias("n"),
        F.expr("""transform(runs, (r, i) -> named_struct('distance', r.distance,
            'lower', get(runs, i - 1).distance, 'upper', get(runs, i + 1).distance)) AS each"""),
    )
    rows = rows.select("source", "target", "least", "greatest", "n", F.explode("each").alias("d"))
    low, high = (F.col("d.distance") / 2 + F.col(f"d.{side}") / 2 for side in ("lower", "upper"))
    rows = rows.select(
        "*",
        F.coalesce(low, F.lit(float("-inf"))).alias("from"),
        F.coalesce(high, F.lit(float("inf"))).alias("to"),
    )
    first, last = (distance_bin(F.col(end), F.col("least"), F.col("greatest"), F.col("n")) for end in ("from", "to"))
    return rows.select(
        "source",
        "target",
        F.explode(F.sequence(first, last)).alias("bin"),
        "from",
        "to",
        *(f"d.{c}" for c in ("lower", "distance", "upper")),
    )


def edge_lookup(edges: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`edge_distances` for joining to legs, broadcast only if it measures small enough.

    A larger table is left to an ordinary shuffled join, whose hot place pairs the adaptive
    skew join splits.
    """
    distances = edge_distances(edges)
    width = F.octet_length("source") + F.octet_length("target") + F.lit(64)
    size = edges.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(distances) if size <= max_bytes else distances


def store_edges(edges: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Keeps `edge_distances` as a table dealt by place pair, for edges too many to broadcast.

    Legs are then placed by the same pairs and meet them where they lie: runs that use the table again
    do not move the edges. `path` is where its files go, if not into the warehouse.
    """
    writer = edge_distances(edges).repartition(buckets, "source", "target").write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, "source", "target").sortBy("source", "target").saveAsTable(name)


def stored_edges(spark: SparkSession, name: str) -> DataFrame:
    """The lookup that `store_edges` kept."""
    return spark.table(name)
