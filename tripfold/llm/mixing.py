"""Mixing sources to target weights by capped water-filling, with seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripfold.llm.common import WORD, checkpoint

SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that sorts as the source by code point, NULL last, and is never NULL."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """Rows with `nth` from 0 in the order of a unique column, without gathering them in a task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(
        rows.repartitionByRange(n, column).withColumn("part", F.spark_partition_id())
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    place = F.row_number().over(W.partitionBy("part").orderBy(column)) - 1
    return placed.withColumn("place", place).join(F.broadcast(starts), "part").select(
        *rows.columns, (F.col("start") + F.col("place")).alias("nth")
    )


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """`target` (double) for each row of `key, source_size`.

    Every source gets a share of the sum of all sizes by its weight, but `epochs` times its size at
    most; what the clamped leave over goes to the others by weight. The level (target per weight)
    only rises from round to round, so a source once clamped stays so, and a round is one sum over
    the sources. Two numbers reach the driver per round.
    """
    nth = F.col("nth") % len(weights)
    table = checkpoint(
        ranked(sizes, "key")
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), nth.cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * epochs)
    )
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, clamped = (total / weight if weight else 0.0), 0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        n, held, left = table.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == clamped or not left:
            break
        level, clamped = (total - held) / left, n
    share = F.lit(level) * F.col("weight")
    target = F.when(F.col("cap") < share, F.col("cap").cast("double")).otherwise(share)
    return checkpoint(table.select("key", "source_size", target.alias("target")))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[int] = (5, 2, 1),
    epochs: int = 3,
    seed: str = SEED,
    bucket_rows: int = 1_000,
) -> DataFrame:
    """The documents with mix_source_size, mix_target, mix_whole and mix_part.

    A document is taken mix_whole times whole and then for mix_part more words. All documents of a
    source are taken as often as its target allows; what remains goes to them in seeded random
    order (md5 of seed and id), the last one reached in part, so a source misses its target by less
    than a word. The running sum of that order is made per bucket of hashes and then over the
    buckets' sums, so no task sees a whole source. Sources without words have target 0. NULL ids
    sort as empty text; documents that repeat an id are taken each by its own size. Names starting
    with mix_ must be free.
    """
    n = docs.select(key).count()
    buckets = max(1, min(1 << 20, n // bucket_rows))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring("mix_order", 1, 6), 16, 10).cast("long")
    rows = (
        docs.withColumn("mix_key", source_key(F.col(source)))
        .withColumn("mix_order", order)
        .withColumn("mix_bucket", F.floor(place * buckets / (1 << 24)))
        .withColumn("mix_size", F.col(size))
    )
    sums = checkpoint(rows.groupBy("mix_key", "mix_bucket").agg(F.sum("mix_size").alias("words")))
    sizes = sums.groupBy(F.col("mix_key").alias("key")).agg(F.sum("words").alias("source_size"))
    wanted = targets(sizes, weights, epochs)
    earlier = W.partitionBy("mix_key").orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = checkpoint(
        sums.withColumn("mix_start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(wanted, F.col("mix_key") == F.col("key"))
        .select(
            "mix_key",
            "mix_bucket",
            "mix_start",
            F.col("source_size").alias("mix_source_size"),
            F.col("target").alias("mix_target"),
        )
    )
    inside = W.partitionBy("mix_key", "mix_bucket").orderBy("mix_order", key, "mix_size")
    before = F.sum("mix_size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("mix_size")
    words = F.floor("mix_target").cast("long")
    some = F.col("mix_source_size") > 0
    whole = F.when(some, F.expr("cast(floor(mix_target) as bigint) div mix_source_size")).otherwise(0)
    rest = F.when(some, words % F.col("mix_source_size")).otherwise(0)
    part = F.least(F.greatest(rest - F.col("mix_start") - before, F.lit(0)), F.col("mix_size"))
    out = rows.join(starts, ["mix_key", "mix_bucket"]).withColumn("mix_part", part)
    return out.withColumn("mix_whole", whole.cast("long")).drop(
        "mix_key", "mix_bucket", "mix_order", "mix_size", "mix_start"
    )


def repeated(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them; one taken in part ends after its words taken.

    Words of a part are joined by blanks, and its n_chars follows.
    """
    # Whole rows in one column, so that no other name of theirs meets the names made here.
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("doc"))
    mixed = mix(packed)
    copies = F.col("mix_whole") + (F.col("mix_part") > 0).cast("long")
    each = mixed.where(copies > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    partial = (F.col("mix_copy") > F.col("mix_whole")) & (F.col("mix_part") < F.col("size"))
    words = F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("mix_part").cast("int"))
    columns = {
        "text": F.when(partial, F.array_join(words, " ")).otherwise(F.col("doc.text")),
        "n_chars": F.when(partial, F.length(F.array_join(words, " ")).cast("long")).otherwise(F.col("doc.n_chars")),
    }
    return each.select(*(columns[c].alias(c) if c in columns else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def taken(docs: DataFrame) -> DataFrame:
    """`doc_id, size, source_size, target, taken` for every document."""
    sized = checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    words = F.col("mix_whole") * F.col("size") + F.col("mix_part")
    return mix(sized).select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        words.cast("long").alias("taken"),
    )


TAKEN_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS key,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
sources AS (
  SELECT key, sum(size)::BIGINT AS source_size,
    list_extract([5, 2, 1], ((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT)::BIGINT AS weight
  FROM sized GROUP BY key),
steps AS (
  SELECT *, source_size * 3 AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM sources),
filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight,
    sum(source_size) OVER () AS total
  FROM steps WINDOW w AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(max((total - held)::DOUBLE / left_weight) FILTER (
    cap >= (total - held)::DOUBLE / left_weight * weight), 0) AS level FROM filled),
wanted AS (
  SELECT key, source_size,
    CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target
  FROM steps, level),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS words,
    sum(size) OVER (PARTITION BY key ORDER BY place, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM sized JOIN wanted USING (key))
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size
    + least(greatest(words % source_size - before, 0), size) END)::BIGINT AS taken
FROM placed
"""
