"""Finding hot entities."""

from pyspark.sql import functions as F

from tripfold.operators.hot import by_heat, hot_entities
from tripfold.schema import HotRule


def skewed(spark):
    even = spark.range(20_000).select((F.col("id") % 2_000).alias("entity_id"))
    return even.union(spark.range(10_000).select(F.lit(77).cast("bigint").alias("entity_id")))


def test_a_third_in_one_entity_is_found(spark):
    assert hot_entities(skewed(spark), HotRule(buckets=4_096, min_rows=100)) == [77]


def test_even_entities_are_not_hot(spark):
    even = skewed(spark).where("entity_id <> 77")
    assert hot_entities(even, HotRule(buckets=4_096, min_rows=100)) == []
    assert hot_entities(even.limit(0)) == []


def test_small_tables_are_left_alone(spark):
    assert hot_entities(skewed(spark)) == []


def test_text_ids(spark):
    rows = skewed(spark).withColumn("entity_id", F.concat(F.lit("e"), "entity_id"))
    assert hot_entities(rows, HotRule(buckets=4_096, min_rows=100)) == ["e77"]


def test_split_keeps_every_row(spark):
    seen = []

    def build(rows, spread):
        seen.append(spread)
        return rows.withColumn("spread", F.lit(spread))

    rows = by_heat(skewed(spark), [77], build)
    assert seen == [False, True]
    assert rows.count() == 30_000
    assert rows.where("spread <> (entity_id = 77)").count() == 0
