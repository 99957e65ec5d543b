"""Joins with small tables: skewed keys, and fallback lists in order."""

from pyspark.sql import functions as F

from foliant.operators import traffic as T
from foliant.operators.joins import salted_join, small_join


def requests(spark, n=4000):
    hot = F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 7).cast("string")))
    return spark.range(n).select(
        F.col("id").alias("request_id"), hot.alias("model"), (F.col("id") * 1000).alias("start_us"), F.lit(500).alias("status"),
        F.lit(10).alias("prompt_tokens"))


def test_limits_with_a_hot_model(spark):
    limits = spark.createDataFrame([("second", "hot", 100), ("second", "m1", 1000)], "span string, model string, max_requests int")
    got = T.limit_breaches(requests(spark), "model", limits).collect()
    assert [(r["model"], r["requests"]) for r in got] == [("hot", 900)] * 4


def test_small_join_in_both_ways(spark):
    table = spark.createDataFrame([("hot", 5), ("m1", 50)], "model string, context_window int")
    n = requests(spark).where("model = 'hot'").count()
    assert T.over_context(requests(spark), table).count() == n
    assert small_join(requests(spark), table, ["model"], limit=1).where("prompt_tokens > context_window").count() == n


def test_fallback_lists(spark):
    lists = spark.createDataFrame([("hot", "b", 2), ("hot", "a", 1), ("m1", "hot", 1), ("m2", "x", 1)], "model string, fallback string, place int")
    got = {(r["model"], r["fallback_1"], r["fallback_2"]) for r in T.with_fallbacks(requests(spark), lists).collect()}
    assert {("hot", "a", "b"), ("m1", "hot", "a"), ("m2", "x", None), ("m3", None, None)} <= got
    assert T.with_fallbacks(requests(spark), lists).count() == 4000


def test_salted_join_takes_maps(spark):
    big = requests(spark, 50).withColumn("scan", F.create_map(F.lit("a"), F.lit(1)))
    small = spark.createDataFrame([("hot", 1)], "model string, x int")
    assert salted_join(big, small, ["model"], "left").where("x = 1").count() == 45
