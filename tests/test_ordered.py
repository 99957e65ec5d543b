"""Running values must not depend on how a group is cut, also when one key is hot."""

import random

from pyspark.sql import functions as F

from foliant.operators.joins import salted_join
from foliant.operators.ordered import Run, nearest_rank, row_numbers, running, trailing_mean
from foliant.operators.traffic import cache_effect, peak_concurrency


def skewed(spark, n=600):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 17}", rnd.randint(0, 40), i, rnd.randint(1, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, o int, i int, v int").repartition(5)


def test_split_groups_equal_whole_groups(spark):
    rows, df = skewed(spark)
    runs = [Run("n", "count"), Run("s", "sum", F.col("v")), Run("before", "sum", F.col("v"), True), Run("top", "max", F.col("v"), True)]
    whole = running(df, ["k"], ["o", "i"], runs)
    split = running(df, ["k"], ["o", "i"], runs, group_limit=20)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    want, state = {}, {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, s, top = state.get(k, (0, 0, None))
        want[i] = (n + 1, s + v, s, top)
        state[k] = (n + 1, s + v, v if top is None else max(top, v))
    assert {r.i: (r.n, r.s, r.before, r.top) for r in split.collect()} == want


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(50)], "k string, i int")
    out = row_numbers(df, ["k"], ["i"], "n", group_limit=10).collect()
    assert sorted(r.n for r in out if r.k is None) == list(range(1, 51))


def test_trailing_mean_over_blocks(spark):
    vals = [(i, (i * 37) % 11) for i in range(250)]
    df = spark.createDataFrame(vals, "i int, v int")
    for kw in ({}, {"group_limit": 30}):
        got = {r.i: r.m for r in trailing_mean(df, ["i"], "v", 40, "m", block=45, **kw).collect()}
        for i, _ in vals:
            part = [v for _, v in vals[max(0, i - 39):i + 1]]
            assert abs(got[i] - sum(part) / len(part)) < 1e-9


def test_nearest_rank_on_hot_key(spark):
    rows, df = skewed(spark)
    got = {r.k: (r.p50, r.p95) for r in nearest_rank(df, ["k"], "o", {"p50": 0.5, "p95": 0.95}, group_limit=5).collect()}
    for k in {r[0] for r in rows}:
        vals = sorted(r[1] for r in rows if r[0] == k)
        pick = lambda p: vals[int(len(vals) * p) - 1] if int(len(vals) * p) >= 1 else None
        assert got[k] == (pick(0.5), pick(0.95))


def test_peak_counts_ends_before_starts(spark):
    rows = [(1, 0, 10), (2, 10, 20), (3, 5, 15), (4, 5, 5)]
    df = spark.createDataFrame(rows, "request_id int, start_us long, end_us long")
    assert peak_concurrency(df).first().peak == 2
    assert peak_concurrency(df, group_limit=2).first().peak == 2


def test_cache_effect_with_one_hot_fingerprint(spark):
    rows = [("f", i * 10, i) for i in range(60)] + [("g", 0, 100), ("g", 1000, 101)]
    df = spark.createDataFrame(rows, "fingerprint string, start_us long, request_id int")
    out = cache_effect(df, 10, ["start_us", "request_id"], group_limit=7)
    assert {r.request_id for r in out.where("hit").collect()} == set(range(1, 60))


def test_salted_join_keeps_all_rows(spark):
    big = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), ("c", 2)], "k string, i int")
    small = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string")
    assert salted_join(big, small, ["k"]).count() == 41
    assert salted_join(big, small, ["k"], "left").count() == 42
    assert salted_join(big, small, ["k"], "left_anti").count() == 1
    assert salted_join(big, small, ["k"], "left_semi").count() == 41


def test_scratch_tables_go(spark):
    import os

    from foliant.session import cut_lineage, scratch, shared_folder

    kept = cut_lineage(spark.range(3))
    home = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(home))
    with scratch():
        assert cut_lineage(spark.range(5)).count() == 5
        assert set(os.listdir(home)) > before
    assert set(os.listdir(home)) == before and kept.count() == 3


def test_parts_of_a_window_are_counted_by_rows(spark, monkeypatch):
    import foliant.operators.ordered as O
    import foliant.operators.sheets as H

    monkeypatch.setattr(O, "PART_ROWS", 100)
    rows = spark.range(3000).select(F.lit("d").alias("doc"), F.concat(F.lit("s"), (F.col("id") % 60).cast("string")).alias("sheet"),
                                    F.floor(F.col("id") / 60).alias("row"), F.array(F.col("id").cast("string")).alias("cells"))
    for out in (row_numbers(rows, ["sheet"], ["row"], "n"), H.page_segments(rows)):
        assert out.count() == 3000
        assert max(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) <= 800  # not all in one
    assert {r["n"] - r["row"] for r in row_numbers(rows, ["sheet"], ["row"], "n").collect()} == {1}
