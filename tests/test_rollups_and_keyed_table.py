"""Totals at many levels, mergeable quantiles, and the table that is updated in place."""

import glob
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from foliant.operators import rollups as U
from foliant.session import shared_folder
from foliant.sources.keyed_table import KeyedTable


def test_cube_tells_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4), ("a", "x", 8)], "k string, m string, v long")
    got = {(r["k"], r["m"], r["grouping_id"]): r["t"] for r in U.grouped_totals(rows, ["k", "m"], {"t": F.col("v")}).collect()}
    assert got == {("a", None, 0): 1, ("a", "x", 0): 10, (None, "x", 0): 4, ("a", None, 1): 11, (None, None, 1): 4, (None, None, 2): 1, (None, "x", 2): 14, (None, None, 3): 15}
    up = {(r["k"], r["m"], r["grouping_id"]): r["t"] for r in U.grouped_totals(rows, ["k", "m"], {"t": F.col("v")}, "rollup").collect()}
    assert up == {k: v for k, v in got.items() if k[2] != 2}


def test_merged_sketches_stay_within_the_bound(spark):
    rng = random.Random(1)
    values = [(i * 1_000_000, "a", rng.lognormvariate(3, 1)) for i in range(20_000)] + [(5, "a", None), (7, "b", 1.0)]
    rows = spark.createDataFrame(values, "at long, k string, v double").repartition(8)
    hours = U.merged_sketches(U.value_sketches(rows, ["k"], "at", "v", 60), ["k"], 10**9)
    got = {r["k"]: r for r in U.with_quantiles(hours, {"p50": 0.5, "p99": 0.99}).collect()}
    ordered = sorted(v for _, k, v in values if k == "a" and v is not None)
    for name, share in (("p50", 0.5), ("p99", 0.99)):
        rank = sum(v <= got["a"][name] for v in ordered) / len(ordered)
        assert abs(rank - share) <= U.RANK_ERROR
    assert got["a"]["n"] == 20_000 and (got["b"]["n"], got["b"]["p50"]) == (1, 1.0)


SCHEMA = StructType([StructField("k", LongType()), StructField("name", StringType()), StructField("version", IntegerType())])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def held(spark, tmp_path):
    return KeyedTable.create(spark, str(tmp_path / "held"), SCHEMA, ["k"], parts=8)


def test_untouched_parts_keep_their_files(spark, held):
    first = spark.createDataFrame([(i, f"n{i}", 1) for i in range(100)], SCHEMA)
    assert held.upsert(first, ["version"], "a") == list(range(8))
    before = held.newest().folders
    touched = held.upsert(spark.createDataFrame([(5, "new", 2), (5, "older", 1), (6, "old", 0)], SCHEMA), ["version"], "b")
    after = held.newest().folders
    assert 0 < len(touched) <= 2 and all((before[p] == after[p]) == (int(p) not in touched) for p in before)
    assert rows_of(held.read()) == sorted([(i, "new" if i == 5 else f"n{i}", 2 if i == 5 else 1) for i in range(100)], key=str)


def test_rerun_nulls_and_dead_writers(spark, held):
    rows = spark.createDataFrame([(None, "no key", 1), (1, None, None), (1, "x", 1), (1, "x", 1)], SCHEMA)
    held.upsert(rows, ["version"], "a")
    state = held.newest()
    assert held.upsert(rows, ["version"], "a") == [] and held.newest() == state
    assert rows_of(held.read()) == [(1, "x", 1), (None, "no key", 1)]
    # a writer that died after its files: no commit names them
    rows.withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{held.path}/data/lost")
    open(f"{held.path}/commits/tmp-lost", "w").close()
    assert rows_of(held.read()) == [(1, "x", 1), (None, "no key", 1)]
    with pytest.raises(RuntimeError):
        held._write(state)
    assert held.upsert(rows.limit(0), ["version"], "b") == [] and held.read([99]).count() == 0


def test_empty_table(spark, held):
    assert held.read().count() == 0 and held.read().columns == ["k", "name", "version"]
    assert glob.glob(f"{held.path}/commits/*.json") and shared_folder(spark)
