"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join where ``small`` has at most one row per key.

    ``small`` is repeated once per salt and the rows of ``big`` are dealt over the
    salts, so one key is worked on by up to ``salts`` tasks. The salt comes from the
    row's numbers and dates (its texts where it has none) and from its partition: exact
    copies are dealt out too, and a task that runs again deals its rows the same way in
    whatever order they arrive.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    small_types = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz")
    dealt = [c for c, kind in big.dtypes if kind in small_types or kind.startswith("decimal")] or [
        c for c, kind in big.dtypes if kind == "string"] or keys
    deal = F.pmod(F.pmod(F.xxhash64(*dealt), F.lit(salts)) + F.spark_partition_id() % salts, F.lit(salts))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "_salt", F.col("_salt").cast("bigint"))
    return big.withColumn("_salt", deal).join(copies, [*keys, "_salt"], how).drop("_salt")


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = 100_000) -> DataFrame:
    """Equi-join with a table that is meant to be small, with any number of rows per key.

    Up to ``limit`` rows it is sent to the rows of ``big``, which then stay where they are
    however few keys there are. Beyond it both sides are shuffled and adaptive execution
    splits the keys that hold too much.
    """
    few = small.count() <= limit
    return big.join(F.broadcast(small) if few else small, keys, how)
