"""Totals at many levels, and quantile sketches that are stored by window and merged upward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.traffic import bucket

#: Size of a sketch. Merged as often as one likes, a quantile's rank is then off by less than RANK_ERROR (99 of 100 times
#: by less than half of it).
SKETCH = 400
RANK_ERROR = 0.02


def grouped_totals(rows: DataFrame, keys: list[str], sums: dict[str, Column], sets: list[list[str]] | str = "cube") -> DataFrame:
    """Sums over grouping sets of ``keys``: ``"cube"``, ``"rollup"``, or a list of lists of keys.

    The rows are summed by all keys first. So what is repeated for the sets is one row for each combination of keys and
    not each row, and a busy combination is put together before it is shuffled. ``grouping_id`` has a bit for each key,
    the first key's the highest, that is set where the key is summed over; it tells a null that stands for all values
    from a null in the data.
    """
    base = rows.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    totals = [F.sum(k).alias(k) for k in sums]
    level = F.grouping_id().cast("bigint").alias("grouping_id")
    if sets == "cube":
        return base.cube(*keys).agg(level, *totals)
    if sets == "rollup":
        return base.rollup(*keys).agg(level, *totals)
    return base.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(level, *totals)


def value_sketches(rows: DataFrame, keys: list[str], at_us: str, value: str, seconds: int, size: int = SKETCH) -> DataFrame:
    """(window_sec, keys, n, sketch): what a window keeps of its values; rows without a value count for nothing."""
    some = rows.where(F.col(value).isNotNull())
    return some.groupBy(bucket(F.col(at_us), seconds).alias("window_sec"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str], seconds: int, size: int = SKETCH) -> DataFrame:
    """Sketches of wider windows, or of fewer keys, from stored ones; the values are not read again."""
    wider = (F.floor(F.col("window_sec") / seconds) * seconds).cast("bigint").alias("window_sec")
    return sketches.groupBy(wider, *keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def with_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Add a column for each named share."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in shares.items()})
