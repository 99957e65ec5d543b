"""Running values over ordered groups of any size.

A plain window sends each group to one task. That is right while groups are
moderate, and it is what :func:`running` does after it has measured the largest
group. Beyond the limit a group is range-partitioned by its order, each part is
summed on its own, and the totals of the earlier parts are carried in. One key
may then hold most of the table without becoming one long task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.operators.joins import salted_join
from foliant.session import cut_lineage

GROUP_LIMIT = 5_000_000
#: Rows that a task of a window sorts, where no single group has more.
PART_ROWS = 500_000


@dataclass(frozen=True)
class Run:
    """One running value: ``kind`` is sum, count, max or xor (exclusive or of longs) over ``value``.

    With ``exclusive`` the current row is left out.
    """

    name: str
    kind: str
    value: Column | None = None
    exclusive: bool = False

    def fold(self) -> Column:
        value = F.lit(1) if self.value is None else self.value
        return self.merge(value)

    def merge(self, value: Column | str) -> Column:
        """The aggregate that folds rows, or the totals of parts."""
        return {"max": F.max, "xor": F.bit_xor}.get(self.kind, F.sum)(value)

    def empty(self) -> Column:
        return F.lit(None) if self.kind == "max" else F.lit(0)

    def plus(self, local: Column, carry: Column) -> Column:
        if self.kind == "max":
            return F.greatest(local, carry)
        if self.kind == "xor":
            return F.coalesce(local, F.lit(0)).bitwiseXOR(F.coalesce(carry, F.lit(0)))
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    counts = df.groupBy(*keys).count() if keys else df.groupBy().count()
    return counts.agg(F.max("count")).first()[0] or 0


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all."""
    counts = df.groupBy(*keys).count() if keys else df.groupBy().count()
    largest, rows = counts.agg(F.max("count"), F.sum("count")).first()
    return largest or 0, rows or 0


def dealt(df: DataFrame, keys: list[str], rows: int, part_rows: int | None = None) -> DataFrame:
    """Whole groups over partitions of about ``PART_ROWS`` rows.

    Adaptive execution joins shuffled partitions by their packed size, and a window over narrow rows that
    pack well then sorts many times that in one task. So the partitions of a large table are counted by rows.
    """
    most = PART_ROWS if part_rows is None else part_rows
    return df if rows <= most else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)


def with_parts(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Add ``_part``, a number that rises with (keys, order), of even row counts.

    The part numbers are stored in the shared folder, so a lost executor can not
    change them between the two uses that a running value makes of them.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(max(n, 1), *keys, *order)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def _frame(keys: list[str], order: list[str], exclusive: bool):
    # A window without keys only ever meets the rows of one part or a checked small frame.
    window = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return window.rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    runs: list[Run],
    group_limit: int = GROUP_LIMIT,
    known_largest: int | None = None,
    known_rows: int = 0,
) -> DataFrame:
    """Add running values per ``keys`` in ascending ``order`` (which must be unique in a group).

    Without keys the whole table is one group and is always summed in parts. With ``known_largest``
    the rows are not counted; they are dealt by ``known_rows``, or not at all.
    """
    largest, rows = group_sizes(df, keys) if known_largest is None else (known_largest, known_rows)
    if keys and largest <= group_limit:
        out = dealt(df, keys, rows)
        for run in runs:
            value = run.fold().over(_frame(keys, order, run.exclusive))
            out = out.withColumn(run.name, value if run.kind == "max" else F.coalesce(value, F.lit(0)))
        return out

    split = with_parts(df, keys, order, max(largest // group_limit + 1, int(
        df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    totals = split.groupBy(*keys, "_part").agg(*[r.fold().alias(f"_t_{r.name}") for r in runs])
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_k_part"),
        *[
            r.merge(f"_t_{r.name}").over(earlier).alias(f"_c_{r.name}")
            for r in runs
        ],
    )
    local = split
    for run in runs:
        local = local.withColumn(run.name, run.fold().over(_frame([*keys, "_part"], order, run.exclusive)))
    on = F.col("_part") == F.col("_k_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carry, on, "left")
    for run in runs:
        joined = joined.withColumn(run.name, run.plus(F.col(run.name), F.col(f"_c_{run.name}")))
    return joined.select(*df.columns, *[r.name for r in runs])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, **kw) -> DataFrame:
    """One-based position per ``keys`` in ascending ``order``."""
    return running(df, keys, order, [Run(name, "count")], **kw)


def trailing_mean(df: DataFrame, order: list[str], value: str, n: int, name: str, block: int = 100_000,
                  **kw) -> DataFrame:
    """Mean of the last ``n`` values up to each row, over the whole ordered frame.

    Rows are numbered, cut into blocks, and the last ``n - 1`` rows of a block are
    also handed to the next one, so each block is worked out on its own.
    """
    size = max(block, n)
    numbered = row_numbers(df, [], order, "_rn", **kw)
    home = F.floor((F.col("_rn") - 1) / size)
    tail = ((F.col("_rn") - 1) % size) > size - n
    spread = numbered.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    # sums from the start of a block, less the sum n rows back: each row is added once
    window = W.partitionBy("_block").orderBy("_rn")
    upto = spread.withColumn("_sum", F.sum(value).over(window.rowsBetween(W.unboundedPreceding, 0)))
    last = F.col("_sum") - F.coalesce(F.lag("_sum", n).over(window), F.lit(0))
    out = upto.withColumn(name, last / F.least(F.col("_rn"), F.lit(n))).where("_block = _home")
    return out.select(*df.columns, F.col("_rn").alias("position"), name)


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float],
                 also: dict[str, Column] | None = None, round_up: bool = False, **kw) -> DataFrame:
    """The ``int(n * share)``-th smallest value per group, for each named share.

    With ``round_up`` the place is rounded up, so that small groups have a value too.

    ``also`` names further aggregates of the group, taken in the same pass as its size.

    Equal values are counted first, so what is ranked is the distinct values.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, [value], [Run("_upto", "sum", F.col("_n"))], **kw)
    also = also or {}
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), *[c.alias(n) for n, c in also.items()])
    hit = salted_join(ranked, totals, keys)
    picks = []
    for name, share in shares.items():
        place = (F.ceil if round_up else F.floor)(F.col("_total") * F.lit(share))
        inside = (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)
        picks.append(F.max(F.when(inside, F.col(value))).alias(name))
    return hit.groupBy(*keys).agg(*[F.first(n).alias(n) for n in also], *picks)
