"""Joins and counts over intervals and points in time, and request budgets, for keys of any size.

What looks back over a key is a running value (``ordered.running``), so a key that holds a large
share of the rows is worked on in parts. Intervals are half open; one that does not end after its
start overlaps nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.ordered import Run, running


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: str, values: list[str], **kw) -> DataFrame:
    """Add to each row of ``left`` the ``values`` of the latest row of ``right`` of its keys, at its time or before.

    Of right rows at one time the one with the largest ``tie`` counts (a column of both sides, unique with the time in each).
    Both sides are merged by time and the last right row is carried along; null where there is none. Rows without a
    time find nothing.
    """
    kind = [f"_v_{v}" for v in values]
    found = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), *[F.col(v).alias(v) for v in values])
    shape = right.select(found.alias("f")).schema["f"].dataType
    ours = left.select(F.struct("*").alias("_row"), *keys, at, tie, F.lit(1).alias("_kind"), F.lit(None).cast(shape).alias("_seen"))
    theirs = right.where(F.col(at).isNotNull()).select(
        F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"), *keys, at, tie, F.lit(0).alias("_kind"), found.alias("_seen"))
    carried = running(ours.unionByName(theirs), keys, [at, "_kind", tie], [Run("_last", "max", F.col("_seen"))], **kw)
    out = carried.where("_kind = 1").select("_row.*", *[F.col(f"_last.{v}").alias(k) for v, k in zip(values, kind)])
    return out.select(*left.columns, *[F.col(k).alias(v) for v, k in zip(values, kind)])


def overlap_counts(rows: DataFrame, keys: list[str], id_col: str, start: str, end: str, name: str = "overlaps", **kw) -> DataFrame:
    """(id, name): how many other intervals of the same keys each interval overlaps, without making pairs.

    That is the number that began before its end, less those that ended by its start, less itself.
    """
    points = F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("begins")), F.struct(F.col(end).alias("at"), F.lit(0).alias("begins"))))
    real = rows.where(F.col(end) > F.col(start))
    steps = real.select(*keys, F.col(id_col).alias("_id"), points.alias("p")).select(*keys, "_id", "p.*")
    # at one instant ends come before starts: what ends there is over, and what starts there has not begun
    seen = running(steps, keys, ["at", "begins", "_id"], [Run("begun", "sum", F.col("begins")), Run("over", "sum", 1 - F.col("begins"))], **kw)
    share = F.when(F.col("begins") == 0, F.col("begun")).otherwise(-F.col("over"))
    counts = seen.groupBy(F.col("_id").alias(id_col)).agg((F.sum(share) - 1).cast("bigint").alias(name))
    idle = rows.where(~(F.col(end) > F.col(start)) | F.col(start).isNull() | F.col(end).isNull()).select(id_col, F.lit(0).cast("bigint").alias(name))
    return counts.unionByName(idle)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """All overlapping pairs as ``l`` and ``r`` (structs of the rows), each once.

    Both sides are filed under the stretches of time that they touch, and a pair is made in the stretch where the later
    of the two begins. The stretch is by default the mean length of all intervals, so that a side grows to about twice
    its rows, however long single intervals are.
    """
    spans = left.select(start, end).unionByName(right.select(start, end)).where(F.col(end) > F.col(start))
    if width is None:
        width = int(spans.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 0) + 1
    slot = lambda c: F.floor(c / width)

    def filed(df: DataFrame, name: str) -> DataFrame:
        real = df.where(F.col(end) > F.col(start))
        return real.select(
            F.struct("*").alias(name), *[F.col(k).alias(f"_{k}") for k in keys],
            F.explode(F.sequence(slot(F.col(start)), slot(F.col(end) - 1))).alias("_slot"))

    ours, theirs = filed(left, "l"), filed(right, "r")
    ls, le, rs, re_ = (F.col(c) for c in (f"l.{start}", f"l.{end}", f"r.{start}", f"r.{end}"))
    met = ours.join(theirs, [*[f"_{k}" for k in keys], "_slot"])
    return met.where((ls < re_) & (rs < le) & (F.col("_slot") == slot(F.greatest(ls, rs)))).select("l", "r")


def budget_levels(requests: DataFrame, key: str, at_us: str, id_col: str, rate: int, per_us: int, name: str = "level", **kw) -> DataFrame:
    """Add the fill of each key's bucket right after each request: every request adds one, ``rate`` in ``per_us`` drain.

    The level follows e = max(e - drained, 0) + 1. Unrolled, it is the number of requests less what drained so far, less
    the least value which that difference had just before a request: a running count and a running maximum, so no
    request waits for the one before it. Levels are whole numbers in units of 1 / ``per_us`` request.
    """
    placed = running(requests, [key], [at_us, id_col], [Run("_n", "count")], **kw)
    balance = F.col("_n") * per_us - F.col(at_us) * rate
    lowest = running(placed.withColumn("_s", balance), [key], [at_us, id_col], [Run("_m", "max", -F.col("_s"))], **kw)
    return lowest.withColumn(name, F.col("_s") + F.col("_m") + per_us).drop("_n", "_s", "_m")


def burst_breaches(requests: DataFrame, key: str, at_us: str, id_col: str, rate: int, per_us: int, burst: int, **kw) -> DataFrame:
    """Requests that come when their key's bucket holds more than ``burst`` requests beyond the one just made."""
    return budget_levels(requests, key, at_us, id_col, rate, per_us, **kw).where(F.col("level") > (burst + 1) * per_us)
