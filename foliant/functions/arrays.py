"""Column helpers for arrays: single evaluation, run splitting, ordered joining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Without this the optimizer may inline an expensive expression at each use,
    also inside the per-element function of a higher-order function.
    """
    return F.transform(F.array(value), body)[0]


def indexed(items: Column) -> Column:
    """array<struct<i, v>> with zero-based positions."""
    return F.transform(items, lambda v, i: F.struct(i.alias("i"), v.alias("v")))


def positions(items: Column, test: Callable[[Column], Column]) -> Column:
    """Zero-based positions of the elements that pass ``test``."""
    return F.transform(
        F.filter(
            F.transform(items, lambda v, i: F.struct(i.alias("i"), test(v).alias("ok"))),
            lambda s: s["ok"],
        ),
        lambda s: s["i"],
    )


def cut_at(items: Column, starts: Column) -> Column:
    """Slice ``items`` into consecutive runs that begin at ``starts``.

    Every element is copied once, so the cost is linear in the array length.
    """
    def run(all_starts: Column, s: Column, j: Column) -> Column:
        return bind(F.coalesce(F.get(all_starts, j + 1), F.size(items)), lambda stop: F.struct(
            s.alias("start"), (stop - 1).alias("end"), F.slice(items, s + 1, stop - s).alias("items")))

    return bind(starts, lambda st: F.transform(st, lambda s, j: run(st, s, j)))


def sorted_join(pairs: Column, sep: str) -> Column:
    """Join the text of array<struct<order, text>> in order."""
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p["text"]), sep)


def distinct_sorted(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def explode_indexed(df: DataFrame, ids: list, array: str | Column, index: str, value: str) -> DataFrame:
    """One row per element with its position; empty and null arrays give no row.

    The outer form is used on purpose: for the plain form the optimizer adds a
    size filter below the generator, which would work out a computed array twice.
    """
    rows = df.select(*ids, F.posexplode_outer(array).alias(index, value))
    return rows.where(F.col(index).isNotNull())
