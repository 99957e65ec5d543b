"""Interval and as-of joins and request budgets against plain loops, with one key that holds most rows."""

import random

import pytest

from foliant.operators import intervals as V

LIMITS = [{}, {"group_limit": 20}]  # one window a key, or parts


def some(seed, n, longest=30):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaab"), rng.randrange(200), 0) for i in range(n)]
    return [(i, k, s, s + rng.choice([0, 1, rng.randrange(1, longest)])) for i, k, s, _ in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, s long, e long")


@pytest.mark.parametrize("kw", LIMITS)
def test_asof(spark, kw):
    left, right = some(1, 90), [(1000 + r[0], *r[1:]) for r in some(2, 60)]
    dl = frame(spark, [*left, (99, None, 5, 6), (98, "a", None, None), (97, "z", 5, 6)])
    dr = frame(spark, [*right, (1999, None, 1, 2), (1998, "a", None, None)]).withColumnRenamed("e", "v")
    got = V.asof_join(dl.drop("v"), dr, ["k"], "s", "id", ["v"], **kw).collect()
    want = {}
    for i, k, s, _ in left:
        best = max(((q[2], q[0], q[3]) for q in right if q[1] == k and q[2] <= s), default=None)
        want[i] = best and best[2]
    want |= {99: 2, 98: None, 97: None}
    assert {r["id"]: r["v"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("kw", LIMITS)
def test_overlap_counts_and_pairs(spark, kw):
    rows = some(3, 150)
    meets = lambda a, b: a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2]
    got = {r["id"]: r["overlaps"] for r in V.overlap_counts(frame(spark, rows), ["k"], "id", "s", "e", **kw).collect()}
    assert got == {a[0]: sum(meets(a, b) for b in rows if b[0] != a[0]) for a in rows}
    left, right = rows[:70], [*rows[70:], (500, "a", 0, 100_000)]
    for width in (None, 1, 1000):
        pairs = V.overlap_join(frame(spark, left), frame(spark, right), ["k"], "s", "e", width).collect()
        assert sorted((p["l"]["id"], p["r"]["id"]) for p in pairs) == sorted((a[0], b[0]) for a in left for b in right if meets(a, b))


@pytest.mark.parametrize("kw", LIMITS)
def test_budget(spark, kw):
    rows = some(4, 200)
    got = {r["id"]: r["level"] for r in V.budget_levels(frame(spark, rows), "k", "s", "id", 3, 10, **kw).collect()}
    want, last = {}, {}
    for i, k, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        level, at = last.get(k, (0, s))
        level = max(level - 3 * (s - at), 0) + 10
        last[k], want[i] = (level, s), level
    assert got == want
    assert V.burst_breaches(frame(spark, rows), "k", "s", "id", 3, 10, 2, **kw).count() == sum(v > 30 for v in want.values())


def test_empty(spark):
    none = frame(spark, some(1, 1)).limit(0)
    assert V.overlap_counts(none, ["k"], "id", "s", "e").count() == 0
    assert V.overlap_join(none, none, ["k"], "s", "e").count() == 0
    assert V.asof_join(none, none.withColumnRenamed("e", "v"), ["k"], "s", "id", ["v"]).count() == 0
    assert V.budget_levels(none, "k", "s", "id", 1, 1).count() == 0
