import random

import foliant.llm.components as C
from foliant.session import cut_lineage


def components_of(spark, monkeypatch, edges):
    """Labels, and how many rounds were stored."""
    stored = []
    with monkeypatch.context() as m:
        m.setattr(C, "cut_lineage", lambda df: stored.append(1) or cut_lineage(df))
        got = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    return {r["node"]: r["label"] for r in got}, len(stored) - 1


def test_components_take_no_round_for_stars(spark, monkeypatch):
    assert components_of(spark, monkeypatch, [(1, 5), (7, 1), (1, 9), (2, 4), (4, 2), (3, 3)]) == ({1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 4: 2}, 0)
    assert components_of(spark, monkeypatch, []) == ({}, 0)


def test_components_of_chains_and_random_edges(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(60)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(want)):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got, rounds = components_of(spark, monkeypatch, edges)
    assert got == want and rounds > 0
