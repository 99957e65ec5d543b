"""Long word lists against plain substring tests."""

import random

import pytest

from foliant.operators import wordlists as L


def brute(texts, terms, fold=True):
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    known = sorted({low(t) for t in terms if t})
    return sorted((i, tuple(t for t in known if text and t in low(text))) for i, text in texts)


@pytest.mark.parametrize("lot,fold", [(2_000_000, True), (40, True), (40, False)])
def test_against_substrings(spark, lot, fold):
    rng = random.Random(lot)
    word = lambda n: "".join(rng.choice("abAé ") for _ in range(n))
    terms = [word(rng.randint(1, 4)) for _ in range(60)] + [None, "", "overlap", "lap", "over"]
    texts = [(i, word(rng.randint(0, 60))) for i in range(80)] + [(80, None), (81, "Overlapping"), (81, "Overlapping"), (81, "other")]
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, text string, terms string")
    got = L.find_terms(rows, spark.createDataFrame([(t,) for t in terms], "term string"), ["id"], fold=fold, lot=lot).collect()
    assert sorted((r["id"], tuple(r["terms"])) for r in got) == brute(texts, terms, fold)


def test_hundred_thousand_terms(spark):
    terms = spark.range(100_000).selectExpr("concat('term', id, 'x') AS term")
    rows = spark.createDataFrame([(1, "a term77777x b TERM5x"), (2, "term100000x term12"), (3, "x" * 500_000)], "id long, text string")
    got = {r["id"]: list(r["terms"]) for r in L.find_terms(rows, terms, ["id"], lot=600_000).collect()}
    assert got == {1: ["term5x", "term77777x"], 2: [], 3: []}


def test_empty_lists_and_tables(spark):
    none = spark.createDataFrame([(None,), ("",)], "term string")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert [list(r["terms"]) for r in L.find_terms(rows, none, ["id"]).collect()] == [[], []]
    assert L.find_terms(rows.limit(0), spark.createDataFrame([("a",)], "term string"), ["id"]).count() == 0
