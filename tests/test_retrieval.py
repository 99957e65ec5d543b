"""Retrieval and reranking against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import rerank as K
from foliant.operators import retrieval as R

WORDS = "alpha beta gamma delta epsilon zeta omega sigma kappa lambda".split()


def test_vector_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(300, 8))
    items[50:120] = items[50]  # many copies: ties go to the smaller id
    queries = np.vstack([rng.normal(size=(5, 8)), items[50:51]])
    di = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, vec array<double>").repartition(4)
    dq = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vec array<double>")
    n = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(n(queries) @ n(items).T, 12)  # copies tie whatever order they are summed in
    for block in (100, 2):
        got = R.vector_topk(dq, di, 7, block=block, digits=12).collect()
        for q in range(len(queries)):
            want = sorted(range(len(items)), key=lambda i: (-sims[q, i], i))[:7]
            assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_near_ties_are_told_apart(spark):
    """Down to the stated digits; below them ties go to the smaller id."""
    dq = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, vec array<double>")
    for gap, best in ((1e-4, 3), (1e-7, 1)):
        items = [(i, [1.0, 2.0, 3.0 + (3 - i) * gap]) for i in range(1, 6)]
        di = spark.createDataFrame(items, "item_id long, vec array<double>")
        assert [r.item_id for r in R.vector_topk(dq, di, 1).collect()] == [best]


def test_bm25_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(WORDS, weights=range(10, 0, -1), k=rnd.randint(1, 30))) for _ in range(120)] + [""]
    asks = [" ".join(rnd.sample(WORDS, 3)) for _ in range(9)] + ["nothing matches"]
    di = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(3)
    dq = spark.createDataFrame(list(enumerate(asks)), "query_id long, text string")
    toks = [t.split() for t in texts]
    n, avg = len(texts), sum(map(len, toks)) / len(texts)
    df = Counter(w for t in toks for w in set(t))

    def score(q, t):
        tf = Counter(t)
        return round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avg))
                         for w in set(q.split()) if w in tf), 12)

    for block in (1000, 6):
        got = R.bm25_topk(dq, di, 5, block=block, digits=12).collect()
        for i, q in enumerate(asks):
            s = {j: score(q, t) for j, t in enumerate(toks)}
            want = [j for j in sorted(s, key=lambda j: (-s[j], j)) if s[j] > 0][:5]
            assert [r.item_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


def candidates(spark):
    rnd = random.Random(1)
    rows = [(q, f"c{i}", "src" if i % 3 else f"s{i}", None if i % 4 == 0 else f"sec{i % 2}", [1], False, False, round(rnd.random(), 2), i)
            for q in (1, 2) for i in range(4 if q == 2 else 60)]
    schema = "query_id long, chunk_id string, source string, section string, pages array<int>, has_table boolean, has_image boolean, score double, idx int"
    return rows, spark.createDataFrame(rows, schema)


def test_diversity_equals_a_walk(spark):
    rows, df = candidates(spark)
    for limit in (1000, 8):  # the second forces the split of the hot query
        got = {(r.query_id, r.idx): r.adjusted for r in R.diversify(df, 10, 0.5, group_limit=limit).collect()}
        for q in (1, 2):
            mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[7], r[8]))
            sources, sections = Counter(), Counter()
            for r in mine:
                want = r[7] if len(mine) <= 10 else r[7] * (1 - (sources[r[2]] * 0.1 + sections[r[2], r[3]] * 0.2) * 0.5)
                assert abs(got[q, r[8]] - want) < 1e-12
                sources[r[2]] += 1
                sections[r[2], r[3]] += 1


def test_filters_and_citations(spark):
    _, df = candidates(spark)
    none = {f"f_{n}": F.lit(None).cast("string") for n in ("section", "file", "content_type")}
    base = df.withColumns({"f_page": F.lit(None).cast("int"), **none})
    assert R.filter_results(base).count() == 64
    assert R.filter_results(base.withColumn("f_section", F.lit("SEC1"))).where("section IS NULL").count() == 0
    assert R.filter_results(base.withColumn("f_content_type", F.lit("table"))).count() == 0
    pages = spark.createDataFrame([([],), ([4],), ([5, 4],), ([9, 4, 6],)], "p array<int>")
    got = [r[0] for r in pages.select(R.result_citation(F.lit("f"), F.lit(None).cast("string"), F.col("p"))).collect()]
    assert got == [None, "[f, p. 4]", "[f, pp. 4, 5]", "[f, pp. 4-9]"]


def test_citation_numbers(spark):
    res = spark.createDataFrame([(1, 1, "[a]"), (1, 2, "[b]")], "query_id long, rank int, citation string")
    texts = ["x [1] y", "[1][2]", "[99] [01]", "none", "[2][2]"]
    resp = spark.createDataFrame([(1, t) for t in texts], "query_id long, response string")
    assert sorted(r.response for r in R.expand_citations(resp, res).collect()) == sorted(["x [a] y", "[a][b]", "[99] [01]", "none", "[b][b]"])
    refs = Counter(r.ref for r in R.resolve_citations(resp, res).collect())
    assert refs == Counter({1: 2, 2: 3})


def test_query_analysis(spark):
    q = spark.createDataFrame([("Look at page 12 of chapter 'Two' and the Figure",), ("plain?",)], "t string")
    a, b = [r[0] for r in q.select(R.analyze_query(F.col("t"))).collect()]
    assert (a.page, a.section, a.content_type) == (12, "Two", "figure") and b.page is None and b.keywords == ["plain"]
    assert [len(r[0]) for r in q.select(R.expand_query(F.col("t"))).collect()] == [5, 3]


def pairs(spark):
    rows = [(1, i, "what is omega", t) for i, t in enumerate(["omega is last", "what", "none here", "omega what is", ""])]
    return spark.createDataFrame(rows, "query_id long, doc_index int, query string, text string")


def test_rank_and_model(spark):
    scored = K.score_pairs(pairs(spark))
    top = K.rank_pairs(scored, 2).orderBy("rank").collect()
    assert [r.doc_index for r in top] == [3, 0] and len(K.rank_pairs(scored).collect()) == 5

    def load():
        def model(queries, texts):
            if "none here" in texts:
                raise ValueError
            return [(float(len(t)), 0.0) for t in texts]
        return model

    got = {r.doc_index: r.score for r in K.score_pairs(pairs(spark), load, batch=1).collect()}
    assert got == {0: 13.0, 1: 4.0, 2: 0.0, 3: 13.0, 4: 0.0}


def test_fingerprints_see_every_document_and_their_order(spark):
    base = [(1, i, "q", f"d{i}") for i in range(60)]
    other = [(2, i, "q", f"d{i}" if i != 55 else "changed") for i in range(60)]
    swapped = [(3, i, "q", f"d{59 - i}") for i in range(60)]
    same = [(4, i, "q", f"d{i}") for i in range(60)]
    df = spark.createDataFrame(base + other + swapped + same, "query_id long, doc_index int, query string, text string")
    f = {r.query_id: r.fingerprint for r in K.fingerprints(df).collect()}
    assert f[1] == f[4] and len(set(f.values())) == 3


def test_reuse_within_ttl(spark):
    req = spark.createDataFrame([("a", 1000), ("a", 1601), ("b", 1000)], "fingerprint string, sec long")
    old = spark.createDataFrame([("a", 900), ("a", 1000)], "fingerprint string, stored_sec long")
    assert sorted((r.fingerprint, r.sec, r.reuse) for r in K.reusable(req, old, 600).collect()) == [("a", 1000, True), ("a", 1601, False), ("b", 1000, False)]


def test_no_python_cross_join_in_plans(spark):
    from foliant.plans import QUERIES
    for name in ("bm25_topk", "vector_topk", "rerank_top", "result_top"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), name
