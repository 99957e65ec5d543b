"""The vector index against a full scan."""

import numpy as np

from foliant.operators import retrieval as R
from foliant.operators import vector_index as X
from foliant.session import table


def frames(spark, items, queries):
    di = spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in enumerate(items)], "item_id long, vec array<float>").repartition(4)
    dq = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, vec array<float>")
    return di, dq


def answers(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in df.collect())


def clustered(seed, n, groups, wide=0.15, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, d))
    return base[rng.integers(0, groups, n)] + wide * rng.normal(size=(n, d)), rng


def test_exact_search_equals_a_full_scan_and_reads_less(spark):
    x, rng = clustered(1, 3000, 30)
    x[500:1500] = x[500]  # a third of all rows in one place, with ties
    di, dq = frames(spark, x, [*x[rng.integers(0, 3000, 12)], *rng.normal(size=(3, 12))])
    index = X.build(di, cells=60, parts=5)
    got = X.search_exact(dq, index, 10, probes=2, block=6)
    assert answers(got) == answers(R.vector_topk(dq, di, 10))
    read = {r["query_id"]: r["rows_read"] for r in got.collect()}
    assert np.median([read[q] for q in range(12)]) < 1500 and int(index.sizes.sum()) == 3000


def test_recall_and_pruned_folders(spark):
    x, rng = clustered(2, 4000, 40, wide=0.3)
    di, dq = frames(spark, x, x[::200] + 0.05 * rng.normal(size=(20, 12)))
    index = X.build(di, cells=64)
    found = X.search(dq, index, 10, probes=8)
    shares = X.recall(found, R.vector_topk(dq, di, 10), 10).collect()
    assert len(shares) == 20 and np.mean([r["recall"] for r in shares]) >= 0.9
    one = X.search(dq.where("query_id = 0"), index, 10, probes=2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "folder#") or "folder#" in plan.split("PartitionFilters: [")[1][:80]


def test_recall_on_the_given_vectors(spark):
    from foliant.plans import QUERIES

    for sf in ("sf0.01", "sf0.1"):
        rows = QUERIES["vector_index_recall"](spark, f"/root/testdata/{sf}").collect()
        assert len(rows) == table(spark, f"/root/testdata/{sf}", "embeddings").where("vec_id % 20 = 0").count()
        assert np.mean([r["recall"] for r in rows]) >= 0.9


def test_odd_rows(spark):
    di, dq = frames(spark, [[1, 0], None, [0, 0], [1, 1], [1, 1]], [[1, 1], [0, 0]])
    index = X.build(di)
    assert [(r["query_id"], r["item_id"]) for r in X.search_exact(dq.where("query_id = 0"), index, 5).orderBy("rank").collect()] == [(0, 3), (0, 4), (0, 0)]
    assert X.search(dq, index, 1).count() == 2
    empty = X.build(di.limit(0))
    assert X.search(dq, empty, 3).count() == 0 and X.search_exact(dq, empty, 3).count() == 0
    assert X.search(dq.limit(0), index, 3).count() == 0
