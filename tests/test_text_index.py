"""The text index against scoring everything."""

import random

import pytest

from foliant.operators import retrieval as R
from foliant.operators import text_index as I


def frames(spark, seed, n, words=60):
    rng = random.Random(seed)
    pool = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rng.choices(pool, weights, k=rng.randint(1, 40))) for _ in range(n)]
    asks = [" ".join(rng.sample(pool, rng.randint(1, 6))) for _ in range(15)] + ["nothing here", ""]
    di = spark.createDataFrame([*enumerate(texts), (n, ""), (n + 1, None)], "item_id long, text string").repartition(4)
    return di, spark.createDataFrame(list(enumerate(asks)), "query_id long, text string")


def answers(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("shard,block,cut", [(50_000, 128, 200_000), (100, 4, 8)])
def test_equals_scoring_everything(spark, shard, block, cut):
    di, dq = frames(spark, shard, 600)
    di = di.where("text IS NOT NULL")
    found = I.search(dq, I.build(di, block=block, shard=shard), 7, block=cut, digits=10)
    assert answers(found) == answers(R.bm25_topk(dq, di, 7, digits=10))
    reads = found.select("query_id", "postings", "postings_read").distinct().collect()
    assert all(0 < r["postings_read"] <= r["postings"] for r in reads)


def test_reads_fewer_postings(spark):
    """A rare word with a very common one: once enough documents hold the rare one, the other is only looked up."""
    texts = [(i, "common filler words stand here" + (" unusual" if i % 100 == 3 else "")) for i in range(4000)]
    di = spark.createDataFrame(texts, "item_id long, text string")
    dq = spark.createDataFrame([(1, "common unusual")], "query_id long, text string")
    r = I.search(dq, I.build(di, block=16), 10, digits=10).first()
    assert r["postings"] == 4040 and r["postings_read"] <= 1000


def test_empty(spark):
    di, dq = frames(spark, 1, 5)
    empty = I.build(di.limit(0))
    assert I.search(dq, empty, 3).count() == 0
    assert I.search(dq.limit(0), I.build(di), 3).count() == 0
