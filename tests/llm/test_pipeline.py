"""The stages of the pipeline on a small corpus, each against a plain version, and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from foliant.session import cut_lineage
from tests.llm.cases import awkward, documents
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_ngram_join import brute as classes

BENCH = [(1, "the quick brown fox jumps over the lazy dog while nobody looks at it today")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    sounds = {"en": ["ba", "bo", "bi", "ra"], "fr": ["zu", "ze", "zi", "mo"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."

    rows = [(text(g, rng.randint(60, 120)), g) for g in ["en", "fr"] * 40]
    rows += [rows[0], (rows[1][0].replace(".", " zu."), "fr"), ("short", "en"), ("日本 " * 80, None), (None, "en"), ("WOW!! " * 90, "en")]
    rows += [(rows[2][0] + "\nHome | News | About | Help", "en"), (rows[3][0] + " " + BENCH[0][1], "fr")]
    at = tmp_path_factory.mktemp("tables")
    documents(spark, [t for t, _ in rows], langs=[g for _, g in rows]).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = cut_lineage(stage(spark, docs, corpus))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        gone = {r["doc_id"] for r in before} - ids
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert gone == {82, 84, 85, 83} or gone == {82, 84, 85}
            assert docs.where("doc_id = 86").first()["text"] == docs.where("doc_id = 2").first()["text"]
        if name == "language_id":
            assert gone <= {83} and 83 not in ids
        if name == "near_duplicates":
            told = classes([r["text"] for r in before], [r["doc_id"] for r in before])
            assert ids == {c for _, c, *_ in told}
        if name == "decontamination":
            marked = hits([r["text"] for r in before], BENCH)
            assert gone == {r["doc_id"] for r, m in zip(before, marked) if m[4]}
        if name == "packing":
            assert ids == {r["doc_id"] for r in before}
    assert len(seen) == 5


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_take_awkward_rows_and_empty_tables(spark, corpus):
    for docs in (awkward(spark), awkward(spark).limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, corpus)
            assert out.count() <= n or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns


def test_registered():
    names = queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "pipeline" not in oracle_sql()
