"""Blocks, chunks and metadata on small hand-made frames."""

import hashlib

from pyspark.sql import functions as F

from foliant.functions import extract as X
from foliant.functions import language as L
from foliant.functions.text import word_count
from foliant.operators import blocks as B
from foliant.operators import chunks as C
from foliant.operators.metadata import document_metadata


def docs(spark, texts, **kw):
    rows = [(i, f"s/d{i}", f"d{i}", t) for i, t in enumerate(texts)]
    return B.blocks_from_text(spark.createDataFrame(rows, "doc_id int, source_path string, filename string, text string"), **kw)


def long_blocks(spark):
    rows = [
        (1, 0, "header", "TOP", 1, "TOP", None, None), (1, 1, "header", "SECOND", 1, "SECOND", None, None),
        (1, 2, "text", "a" * 30, 1, "SECOND", None, None), (1, 3, "table", "| t |", 2, "SECOND", ["h1", "h2"], [["1", "2"]] * 7),
        (1, 4, "text", "b" * 10, 2, "SECOND", None, None), (1, 5, "text", "c" * 300, 3, "SECOND", None, None), (1, 6, "image", "ocr", 3, "SECOND", None, None),
    ]
    schema = "doc_id int, block_idx int, block_type string, content string, page int, section string, headers array<string>, rows array<array<string>>"
    df = B.documents_from_blocks(spark.createDataFrame(rows, schema).repartition(3), ["doc_id"])
    return df.withColumns({"source_path": F.lit("p/x"), "filename": F.lit("x")})


def test_block_rules(spark):
    d = docs(spark, ["HEAD ONE\n\n- item\n1) one\nb. two\nlet x = 1\nplain\nHEAD TWO\nmore", "", "  \n ", "no header"])
    out = [tuple(r) for r in B.explode_blocks(d, "doc_id").select(
        "doc_id", "block_idx", "block_type", "section", "para", "para_in_section").orderBy("doc_id", "block_idx").collect()]
    assert [r[2] for r in out if r[0] == 0] == ["header", "list", "list", "list", "code", "text", "header", "text"]
    assert [r[3] for r in out if r[0] == 0] == ["HEAD ONE"] * 6 + ["HEAD TWO"] * 2
    assert [r[4] for r in out if r[0] == 0] == [0, 2, 3, 4, 5, 6, 7, 8]
    assert [r[5] for r in out if r[0] == 0] == [0, 0, 1, 2, 3, 4, 5, 0]
    assert [r for r in out if r[0] in (1, 2)] == []
    assert [r[3] for r in out if r[0] == 3] == [None]


def test_hybrid_chunks_around_special_blocks(spark):
    got = C.chunk_documents(long_blocks(spark), ["doc_id"], "hybrid", 120).orderBy("chunk_no").collect()
    assert [(r.start_block, r.end_block) for r in got] == [(0, 0), (1, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert got[2].has_table and not got[2].has_image and got[5].has_image
    assert got[1].chunk_id == hashlib.md5(b"p/x:1:2").hexdigest()[:16]
    table = got[2].embedding_text
    assert "Table columns: h1, h2" in table and table.count("1 | 2") == 5 and "... and 2 more rows" in table
    assert got[1].pages == [1] and got[1].section == "SECOND"
    assert C.chunk_documents(long_blocks(spark), ["doc_id"], "hybrid", 120, respect_boundaries=False).count() == 5


def test_chunks_cover_all_blocks_in_order(spark):
    d = docs(spark, ["A B\n" + "\n".join("word " * (i % 7 + 1) for i in range(60))])
    for strategy in ("hybrid", "paragraph", "semantic"):
        got = C.chunk_documents(d, ["doc_id"], strategy, 90).orderBy("chunk_no").collect()
        assert [r.start_block for r in got] == [0] + [r.end_block + 1 for r in got][:-1]
        assert got[-1].end_block == 60


def test_overlap_cascades_over_short_chunks(spark):
    got = C.chunk_documents(docs(spark, ["AA\nx\nBB\ny\nCC\nz"]), ["doc_id"], "hybrid", 100, overlap=12).orderBy("chunk_no").collect()
    first = "AA\n\nx"
    second = f"[...] {first[-12:]}\n\nBB\n\ny"
    assert [r.content for r in got] == [first, second, f"[...] {second[-12:]}\n\nCC\n\nz"]
    assert got[2].char_count == len("CC\n\nz")


def test_fixed_windows_always_end(spark):
    texts = ["x" * 95, "ab " * 40, "short", "a " + "y" * 50, "日本語 " * 30 + "😀" * 20]
    got = C.chunk_documents(docs(spark, texts), ["doc_id"], "fixed_size", 20, overlap=15, add_source=False).collect()
    for i, t in enumerate(texts):
        parts = [r.content for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.chunk_no)]
        assert all(len(p) <= 20 for p in parts) and t.strip().endswith(parts[-1]) and t.startswith(parts[0])


def test_sentence_chunks(spark):
    got = C.chunk_documents(docs(spark, ["One. Two! Three? Four.\nFive.", "BIG"]), ["doc_id"], "sentence", 9).orderBy("doc_id", "chunk_no").collect()
    assert [r.content for r in got if r.doc_id == 0] == ["One. Two!", "Three?", "Four.", "Five."]
    assert [r.content for r in got if r.doc_id == 1] == [""]


def test_pluggable_tokenizer(spark):
    import pandas as pd

    @F.pandas_udf("int")
    def letters(s: pd.Series) -> pd.Series:
        return s.str.len()

    got = C.chunk_documents(docs(spark, ["abc"]), ["doc_id"], "sentence", counter=letters).first()
    assert got.token_count == 3


def test_citation_and_media(spark):
    df = spark.createDataFrame([("f", "S", [3, 1, 3]), ("f", None, [2])], "f string, s string, p array<int>")
    assert [r[0] for r in df.select(C.citation(F.col("f"), F.col("s"), F.col("p"))).collect()] == ["f, Section: S, Page 1, 3", "f, Page 2"]
    m = spark.createDataFrame([(99, 500), (400, 200), (300, 250), (150, 150)], "w int, h int")
    assert [r[0] for r in m.select(B.media_type(F.col("w"), F.col("h"))).collect()] == [None, "chart", "figure", "image"]


def test_tables(spark):
    df = spark.createDataFrame([([["a", None], ["1", "2"]],), ([["a"]],)], "g array<array<string>>")
    got = df.select(B.table_block(F.col("g")).alias("t")).select("t.headers", "t.rows", B.table_text(F.col("t.headers"), F.col("t.rows")).alias("x")).collect()
    assert got[0].headers == ["a", ""] and got[0].x == "| a |  |\n|---|---|\n| 1 | 2 |" and got[1].headers is None


def test_entities(spark):
    text = "On 12/31/2024, 2024-1-5 and Sept 3, 2021: 1,234.5 or 99 or 101 or 12345; a.b@c.org, http://x.y/z?q=1, é2"
    r = spark.createDataFrame([(text,)], "t string").select(
        X.dates(F.col("t")).alias("d"), X.significant_numbers(F.col("t")).alias("n"), X.emails(F.col("t")).alias("e"), X.urls(F.col("t")).alias("u")).first()
    assert r.d == ["12/31/2024", "2024-1-5", "Sept 3, 2021"] and r.e == ["a.b@c.org"] and r.u == ["http://x.y/z?q=1,"]
    assert "1,234.5" in r.n and "101" in r.n and "99" not in r.n and "12345" not in r.n


def test_languages(spark):
    cases = [("你好", "zh"), ("こんにちは", "ja"), ("안녕", "ko"), ("Привет", "ru"), ("مرحبا", "ar"), ("đó", "vi"), ("Xin chào", "en"), ("", "en"), ("漢字かな", "zh"), (None, "en")]
    df = spark.createDataFrame(cases, "t string, e string")
    assert all(r.g == r.e for r in df.select("e", L.by_script(F.col("t")).alias("g")).collect())
    codes = [("ZH-cn", "zh"), ("pt-BR", "pt"), ("xx", "en"), (None, "en"), ("fr-CA", "fr")]
    df = spark.createDataFrame(codes, "t string, e string")
    assert all(r.g == r.e for r in df.select("e", L.normal_code(F.col("t")).alias("g")).collect())
    tie = spark.createDataFrame([("zzz",)], "t string").select(L.by_indicators(F.col("t"))).first()[0]
    assert tie == "en"


def test_metadata_row(spark):
    d = docs(spark, ["ANNUAL REVIEW\nThe conclusion and findings and analysis.", ""])
    m = document_metadata(d, ["doc_id"], F.lit("My Great Title"), pages=F.lit(0)).orderBy("doc_id").collect()
    assert m[0].document_type == "report" and m[0].sections == ["ANNUAL REVIEW"] and m[0].keywords == ["annual", "great", "review", "title"]
    assert m[0].avg_words_per_page == 0.0 and m[1].word_count == 0
    sheet = spark.range(1).select(X.document_type(F.lit("x"), F.lit(2), F.lit(3))).first()[0]
    assert sheet == "spreadsheet"


def test_word_count_sees_all_spaces(spark):
    df = spark.createDataFrame([("a b　c d\n",), ("  ",), ("",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [4, 0, 0]
