"""Chunking of block arrays, inside the document row and without a shuffle.

Each strategy works out where chunks begin, as a short array of positions, and
the blocks are then cut once at these positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.arrays import bind, cut_at, distinct_sorted, explode_indexed, positions
from foliant.functions.text import SPACE_RUN, SPACES, word_count
from foliant.operators.blocks import MEDIA, SPECIAL, embedding_text

STRATEGIES = ("hybrid", "fixed_size", "semantic", "sentence", "paragraph")
SENTENCE_GAP = "(?<=[.!?])" + SPACE_RUN

_FOLD = "struct<n:int,size:int,closed:boolean,section:string,starts:array<int>>"


def _greedy_starts(items: Column, size_of: Callable, limit: int, cut_also: Callable, special: Callable,
                   section_of: Callable) -> Column:
    """Where a new chunk begins, adding items until ``limit`` would be passed."""
    zero = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("closed"),
        F.lit(None).cast("string").alias("section"), F.array(F.lit(0)).alias("starts"),
    ).cast(_FOLD)

    def step(acc: Column, item: Column) -> Column:
        size = size_of(item)
        alone = special(item)
        cut = (acc["n"] > 0) & (acc["closed"] | alone | cut_also(acc, item) | (acc["size"] + size > limit))
        return F.struct(
            (acc["n"] + 1).alias("n"),
            F.when(alone, 0).when(cut, size).otherwise(acc["size"] + size).alias("size"),
            alone.alias("closed"),
            section_of(item).alias("section"),
            F.when(cut, F.array_append(acc["starts"], acc["n"])).otherwise(acc["starts"]).alias("starts"),
        ).cast(_FOLD)

    return F.aggregate(items, zero, step, lambda acc: acc["starts"])


def hybrid_starts(blocks: Column, limit: int, respect: bool = True) -> Column:
    def new_section(acc: Column, b: Column) -> Column:
        changed = (F.coalesce(b["section"], F.lit("")) != "") & ~b["section"].eqNullSafe(acc["section"])
        return ((b["block_type"] == "header") | changed) if respect else F.lit(False)

    return _greedy_starts(
        blocks, lambda b: F.length(b["emb"]), limit, new_section,
        lambda b: b["block_type"].isin(SPECIAL), lambda b: b["section"],
    )


def paragraph_starts(blocks: Column, limit: int) -> Column:
    return _greedy_starts(
        blocks, lambda b: F.length(b["content"]), limit, lambda *_: F.lit(False),
        lambda _: F.lit(False), lambda _: F.lit(None).cast("string"),
    )


def semantic_starts(blocks: Column) -> Column:
    return F.array_union(F.array(F.lit(0)), positions(blocks, lambda b: b["block_type"] == "header"))


def sentence_starts(sentences: Column, limit: int) -> Column:
    return _greedy_starts(
        sentences, F.length, limit, lambda *_: F.lit(False), lambda _: F.lit(False),
        lambda _: F.lit(None).cast("string"),
    )


def chunk_id(source: Column, start: Column, end: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", source, start.cast("string"), end.cast("string"))), 1, 16)


def _assemble(run: Column, doc: dict[str, Column], add_source: bool) -> Column:
    items = run["items"]
    texts = F.transform(items, lambda b: b["emb"])
    if add_source:
        texts = F.concat(F.array(F.concat(F.lit("Source: "), doc["filename"])), texts)
    content = F.array_join(F.transform(items, lambda b: b["content"]), "\n\n")
    return F.struct(
        chunk_id(doc["source_path"], run["start"], run["end"]).alias("chunk_id"),
        content.alias("content"),
        F.array_join(texts, "\n\n").alias("embedding_text"),
        distinct_sorted(F.transform(items, lambda b: b["page"])).alias("pages"),
        items[0]["section"].alias("section"),
        distinct_sorted(F.transform(items, lambda b: b["block_type"])).alias("content_types"),
        F.exists(items, lambda b: b["block_type"] == "table").alias("has_table"),
        F.exists(items, lambda b: b["block_type"].isin(MEDIA)).alias("has_image"),
        run["start"].alias("start_block"),
        run["end"].alias("end_block"),
        F.filter(F.transform(items, lambda b: b["bbox"]), lambda x: x.isNotNull()).alias("bboxes"),
    )


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Prefix each chunk with the tail of the previous, already prefixed, chunk."""
    tail = lambda text: F.when(F.length(text) > overlap, F.right(text, F.lit(overlap))).otherwise(text)
    zero = F.struct(F.lit("").alias("tail"), F.array().cast("array<string>").alias("tails"))

    def step(acc: Column, chunk: Column) -> Column:
        joined = F.when(F.size(acc["tails"]) == 0, chunk["content"]).otherwise(
            F.concat(F.lit("[...] "), acc["tail"], F.lit("\n\n"), chunk["content"])
        )
        return bind(
            tail(joined),
            lambda t: F.struct(t.alias("tail"), F.array_append(acc["tails"], t).alias("tails")),
        )

    tails = F.aggregate(chunks, zero, step, lambda acc: acc["tails"])

    def prefixed(cs: Column, ts: Column) -> Column:
        return F.transform(
            cs,
            lambda c, i: F.when(i == 0, c).otherwise(
                c.withField("content", F.concat(F.lit("[...] "), F.get(ts, i - 1), F.lit("\n\n"), c["content"]))
                .withField(
                    "embedding_text",
                    F.concat(F.lit("[Previous context:] "), F.get(ts, i - 1), F.lit("\n\n"), c["embedding_text"]),
                )
            ),
        )

    return bind(tails, lambda ts: prefixed(chunks, ts))


def _counted(chunks: Column, counter: Callable[[Column], Column]) -> Column:
    """Counts of the chunk before any overlap is added."""
    return F.transform(
        chunks,
        lambda c: c.withField("token_count", counter(c["embedding_text"])).withField("char_count", F.length(c["content"])),
    )


def window_texts(max_chars: int, overlap: int):
    """Pandas UDF: the stripped texts of fixed windows, cut back to the last space; blank ones are left out.

    The texts come out of the walk itself: looking them up again by their place in the text would read it from its
    start for every window.

    The next window starts ``overlap`` before the end, but always further on, and
    the walk stops when a window reaches the end of the text.
    """

    def walk(text: str) -> list[str]:
        out, start, n = [], 0, len(text)
        while start < n:
            end = min(start + max_chars, n)
            space = text.rfind(" ", start, end) if end < n else -1
            if space > start:
                end = space
            out.append(text[start:end])
            if end >= n:
                break
            start = end - overlap if end - overlap > start else end
        return out

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [w for w in (piece.strip(SPACES) for piece in walk(t or "")) if w])

    return pieces


def _simple(docs: DataFrame, ids: list[str], texts: str, counter, add_source: bool) -> DataFrame:
    """Chunk rows from an array of plain texts: one page, type text."""
    rows = explode_indexed(docs, [*ids, "source_path", "filename"], texts, "chunk_no", "content")
    no = F.col("chunk_no")
    emb = F.concat(F.lit("Source: "), F.col("filename"), F.lit("\n\n"), F.col("content")) if add_source else F.col("content")
    return rows.select(
        *ids, "filename", "chunk_no",
        chunk_id(F.col("source_path"), no, no).alias("chunk_id"),
        "content",
        emb.alias("embedding_text"),
        F.array(F.lit(1)).alias("pages"),
        F.lit(None).cast("string").alias("section"),
        F.array(F.lit("text")).alias("content_types"),
        F.lit(False).alias("has_table"),
        F.lit(False).alias("has_image"),
        F.lit(0).alias("start_block"),
        F.lit(0).alias("end_block"),
        counter(F.col("content")).alias("token_count"),
        F.length("content").alias("char_count"),
    )


def chunk_documents(
    docs: DataFrame,
    ids: list[str],
    strategy: str = "hybrid",
    max_chars: int = 1000,
    overlap: int = 0,
    respect_boundaries: bool = True,
    add_source: bool = True,
    counter: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """Chunk rows of documents that have ``source_path``, ``filename`` and ``blocks``.

    ``counter`` maps a text column to its token count; pass a pandas UDF to use a
    real tokenizer.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    with_emb = docs.withColumn(
        "blocks", F.transform("blocks", lambda b: b.withField("emb", embedding_text(b)))
    )
    if strategy == "fixed_size":
        whole = with_emb.withColumn("_text", F.array_join(F.transform("blocks", lambda b: b["emb"]), "\n\n"))
        cut = whole.withColumn("_windows", window_texts(max_chars, overlap)(F.col("_text")))
        # The text is used twice, so that it stays a step of its own; put into the call it would keep the call from a task.
        cut = cut.withColumn("_pieces", F.when(F.length("_text") > 0, F.col("_windows")))
        return _simple(cut, ids, "_pieces", counter, add_source)
    if strategy == "sentence":
        plain = F.filter("blocks", lambda b: b["block_type"] == "text")
        joined = F.array_join(F.transform(plain, lambda b: b["content"]), " ")
        pack = bind(
            F.split(joined, SENTENCE_GAP),
            lambda ss: F.transform(cut_at(ss, sentence_starts(ss, max_chars)), lambda r: F.array_join(r["items"], " ")),
        )
        return _simple(docs.withColumn("_pieces", pack), ids, "_pieces", counter, add_source)

    doc = {"source_path": F.col("source_path"), "filename": F.col("filename")}

    def starts(bs: Column) -> Column:
        if strategy == "semantic":
            return semantic_starts(bs)
        if strategy == "paragraph":
            return paragraph_starts(bs, max_chars)
        return hybrid_starts(bs, max_chars, respect_boundaries)

    runs = bind(F.col("blocks"), lambda bs: F.when(F.size(bs) > 0, bind(starts(bs), lambda st: cut_at(bs, st))))
    chunks = _counted(F.transform("_runs", lambda r: _assemble(r, doc, add_source)), counter)
    cut = with_emb.withColumn("_runs", runs).withColumn("_chunks", chunks)
    if overlap > 0 and strategy == "hybrid":
        cut = cut.withColumn("_chunks", bind(F.col("_chunks"), lambda cs: with_overlap(cs, overlap)))
    rows = explode_indexed(cut, [*ids, "filename"], "_chunks", "chunk_no", "c")
    return rows.select(*ids, "filename", "chunk_no", "c.*")


def citation(filename: Column, section: Column, pages: Column) -> Column:
    """``file, Section: s, Page 1, 2``; the section is optional."""
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", Section: "), section)).otherwise("")
    listed = F.array_join(F.transform(distinct_sorted(pages), lambda p: p.cast("string")), ", ")
    return F.concat(filename, named, F.lit(", Page "), listed)
