"""Metadata of documents that carry a block array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import extract as X
from foliant.functions.arrays import bind
from foliant.functions.language import by_indicators
from foliant.functions.text import word_count


def full_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["content"]), " ")


def contents_of(blocks: Column, kind: str) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["block_type"] == kind), lambda b: b["content"])


def count_of(blocks: Column, kind: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["block_type"] == kind))


def document_metadata(
    docs: DataFrame,
    ids: list[str],
    title: Column,
    author: Column | None = None,
    subject: Column | None = None,
    pages: Column | None = None,
) -> DataFrame:
    """One row of metadata per document, worked out in the document's own row."""
    none = F.lit(None).cast("string")
    author = none if author is None else author
    subject = none if subject is None else subject
    pages = F.lit(1) if pages is None else pages

    def fields(text: Column) -> Column:
        n_words = word_count(text)
        return F.struct(
            F.length(text).alias("char_count"),
            n_words.alias("word_count"),
            F.when(pages > 0, n_words / pages).otherwise(0.0).alias("avg_words_per_page"),
            X.dates(text).alias("dates"),
            X.emails(text).alias("emails"),
            X.urls(text).alias("urls"),
            X.significant_numbers(text).alias("numbers"),
            by_indicators(text).alias("detected_language"),
            X.document_type(text, count_of(F.col("blocks"), "table"), pages).alias("document_type"),
        )

    base = docs.select(
        *ids,
        title.alias("title"), author.alias("author"), subject.alias("subject"), pages.alias("total_pages"),
        *[count_of(F.col("blocks"), k).alias(f"{k}_count") for k in ("table", "image", "chart")],
        contents_of(F.col("blocks"), "header").alias("sections"),
        bind(full_text(F.col("blocks")), fields).alias("m"),
    )
    out = base.withColumn("keywords", X.keywords(F.col("title"), F.col("sections")))
    out = out.select(*[c for c in out.columns if c != "m"], "m.*")
    return out.withColumn(
        "search_text",
        X.search_text(*[F.col(c) for c in ("title", "author", "subject", "keywords", "sections")]),
    )
