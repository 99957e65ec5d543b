"""Query analysis, candidate scoring, filtering, diversification and citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.functions.arrays import bind, distinct_sorted, explode_indexed, sorted_join
from foliant.functions.text import SPACE_RUN, ascii_words, strip
from foliant.operators.joins import salted_join
from foliant.operators.ordered import GROUP_LIMIT, Run, largest_group, running
from foliant.session import cut_lineage

# How a query asks for a page, section, file or kind of content.
PAGE_ASK = r"(?i)(?:page|p\.?)\s*([0-9]+)"
SECTION_ASK = r"""(?i)(?:section|chapter)\s+["']?([^"']+)["']?"""
FILE_ASK = r"""(?i)(?:file|document)\s+["']?([^"']+)["']?"""
KIND_ASK = r"(?i)\b(table|chart|figure|image)\b"

# Words that carry no search meaning.
STOPWORDS = [
    "what", "where", "when", "how", "why", "who", "which", "is", "are", "was", "were", "do", "does", "did",
    "the", "a", "an", "in", "on", "at", "to", "for", "and", "or", "but", "not", "with", "from", "by", "can",
    "could", "would", "should", "will", "shall", "this", "that", "these", "those", "it", "its",
]

QUERY_BLOCK = 2000  # query vectors that one task holds at a time
TERM_BLOCK = 200_000  # (query, term) pairs that one task holds at a time


# ---- queries -------------------------------------------------------------

def query_keywords(query: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(ascii_words(F.lower(query)), lambda w: ~F.array_contains(stop, w))


def analyze_query(query: Column) -> Column:
    """struct<semantic_query, page, section, file, content_type, keywords>."""

    def asked(pattern: str) -> Column:
        return F.when(query.rlike(pattern), F.regexp_extract(query, pattern, 1))

    def without(text: Column, pattern: str) -> Column:
        return F.when(query.rlike(pattern), F.regexp_replace(text, pattern, "")).otherwise(text)

    cleaned = without(without(without(query, PAGE_ASK), SECTION_ASK), FILE_ASK)
    return bind(cleaned, lambda c: F.struct(
        strip(F.regexp_replace(c, SPACE_RUN, " ")).alias("semantic_query"),
        asked(PAGE_ASK).try_cast("bigint").alias("page"),
        asked(SECTION_ASK).alias("section"),
        asked(FILE_ASK).alias("file"),
        F.lower(asked(KIND_ASK)).alias("content_type"),
        query_keywords(c).alias("keywords"),
    ))


def expand_query(query: Column) -> Column:
    """The query and its variations, as an array."""
    # The phrases of the variations.
    open_end = ~query.endswith("?")
    return F.array_compact(F.array(
        query,
        F.when(open_end, F.concat(F.lit("What is "), query, F.lit("?"))),
        F.when(open_end, F.concat(F.lit("How does "), query, F.lit(" work?"))),
        F.concat(query, F.lit(" definition")),
        F.concat(query, F.lit(" explanation")),
    ))


# ---- candidate scores ----------------------------------------------------

def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    return scores if digits is None else np.round(scores, digits)


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = frame.sort_values(["q", "score", "item_id"], ascending=[True, False, True])
    return ordered.groupby("q", sort=False).head(k)


def _query_blocks(queries: DataFrame, rows: DataFrame, block: int) -> list[DataFrame]:
    """Cut the queries so that each part has about ``block`` of ``rows``; one pass over the items per part."""
    n = rows.count()
    parts = -(-n // block)
    if parts <= 1:
        return [queries]
    lot = F.pmod(F.xxhash64("query_id"), F.lit(2 * parts))
    return [queries.where(lot == i) for i in range(2 * parts)]


def _union_top(passes: list[DataFrame], k: int) -> DataFrame:
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, items: DataFrame, k: int, block: int = QUERY_BLOCK, digits: int = 12) -> DataFrame:
    """The ``k`` items of highest cosine per query; ties go to the smaller id.

    Scores are compared to ``digits`` digits. A cosine in doubles is not known much better, and
    which of two closer ones comes out larger depends on the order in which a library adds.

    ``queries(query_id, vec)`` is held in blocks of checked size. Each task scores
    its items against the block and keeps only its own best ``k`` per query, so
    what is shuffled does not grow with the number of items.
    """
    schema = "query_id bigint, item_id bigint, score double"
    passes = []
    for part in _query_blocks(queries, queries, block):
        rows = part.select("query_id", "vec").collect()  # at most about one block
        if not rows:
            continue
        ids = np.array([r[0] for r in rows], dtype="int64")
        mat = np.array([r[1] for r in rows], dtype="float64").reshape(len(rows), -1)
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)

        def score(batches: Iterator[pd.DataFrame], ids=ids, mat=mat) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({"q": [], "item_id": [], "score": []})
            for pdf in batches:
                for lo in range(0, len(pdf), 1000):
                    sub = pdf.iloc[lo:lo + 1000]
                    vecs = np.stack(sub["vec"].to_numpy()).astype("float64")
                    vecs /= np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
                    sims = _rounded(vecs @ mat.T, digits)
                    ids_here = sub["item_id"].to_numpy()
                    if len(sub) > k:  # all that reach the k-th best score of their query, ties included
                        bar = np.partition(sims, len(sub) - k, axis=0)[len(sub) - k]
                        at, q = np.nonzero(sims >= bar)
                    else:
                        at, q = np.nonzero(np.ones(sims.shape, bool))
                    found = pd.DataFrame({"q": q, "item_id": ids_here[at], "score": sims[at, q]})
                    kept = _best(pd.concat([kept, found]) if len(kept) else found, k)
            if len(kept):
                yield pd.DataFrame({"query_id": ids[kept["q"].astype(int)], "item_id": kept["item_id"].astype("int64"),
                                    "score": kept["score"]})

        passes.append(items.select("item_id", "vec").mapInPandas(score, schema))
    if not passes:
        return items.sparkSession.createDataFrame([], schema + ", rank int")
    return _union_top(passes, k)


def bm25_topk(queries: DataFrame, items: DataFrame, k: int, k1: float = 1.2, b: float = 0.75,
              block: int = TERM_BLOCK, digits: int | None = None) -> DataFrame:
    """The ``k`` items of highest BM25 per query.

    ``queries(query_id, text)`` and ``items(item_id, text)``. Document frequencies
    are counted for the query terms only. Scoring keeps the best ``k`` per query
    in each task, so query-item pairs are never shuffled.
    """
    schema = "query_id bigint, item_id bigint, score double"
    tokens = items.select("item_id", query_keywords(F.col("text")).alias("toks"))
    terms = queries.select("query_id", F.explode(F.array_distinct(query_keywords(F.col("text")))).alias("term"))
    # one pass for all counts: the empty term stands for the item itself and its length;
    # counts are combined before the shuffle, so a common term is cheap
    marks = tokens.select(
        F.size("toks").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("toks"))).alias("term"))
    seen = marks.groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("length"))
    wanted = terms.select("term").distinct().unionByName(items.sparkSession.createDataFrame([("",)], "term string"))
    df_of = cut_lineage(seen.join(wanted, "term"))
    overall = df_of.where("term = ''").first()
    total, mean_len = (overall["count"], overall["length"] / overall["count"]) if overall else (0, 0.0)
    passes = []
    for part in _query_blocks(queries, terms, block):
        part_terms = terms.join(part.select("query_id"), "query_id", "left_semi")
        rows = part_terms.join(df_of, "term").select("query_id", "term", "count").collect()
        if not rows or not mean_len:
            continue
        rows.sort(key=lambda r: (r[1], r[0]))
        ids = np.array(sorted({r[0] for r in rows}), dtype="int64")
        vocab = pd.Index(sorted({r[1] for r in rows}))
        code = vocab.get_indexer([r[1] for r in rows])
        owner = np.searchsorted(ids, [r[0] for r in rows])
        counts = np.array([r[2] for r in rows], dtype="float64")
        weight = np.log(1 + (total - counts + 0.5) / (counts + 0.5))
        first = np.searchsorted(code, np.arange(len(vocab)))
        many = np.bincount(code, minlength=len(vocab))

        def score(batches: Iterator[pd.DataFrame], ids=ids, vocab=vocab, owner=owner, weight=weight,
                  first=first, many=many) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({"q": [], "item_id": [], "score": []})
            step = max(1, min(1000, 4_000_000 // max(len(ids), 1)))  # items by queries held at a time
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    sub = pdf.iloc[lo:lo + step]
                    lens = sub["toks"].map(len).to_numpy()
                    if lens.sum() == 0:
                        continue
                    at = np.repeat(np.arange(len(sub)), lens)
                    term = vocab.get_indexer(np.concatenate(sub["toks"].to_numpy()))
                    pair, tf = np.unique(at[term >= 0] * len(vocab) + term[term >= 0], return_counts=True)
                    at, term = pair // len(vocab), pair % len(vocab)
                    part_score = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[at] / mean_len))
                    reps = many[term]
                    slot = np.repeat(first[term] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
                    sums = np.bincount(
                        np.repeat(at, reps) * len(ids) + owner[slot],
                        weights=np.repeat(part_score, reps) * weight[slot], minlength=len(sub) * len(ids),
                    )
                    hit = np.flatnonzero(sums > 0)
                    found = pd.DataFrame({
                        "q": hit % len(ids),
                        "item_id": sub["item_id"].to_numpy()[hit // len(ids)],
                        "score": _rounded(sums[hit], digits),
                    })
                    kept = _best(pd.concat([kept, found]) if len(kept) else found, k)
            if len(kept):
                yield pd.DataFrame({"query_id": ids[kept["q"].astype(int)], "item_id": kept["item_id"].astype("int64"),
                                    "score": kept["score"]})

        passes.append(tokens.mapInPandas(score, schema))
    if not passes:
        return items.sparkSession.createDataFrame([], schema + ", rank int")
    return _union_top(passes, k)


# ---- filters, boosts, diversity -------------------------------------------

def filter_results(results: DataFrame) -> DataFrame:
    """Keep candidates that agree with the filters of their query.

    The frame carries the filters as ``f_page f_section f_file f_content_type``;
    a null filter lets everything pass.
    """
    c = F.col
    within = lambda part, whole: F.lower(whole).contains(F.lower(part))
    return results.where(
        (c("f_page").isNull() | F.array_contains(c("pages"), c("f_page")))
        & (c("f_section").isNull() | (c("section").isNotNull() & (c("section") != "") & within(c("f_section"), c("section"))))
        & (c("f_file").isNull() | within(c("f_file"), c("source")))
        & (c("f_content_type").isNull() | (c("f_content_type") != "table") | c("has_table"))
        & (c("f_content_type").isNull() | ~c("f_content_type").isin("image", "figure", "chart") | c("has_image"))
    )


def boost(results: DataFrame, table_boost: float = 1.2, image_boost: float = 1.1) -> DataFrame:
    kind = F.col("f_content_type")
    factor = (
        F.when((kind == "table") & F.col("has_table"), table_boost)
        .when(kind.isin("image", "figure", "chart") & F.col("has_image"), image_boost)
        .otherwise(1.0)
    )
    return results.withColumn("score", F.col("score") * factor)


def diversify(results: DataFrame, top_k: int, weight: float = 0.1, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Lower the score of a source or section that was already seen higher up.

    Needs ``query_id, source, section, score, idx``; ``idx`` is the unique place of
    a candidate in its query and breaks ties. Adds ``adjusted``.
    """
    if weight <= 0:
        return results.withColumn("adjusted", F.col("score"))
    results = cut_lineage(results)  # used for the sizes and for the order; worked out once
    largest = largest_group(results, ["query_id"])
    out = results.withColumn("_down", -F.col("score"))
    order = ["_down", "idx"]
    known = {"group_limit": group_limit, "known_largest": largest}
    out = running(out, ["query_id", "source"], order, [Run("_same_source", "count", None, True)], **known)
    out = running(out, ["query_id", "source", "section"], order, [Run("_same_section", "count", None, True)], **known)
    if largest <= group_limit:
        out = out.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("query_id")))
    else:
        out = salted_join(out, results.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), ["query_id"])
    penalty = (F.col("_same_source") * 0.1 + F.col("_same_section") * 0.2) * weight
    adjusted = F.when(F.col("_n") <= top_k, F.col("score")).otherwise(F.col("score") * (1 - penalty))
    return out.withColumn("adjusted", adjusted).drop("_down", "_same_source", "_same_section", "_n")


def top_results(results: DataFrame, top_k: int) -> DataFrame:
    """Best ``top_k`` per query by adjusted score, then score, then place."""
    best = W.partitionBy("query_id").orderBy(F.desc("adjusted"), F.desc("score"), "idx")
    return results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def rerank_results(results: DataFrame, top_k: int = 10, weight: float = 0.1, digits: int | None = None) -> DataFrame:
    """Filter, boost, diversify and cut."""
    kept = boost(filter_results(results))
    if digits is not None:
        kept = kept.withColumn("score", F.round("score", digits))
    spread_out = diversify(kept, top_k, weight)
    if digits is not None:
        spread_out = spread_out.withColumn("adjusted", F.round("adjusted", digits))
    return top_results(spread_out, top_k)


# ---- citations -----------------------------------------------------------

def _framed(source: Column, section: Column, page_text: Column) -> Column:
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", "), section)).otherwise("")
    return F.concat(F.lit("["), source, named, F.lit(", "), page_text, F.lit("]"))


def _span(pages: Column, pairs_apart: bool) -> Column:
    def text(ps: Column) -> Column:
        ends = F.concat(F.lit("pp. "), ps[0].cast("string"), F.lit("-"), F.element_at(ps, -1).cast("string"))
        out = F.when(F.size(ps) == 0, None).when(F.size(ps) == 1, F.concat(F.lit("p. "), ps[0].cast("string")))
        if pairs_apart:
            both = F.concat(F.lit("pp. "), ps[0].cast("string"), F.lit(", "), F.get(ps, F.lit(1)).cast("string"))
            out = out.when(F.size(ps) == 2, both)
        return out.otherwise(F.when(F.size(ps) > 0, ends))

    return bind(distinct_sorted(pages), text)


def result_citation(source: Column, section: Column, pages: Column) -> Column:
    """``[file, section, p. 1]``; two pages are listed, more are a range; no page gives null."""
    return _framed(source, section, _span(pages, True))


def inline_citation(source: Column, section: Column, pages: Column) -> Column:
    """As :func:`result_citation`, but two pages are a range too."""
    return _framed(source, section, _span(pages, False))


def format_context(results: DataFrame, include_sources: bool = True) -> DataFrame:
    """One numbered context text per query from its ranked results (a top-k, so bounded)."""
    mark = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "))
    if include_sources:
        line = F.concat(mark, F.col("citation"), F.lit("\n"), F.col("content"), F.lit("\n"))
    else:
        line = F.concat(mark, F.col("content"))
    pairs = results.select("query_id", F.struct(F.col("rank").alias("rank"), line.alias("text")).alias("p"))
    return pairs.groupBy("query_id").agg(sorted_join(F.collect_list("p"), "\n").alias("context"))


def resolve_citations(responses: DataFrame, results: DataFrame) -> DataFrame:
    """Each ``[n]`` of a response with result n of its query; unknown numbers are dropped."""
    found = F.regexp_extract_all("response", F.lit(r"\[([0-9]+)\]"), F.lit(1))
    marks = explode_indexed(responses, ["query_id"], found, "place", "n").withColumn("rank", F.when(~F.col("n").startswith("0"), F.col("n").try_cast("int")))
    return marks.join(results, ["query_id", "rank"]).withColumnRenamed("rank", "ref").drop("n")


def expand_citations(responses: DataFrame, results: DataFrame) -> DataFrame:
    """Write the citation in place of every known ``[n]``."""
    known = results.groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("string"), "citation"))).alias("_map")
    )
    pieces = F.split(F.regexp_replace("response", r"(\[[0-9]+\])", "\u0001$1\u0001"), "\u0001")
    named = F.transform(pieces, lambda p: F.coalesce(
        F.when(p.rlike(r"^\[[0-9]+\]$"), F.try_element_at("_map", F.regexp_extract(p, "[0-9]+", 0))), p))
    joined = responses.join(known, "query_id", "left")
    return joined.withColumn("response", F.array_join(named, "")).drop("_map")


def source_list(results: DataFrame) -> DataFrame:
    """One text per query that lists its files with their pages and sections."""
    per_file = results.groupBy("query_id", "source").agg(
        F.min("rank").alias("first"),
        distinct_sorted(F.flatten(F.collect_list("pages"))).alias("pages"),
        distinct_sorted(F.collect_list(F.when(F.col("section") != "", F.col("section")))).alias("sections"),
    )
    line = F.concat(
        F.lit("- "), F.col("source"), F.lit(", Pages: "), F.array_join(F.col("pages").cast("array<string>"), ", "),
        F.when(F.size("sections") > 0, F.concat(F.lit(", Sections: "), F.array_join("sections", ", "))).otherwise(""),
    )
    pairs = per_file.select("query_id", F.struct(F.col("first").alias("rank"), line.alias("text")).alias("p"))
    return pairs.groupBy("query_id").agg(
        F.concat(F.lit("**Sources:**\n"), sorted_join(F.collect_list("p"), "\n")).alias("sources")
    )
