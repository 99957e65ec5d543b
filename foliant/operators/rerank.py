"""Pair scoring, ranking, request identity and reuse of earlier results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.functions.arrays import bind
from foliant.functions.text import words
from foliant.operators.joins import salted_join
from foliant.operators.ordered import row_numbers

# Where the text of a loose document may sit, in order of preference.
TEXT_FIELDS = ["text", "document", "content", "body", "value", "snippet"]
BATCH = 16


def document_text(doc: Column) -> Column:
    """Text of a loose document: a JSON object by its first filled text field, else as it is.

    An object without any text gives null.
    """
    filled = F.coalesce(*[F.nullif(F.get_json_object(doc, f"$.{f}"), F.lit("")) for f in TEXT_FIELDS])
    is_object = F.ltrim(doc).startswith("{") & F.get_json_object(doc, "$").isNotNull()
    return F.when(is_object, filled).otherwise(doc)


def normalize_documents(docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(rows with ``text``, rows that have no text field)."""
    out = docs.withColumn("text", document_text(F.col(doc)))
    return out.where("text IS NOT NULL"), out.where("text IS NULL").drop("text")


def requested_top(payload: Column, n_docs: Column) -> Column:
    """top_n, else top_k, else rank_count; absent, below one or too large means all.

    A value that is no number gives null, which callers treat as a bad request.
    """
    raw = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("top_n", "top_k", "rank_count")])
    value = raw.try_cast("double").try_cast("bigint")
    return (
        F.when(raw.isNull(), n_docs).when(value.isNull(), None)
        .when(value <= 0, n_docs).otherwise(F.least(value, n_docs))
    )


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the distinct query words that occur in the text."""
    def share(q: Column) -> Column:
        hits = F.size(F.array_intersect(q, words(F.lower(text))))
        return F.when(F.size(q) == 0, 0.0).otherwise(hits / F.size(q))

    return bind(F.array_distinct(words(F.lower(query))), share)


def score_pairs(pairs: DataFrame, load_model: Callable | None = None, batch: int = BATCH) -> DataFrame:
    """Add ``score`` to (query, text) pairs.

    Without a model the score is lexical and stays in the JVM. ``load_model()`` is
    called once per task and returns a function of (queries, texts) to scores; for
    several classes the first one counts. A failing batch scores 0.0, and its rows are
    marked in the column ``failed``.
    """
    if load_model is None:
        return pairs.withColumns({"score": lexical_score(F.col("query"), F.col("text")), "failed": F.lit(False)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in batches:
            scores: list[float] = []
            failed: list[bool] = []
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo:lo + batch]
                try:
                    raw = model(part["query"].tolist(), part["text"].tolist())
                    own = [float(s[0]) if hasattr(s, "__len__") else float(s) for s in raw]
                    bad = False
                except Exception:
                    own, bad = [0.0] * len(part), True
                scores += own
                failed += [bad] * len(part)
            yield pdf.assign(score=scores, failed=failed)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", score double, failed boolean"
    return pairs.mapInPandas(run, fields)


def rank_pairs(scored: DataFrame, top_k: int | None = None, return_documents: bool = True, **kw) -> DataFrame:
    """Position from 1 by falling score; the document index is kept and breaks ties."""
    if top_k is not None:
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_index")
        out = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    else:
        down = scored.withColumn("_down", -F.col("score"))
        out = row_numbers(down, ["query_id"], ["_down", "doc_index"], "rank", **kw).drop("_down")
    return out if return_documents else out.drop("text")


def fingerprints(pairs: DataFrame, top_k: int | None = None) -> DataFrame:
    """One fingerprint per request over the query, all documents and ``top_k``.

    The documents enter as sums of digest parts tied to their position. A sum is
    combined before the shuffle, so a request of any length needs no collected list.
    """
    digest = F.md5(F.concat_ws(":", F.col("doc_index").cast("string"), "text"))
    half = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")
    sums = pairs.groupBy("query_id", "query").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(half(1)).alias("_a"), F.sum(half(13)).alias("_b")
    )
    mark = F.concat_ws(
        ":", F.substring(F.md5("query"), 1, 8), F.col("n_docs").cast("string"), F.lit(str(top_k or "all")),
        F.col("_a").cast("string"), F.col("_b").cast("string"),
    )
    return sums.select("query_id", "query", "n_docs", mark.alias("fingerprint"))


def representatives(requests: DataFrame) -> DataFrame:
    """One request per fingerprint, with the number of copies."""
    return requests.groupBy("fingerprint").agg(F.min("query_id").alias("answered_as"), F.count(F.lit(1)).alias("copies"))


def share_results(requests: DataFrame, answered: DataFrame, salts: int = 16) -> DataFrame:
    """Give the single answer per fingerprint to all requests that have it."""
    return salted_join(requests, answered, ["fingerprint"], salts=salts)


def reusable(requests: DataFrame, stored: DataFrame, ttl_seconds: int = 600, salts: int = 16) -> DataFrame:
    """Requests with ``reuse``: an equal request was stored at most ``ttl_seconds`` before.

    ``requests(fingerprint, sec)``, ``stored(fingerprint, stored_sec)``; all stored
    results are older than the batch of requests, so the latest one per fingerprint decides.
    """
    latest = stored.groupBy("fingerprint").agg(F.max("stored_sec").alias("stored_sec"))
    out = salted_join(requests, latest, ["fingerprint"], "left", salts)
    return out.withColumn("reuse", F.coalesce(F.col("sec") - F.col("stored_sec") <= ttl_seconds, F.lit(False)))
