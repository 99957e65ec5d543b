"""Reranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import rerank as K
from foliant.plans.registry import query
from foliant.plans.retrieval import BM25_SQL, bm25_best
from foliant.session import table


@query("loose_documents", """WITH d AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5
  WHEN 0 THEN text WHEN 1 THEN to_json({'text': text})::VARCHAR WHEN 2 THEN to_json({'text': '', 'body': text})::VARCHAR WHEN 3 THEN to_json({'snippet': text, 'content': role})::VARCHAR
  ELSE to_json({'other': text})::VARCHAR END AS doc FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(doc, '{') THEN coalesce(nullif(json_extract_string(j, '$.text'), ''), json_extract_string(j, '$.content'),
  json_extract_string(j, '$.body'), json_extract_string(j, '$.snippet')) ELSE doc END AS text FROM (SELECT *, CASE WHEN starts_with(doc, '{') THEN doc ELSE '{}' END AS j FROM d)""")
def loose_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 5
    js = lambda *cols: F.to_json(F.struct(*cols))
    t = F.col("text")
    doc = (
        F.when(k == 0, t).when(k == 1, js(t.alias("text"))).when(k == 2, js(F.lit("").alias("text"), t.alias("body")))
        .when(k == 3, js(t.alias("snippet"), F.col("role").alias("content"))).otherwise(js(t.alias("other")))
    )
    rows = c.select("conv_id", "turn", doc.alias("doc"))
    good, bad = K.normalize_documents(rows)
    return good.select("conv_id", "turn", "text").unionByName(
        bad.select("conv_id", "turn", F.lit(None).cast("string").alias("text")))


@query("requested_top", """WITH p AS (SELECT event_id, (event_id % 90 + 1) AS n, CASE event_id % 6 WHEN 0 THEN to_json({'top_n': (props->>'$.k')::INT, 'top_k': 1})
  WHEN 1 THEN to_json({'top_k': (props->>'$.k')::INT}) WHEN 2 THEN to_json({'rank_count': (props->>'$.k')::INT - 20}) WHEN 3 THEN '{}' WHEN 4 THEN '{"top_k": "x"}' ELSE '{"top_n": "7"}' END AS payload FROM events)
SELECT event_id, CASE WHEN raw IS NULL THEN n WHEN try_cast(raw AS BIGINT) IS NULL THEN NULL WHEN raw::BIGINT <= 0 THEN n ELSE least(raw::BIGINT, n) END AS top_k
FROM (SELECT *, coalesce(payload->>'$.top_n', payload->>'$.top_k', payload->>'$.rank_count') AS raw FROM p)""")
def requested_top(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.get_json_object("props", "$.k").cast("int")
    k = F.col("event_id") % 6
    payload = (
        F.when(k == 0, F.to_json(F.struct(v.alias("top_n"), F.lit(1).alias("top_k"))))
        .when(k == 1, F.to_json(F.struct(v.alias("top_k")))).when(k == 2, F.to_json(F.struct((v - 20).alias("rank_count"))))
        .when(k == 3, "{}").when(k == 4, '{"top_k": "x"}').otherwise('{"top_n": "7"}')
    )
    return e.select("event_id", K.requested_top(payload, F.col("event_id") % 90 + 1).alias("top_k"))


def sql_lexical(q: str, t: str) -> str:
    w = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[ \\n]+'), lambda w: w <> '')"
    return f"len(list_intersect(list_distinct({w(q)}), {w(t)}))::DOUBLE / len(list_distinct({w(q)}))"


_PAIRS_SQL = f"""{BM25_SQL},
pairs AS (SELECT b.query_id, b.item_id AS doc_index, m.text AS query, d.text FROM best b JOIN benchmark m ON m.item_id = b.query_id JOIN documents d ON d.doc_id = b.item_id),
scored AS MATERIALIZED (SELECT query_id, doc_index, round({sql_lexical('query', 'text')}, 12) AS score FROM pairs)"""


def _pairs(spark, sf_dir):
    best = bm25_best(spark, sf_dir).select("query_id", F.col("item_id").alias("doc_index"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_index"), "text")
    return best.join(q, "query_id").join(d, "doc_index")


@query("rerank_scores", f"WITH {_PAIRS_SQL.replace('scored AS MATERIALIZED', 'lexical AS MATERIALIZED')} SELECT * FROM lexical")
def rerank_scores(spark, sf_dir):
    return K.score_pairs(_pairs(spark, sf_dir)).select("query_id", "doc_index", F.round("score", 12).alias("score"))


@query("rerank_top", f"""WITH {_PAIRS_SQL.replace('scored AS MATERIALIZED', 'lexical AS MATERIALIZED')}
SELECT query_id, doc_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM lexical) WHERE rank <= 5""")
def rerank_top(spark, sf_dir):
    scored = K.score_pairs(_pairs(spark, sf_dir)).withColumn("score", F.round("score", 12))
    return K.rank_pairs(scored, 5, return_documents=False).select("query_id", "doc_index", "score", F.col("rank").cast("bigint"))


# Answers of a conversation ranked against its first user turn.
_TALK_SQL = """asked AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
talk AS (SELECT c.conv_id AS query_id, a.query, c.turn AS doc_index, c.text FROM conversations c JOIN asked a ON a.query_id = c.conv_id WHERE c.role = 'assistant')"""


def talk_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "query_id")
    asked = c.where("role = 'user'").groupBy("query_id").agg(F.min_by("text", "turn").alias("query"))
    answers = c.where("role = 'assistant'").select("query_id", F.col("turn").alias("doc_index"), "text")
    return K.salted_join(answers, asked, ["query_id"], salts=4)


@query("rerank_all", f"""WITH {_TALK_SQL}, s AS (SELECT query_id, doc_index, round({sql_lexical('query', 'text')}, 12) AS score FROM talk)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM s""")
def rerank_all(spark, sf_dir):
    scored = K.score_pairs(talk_pairs(spark, sf_dir)).withColumn("score", F.round("score", 12))
    return K.rank_pairs(scored).select("query_id", "doc_index", "score", F.col("rank").cast("bigint"))


_PRINT_SQL = """substr(md5(query), 1, 8) || ':' || count(*) || ':5:' || sum(('0x' || substr(d, 1, 12))::BIGINT) || ':' || sum(('0x' || substr(d, 13, 12))::BIGINT)"""
_PRINTS_SQL = f"""{_TALK_SQL}, doubled AS (SELECT * FROM talk UNION ALL SELECT query_id + 1000000, query, doc_index, text FROM talk WHERE query_id % 3 = 0),
prints AS (SELECT query_id, count(*) AS n_docs, {_PRINT_SQL} AS fingerprint FROM (SELECT *, md5(doc_index || ':' || text) AS d FROM doubled) GROUP BY query_id, query)"""


def _prints(spark, sf_dir):
    """Requests of which a third arrive twice."""
    talk = talk_pairs(spark, sf_dir)
    again = talk.where("query_id % 3 = 0").withColumn("query_id", F.col("query_id") + 1000000)
    return K.fingerprints(talk.unionByName(again), 5)


@query("request_fingerprints", f"WITH {_PRINTS_SQL} SELECT query_id, n_docs, fingerprint FROM prints")
def request_fingerprints(spark, sf_dir):
    return _prints(spark, sf_dir).select("query_id", "n_docs", "fingerprint")


@query("request_dedup", f"""WITH {_PRINTS_SQL}, reps AS (SELECT fingerprint, min(query_id) AS answered_as, count(*) AS copies FROM prints GROUP BY fingerprint)
SELECT query_id, answered_as, copies FROM prints JOIN reps USING (fingerprint)""")
def request_dedup(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    return K.share_results(prints, K.representatives(prints)).select("query_id", "answered_as", "copies")


@query("result_reuse", """WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS sec, user_id || ':' || event_type AS fingerprint FROM events),
stored AS (SELECT fingerprint, max(sec) AS stored_sec FROM e WHERE sec < 1705276800 GROUP BY fingerprint)
SELECT event_id, coalesce(sec - stored_sec <= 86400, FALSE) AS reuse FROM e LEFT JOIN stored USING (fingerprint) WHERE sec >= 1705276800""")
def result_reuse(spark, sf_dir):
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select(
        "event_id", sec.alias("sec"), F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("fingerprint"))
    old = e.where("sec < 1705276800").select("fingerprint", F.col("sec").alias("stored_sec"))
    return K.reusable(e.where("sec >= 1705276800"), old, 86400).select("event_id", "reuse")


@query("rerank_model_scores", f"WITH {_TALK_SQL} SELECT query_id, doc_index, round(length(text) / (length(query) + length(text))::DOUBLE, 12) AS score FROM talk")
def rerank_model_scores(spark, sf_dir):
    """A Python model, loaded once per task and called in batches."""
    def load():
        return lambda queries, texts: [len(t) / (len(q) + len(t)) for q, t in zip(queries, texts)]

    return K.score_pairs(talk_pairs(spark, sf_dir), load).select("query_id", "doc_index", F.round("score", 12).alias("score"))
