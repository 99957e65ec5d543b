"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import retrieval as R
from foliant.operators import text_index as I
from foliant.operators import vector_index as X
from foliant.operators.joins import salted_join
from foliant.plans.registry import query
from foliant.session import spread, table

_STOP = "[" + ",".join(f"'{w}'" for w in R.STOPWORDS) + "]"


def _sq(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_keywords(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}') AND NOT list_contains({_STOP}, w))")


# One question per supplier, asking for different things.
_ASK_SQL = """asks AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 6
  WHEN 0 THEN 'what is shown on page ' || (s_suppkey % 7 + 1) WHEN 1 THEN 'Table of prices in section "sec' || (s_suppkey % 4) || '"'
  WHEN 2 THEN 'which figure is in file ''file1' || (s_suppkey % 10) || '''' WHEN 3 THEN 'chart of totals' WHEN 4 THEN 'how does delivery  work?'
  ELSE 'the table for ' || s_name END AS text FROM supplier)"""


def _asks(spark, sf_dir):
    k = F.col("s_suppkey")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("what is shown on page "), (k % 7 + 1).cast("string")))
        .when(k % 6 == 1, F.concat(F.lit('Table of prices in section "sec'), (k % 4).cast("string"), F.lit('"')))
        .when(k % 6 == 2, F.concat(F.lit("which figure is in file 'file1"), (k % 10).cast("string"), F.lit("'")))
        .when(k % 6 == 3, "chart of totals").when(k % 6 == 4, "how does delivery  work?")
        .otherwise(F.concat(F.lit("the table for "), F.col("s_name")))
    )
    return table(spark, sf_dir, "supplier").select(k.alias("query_id"), text.alias("text"))


_INFO_SQL = f"""info AS (SELECT query_id, text,
  CASE WHEN regexp_matches(text, '{_sq(R.PAGE_ASK)}') THEN regexp_extract(text, '{_sq(R.PAGE_ASK)}', 1)::BIGINT END AS page,
  CASE WHEN regexp_matches(text, '{_sq(R.SECTION_ASK)}') THEN regexp_extract(text, '{_sq(R.SECTION_ASK)}', 1) END AS section,
  CASE WHEN regexp_matches(text, '{_sq(R.FILE_ASK)}') THEN regexp_extract(text, '{_sq(R.FILE_ASK)}', 1) END AS file,
  CASE WHEN regexp_matches(text, '{_sq(R.KIND_ASK)}') THEN lower(regexp_extract(text, '{_sq(R.KIND_ASK)}', 1)) END AS content_type,
  regexp_replace(regexp_replace(regexp_replace(text, '{_sq(R.PAGE_ASK)}', '', 'g'), '{_sq(R.SECTION_ASK)}', '', 'g'), '{_sq(R.FILE_ASK)}', '', 'g') AS cleaned
  FROM asks)"""


@query("query_filters", f"""WITH {_ASK_SQL}, {_INFO_SQL} SELECT query_id, page, section, file, content_type,
  trim(regexp_replace(cleaned, ' +', ' ', 'g')) AS semantic_query, array_to_string({sql_keywords('cleaned')}, ' ') AS keywords FROM info""")
def query_filters(spark, sf_dir):
    q = _asks(spark, sf_dir).withColumn("i", R.analyze_query(F.col("text")))
    return q.select("query_id", "i.page", "i.section", "i.file", "i.content_type", "i.semantic_query",
                    F.array_join("i.keywords", " ").alias("keywords"))


@query("query_keywords", f"SELECT item_id, array_to_string({sql_keywords('text')}, ' ') AS keywords FROM benchmark")
def query_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(R.query_keywords(F.col("text")), " ").alias("keywords"))


@query("document_keywords", f"SELECT doc_id, len({sql_keywords('text')})::BIGINT AS n, md5(array_to_string({sql_keywords('text')}, ' ')) AS digest FROM documents")
def document_keywords(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    k = d.select("doc_id", R.query_keywords(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("query_expansion", f"""WITH {_ASK_SQL} SELECT query_id, unnest(list_filter([text,
  CASE WHEN NOT ends_with(text, '?') THEN 'What is ' || text || '?' END, CASE WHEN NOT ends_with(text, '?') THEN 'How does ' || text || ' work?' END,
  text || ' definition', text || ' explanation'], lambda x: x IS NOT NULL)) AS variation FROM asks""")
def query_expansion(spark, sf_dir):
    return _asks(spark, sf_dir).select("query_id", F.explode(R.expand_query(F.col("text"))).alias("variation"))


_COSINE_SQL = """WITH dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS d FROM embeddings),
centers AS (SELECT label, d, avg(x) AS c FROM dims GROUP BY label, d),
qn AS (SELECT label, sqrt(sum(c * c)) AS norm FROM centers GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM dims GROUP BY vec_id),
sims AS (SELECT c.label, v.vec_id, sum(c.c * v.x) AS dot FROM dims v JOIN centers c USING (d) GROUP BY c.label, v.vec_id),
ranked AS (SELECT label::BIGINT AS query_id, vec_id AS item_id, round(dot / qn.norm / vn.norm, 10) AS score
  FROM sims JOIN qn USING (label) JOIN vn USING (vec_id))
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ranked) WHERE rank <= """


def _label_centers(spark, sf_dir):
    """The mean vector of each label as a query, and the vectors as items."""
    e = table(spark, sf_dir, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centers = means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("vec"))
    return centers, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


@query("vector_topk", _COSINE_SQL + "20")
def vector_topk(spark, sf_dir):
    """The vectors nearest to the mean of each label."""
    centers, items = _label_centers(spark, sf_dir)
    top = R.vector_topk(centers, items, 20, digits=10)  # DuckDB sums in another order
    return top.withColumns({"rank": F.col("rank").cast("bigint"), "score": F.round("score", 6)})


@query("vector_index_exact", _COSINE_SQL + "10")
def vector_index_exact(spark, sf_dir):
    """The same order from an inverted file, reading only the cells whose bound reaches the tenth score."""
    centers, items = _label_centers(spark, sf_dir)
    top = X.search_exact(centers, X.build(items), 10, digits=10)
    return top.select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("vector_index_recall")
def vector_index_recall(spark, sf_dir):
    """Share of the true ten nearest that the fitted number of cells gives, for every twentieth vector as a query."""
    _, items = _label_centers(spark, sf_dir)
    asked = items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vec")
    found = X.search(asked, X.build(items), 10)
    return X.recall(found, R.vector_topk(asked, items, 10), 10)


BM25_SQL = f"""terms AS (SELECT DISTINCT item_id AS query_id, unnest({sql_keywords('text')}) AS term FROM benchmark),
toks AS (SELECT doc_id, unnest({sql_keywords('text')}) AS term FROM documents),
lens AS (SELECT doc_id, len({sql_keywords('text')}) AS dl FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
st AS (SELECT count(*) AS n, avg(dl) AS adl FROM lens),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / adl))), 10) AS score
  FROM terms JOIN tfs USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id),
best AS (SELECT query_id, doc_id AS item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM scored) WHERE rank <= 15)"""


def bm25_best(spark, sf_dir, k: int = 15):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"))
    return R.bm25_topk(q, d, k, digits=10).withColumn("score", F.round("score", 6))  # DuckDB sums in another order


@query("bm25_topk", f"WITH {BM25_SQL} SELECT * FROM best")
def bm25_topk(spark, sf_dir):
    return bm25_best(spark, sf_dir).withColumn("rank", F.col("rank").cast("bigint"))


def _indexed(spark, sf_dir, k: int):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return I.search(q, I.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")), k, digits=10)


@query("bm25_index_topk", f"WITH {BM25_SQL}, posted AS (SELECT query_id, sum(df)::BIGINT AS postings FROM terms JOIN dfs USING (term) GROUP BY query_id) "
       "SELECT best.*, postings FROM best JOIN posted USING (query_id)")
def bm25_index_topk(spark, sf_dir):
    """The same order from posting lists with block maxima, and the length of the query's lists."""
    top = _indexed(spark, sf_dir, 15).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})
    return top.select("query_id", "item_id", "score", "rank", "postings")


@query("bm25_index_reads")
def bm25_index_reads(spark, sf_dir):
    """Postings of each query's terms, and how many were decoded to find its best."""
    return _indexed(spark, sf_dir, 15).select("query_id", "postings", "postings_read").distinct()


# Order lines as candidates: the supplier is the query, the part gives the file.
_CAND_SQL = f"""{_ASK_SQL}, {_INFO_SQL},
cand AS (SELECT l_suppkey AS query_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS idx,
  'file' || (l_partkey % 20) AS source, CASE WHEN l_quantity < 10 THEN NULL ELSE 'Sec' || (l_quantity::BIGINT % 5) END AS section,
  CASE WHEN l_linenumber % 3 = 0 THEN [l_linenumber, l_linenumber + 1] WHEN l_linenumber % 3 = 1 THEN [l_linenumber] ELSE [l_linenumber + 3, l_linenumber, l_linenumber + 1] END AS pages,
  l_returnflag = 'R' AS has_table, l_linestatus = 'F' AS has_image, round(l_extendedprice / 100000, 3) AS score, 'line ' || l_orderkey || '/' || l_linenumber AS content
  FROM lineitem),
kept AS (SELECT c.*, i.content_type AS f_content_type FROM cand c JOIN info i USING (query_id)
  WHERE (i.page IS NULL OR list_contains(c.pages, i.page::INT)) AND (i.section IS NULL OR (c.section IS NOT NULL AND contains(lower(c.section), lower(i.section))))
    AND (i.file IS NULL OR contains(lower(c.source), lower(i.file))) AND (coalesce(i.content_type, '') <> 'table' OR c.has_table)
    AND (coalesce(i.content_type, '') NOT IN ('image', 'figure', 'chart') OR c.has_image)),
boosted AS (SELECT * REPLACE (round(score * CASE WHEN f_content_type = 'table' AND has_table THEN 1.2::DOUBLE
    WHEN f_content_type IN ('image', 'figure', 'chart') AND has_image THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score) FROM kept),
counted AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, idx) - 1 AS a,
  row_number() OVER (PARTITION BY query_id, source, section ORDER BY score DESC, idx) - 1 AS b, count(*) OVER (PARTITION BY query_id) AS n FROM boosted),
adjusted AS (SELECT *, round(CASE WHEN n <= 10 THEN score ELSE score * (1 - (a * 0.1::DOUBLE + b * 0.2::DOUBLE) * 0.1::DOUBLE) END, 6) AS adjusted FROM counted),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, score DESC, idx) AS rank FROM adjusted) WHERE rank <= 10),
cited AS (SELECT *, list_sort(list_distinct(pages)) AS ps FROM top),
named AS (SELECT *, '[' || source || CASE WHEN section IS NOT NULL THEN ', ' || section ELSE '' END || ', ' || CASE len(ps) WHEN 1 THEN 'p. ' || ps[1]
  WHEN 2 THEN 'pp. ' || ps[1] || ', ' || ps[2] ELSE 'pp. ' || ps[1] || '-' || ps[-1] END || ']' AS citation FROM cited)"""


def candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    info = _asks(spark, sf_dir).withColumn("i", R.analyze_query(F.col("text"))).select(
        "query_id", F.col("i.page").cast("int").alias("f_page"), F.col("i.section").alias("f_section"),
        F.col("i.file").alias("f_file"), F.col("i.content_type").alias("f_content_type"))
    rows = li.select(
        F.col("l_suppkey").alias("query_id"),
        # a unique place made of the row's own values, so no numbering pass is needed
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("idx"),
        F.concat(F.lit("file"), (F.col("l_partkey") % 20).cast("string")).alias("source"),
        F.when(q >= 10, F.concat(F.lit("Sec"), (q.cast("bigint") % 5).cast("string"))).alias("section"),
        F.when(n % 3 == 0, F.array(n, n + 1)).when(n % 3 == 1, F.array(n)).otherwise(F.array(n + 3, n, n + 1)).alias("pages"),
        (F.col("l_returnflag") == "R").alias("has_table"), (F.col("l_linestatus") == "F").alias("has_image"),
        F.round(F.col("l_extendedprice") / 100000, 3).alias("score"),
        F.concat(F.lit("line "), F.col("l_orderkey").cast("string"), F.lit("/"), n.cast("string")).alias("content"),
    )
    return salted_join(rows, info, ["query_id"], salts=8)


def ranked(spark, sf_dir):
    top = R.rerank_results(candidates(spark, sf_dir), 10, digits=6)
    return top.withColumn("citation", R.result_citation(F.col("source"), F.col("section"), F.col("pages")))


@query("result_filters", f"WITH {_CAND_SQL} SELECT query_id, content, score FROM kept")
def result_filters(spark, sf_dir):
    return R.filter_results(candidates(spark, sf_dir)).select("query_id", "content", "score")


@query("result_boost", f"WITH {_CAND_SQL} SELECT query_id, content, score FROM boosted")
def result_boost(spark, sf_dir):
    return R.boost(R.filter_results(candidates(spark, sf_dir))).select("query_id", "content", F.round("score", 6).alias("score"))


@query("result_diversity", f"WITH {_CAND_SQL} SELECT query_id, content, adjusted FROM adjusted")
def result_diversity(spark, sf_dir):
    kept = R.boost(R.filter_results(candidates(spark, sf_dir))).withColumn("score", F.round("score", 6))
    return R.diversify(kept, 10).select("query_id", "content", F.round("adjusted", 6).alias("adjusted"))


@query("result_top", f"WITH {_CAND_SQL} SELECT query_id, rank, content, adjusted, citation FROM named")
def result_top(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", F.col("rank").cast("bigint"), "content", "adjusted", "citation")


@query("inline_citation", f"""WITH {_CAND_SQL} SELECT query_id, rank, '[' || source || CASE WHEN section IS NOT NULL THEN ', ' || section ELSE '' END || ', ' ||
  CASE WHEN len(ps) = 1 THEN 'p. ' || ps[1] ELSE 'pp. ' || ps[1] || '-' || ps[-1] END || ']' AS citation FROM cited""")
def inline_citation(spark, sf_dir):
    c = R.inline_citation(F.col("source"), F.col("section"), F.col("pages"))
    return ranked(spark, sf_dir).select("query_id", F.col("rank").cast("bigint"), c.alias("citation"))


@query("context_text", f"""WITH {_CAND_SQL} SELECT query_id,
  string_agg('[' || rank || '] ' || citation || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS context FROM named GROUP BY query_id""")
def context_text(spark, sf_dir):
    return R.format_context(ranked(spark, sf_dir))


_RESP_SQL = """responses AS (SELECT s_suppkey AS query_id, 'See [1][' || (s_suppkey % 14) || '] and [99] but not [x] or [' || (s_suppkey % 3 + 2) || '].' AS response FROM supplier)"""


def _responses(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("See [1]["), (k % 14).cast("string"), F.lit("] and [99] but not [x] or ["), (k % 3 + 2).cast("string"), F.lit("]."))
    return table(spark, sf_dir, "supplier").select(k.alias("query_id"), text.alias("response"))


@query("citation_resolution", f"""WITH {_CAND_SQL}, {_RESP_SQL},
marks AS (SELECT query_id, unnest(regexp_extract_all(response, '\\[([0-9]+)\\]', 1))::BIGINT AS ref FROM responses)
SELECT m.query_id, m.ref, n.source, n.citation FROM marks m JOIN named n ON n.query_id = m.query_id AND n.rank = m.ref""")
def citation_resolution(spark, sf_dir):
    out = R.resolve_citations(_responses(spark, sf_dir), ranked(spark, sf_dir))
    return out.select("query_id", F.col("ref").cast("bigint"), "source", "citation")


@query("citation_expansion", f"""WITH {_CAND_SQL}, {_RESP_SQL},
p AS (SELECT query_id, 'See ' AS a, s AS b FROM (SELECT s_suppkey AS query_id, 1 AS s FROM supplier)),
refs AS (SELECT s_suppkey AS query_id, unnest([1, s_suppkey % 14, 99, s_suppkey % 3 + 2]) AS ref, unnest([1, 2, 3, 4]) AS pos FROM supplier),
txt AS (SELECT r.query_id, pos, coalesce(citation, '[' || ref || ']') AS t FROM refs r LEFT JOIN named n ON n.query_id = r.query_id AND n.rank = r.ref),
w AS (SELECT query_id, list(t ORDER BY pos) AS t FROM txt GROUP BY query_id)
SELECT query_id, 'See ' || t[1] || t[2] || ' and ' || t[3] || ' but not [x] or ' || t[4] || '.' AS response FROM w""")
def citation_expansion(spark, sf_dir):
    return R.expand_citations(_responses(spark, sf_dir), ranked(spark, sf_dir)).select("query_id", "response")


@query("source_list", f"""WITH {_CAND_SQL},
files AS (SELECT query_id, source, min(rank) AS first, list_sort(list_distinct(flatten(list(pages)))) AS ps,
  list_sort(list_distinct(list(section) FILTER (WHERE section IS NOT NULL))) AS ss FROM top GROUP BY query_id, source)
SELECT query_id, '**Sources:**' || chr(10) || string_agg('- ' || source || ', Pages: ' || array_to_string(ps, ', ') ||
  CASE WHEN len(ss) > 0 THEN ', Sections: ' || array_to_string(ss, ', ') ELSE '' END, chr(10) ORDER BY first) AS sources FROM files GROUP BY query_id""")
def source_list(spark, sf_dir):
    return R.source_list(ranked(spark, sf_dir))
