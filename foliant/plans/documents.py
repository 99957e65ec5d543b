"""Block construction and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.arrays import explode_indexed
from foliant.functions.text import word_count
from foliant.operators import blocks as B
from foliant.operators import chunks as C
from foliant.plans.registry import query
from foliant.plans.shared import BLOCKS_SQL, sql_strip, sql_word_count, text_documents
from foliant.operators.ordered import row_numbers
from foliant.session import spread, table


@query("block_paragraphs", f"WITH {BLOCKS_SQL} SELECT doc_id, block_idx, para, content FROM blocks")
def block_paragraphs(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    return B.explode_blocks(docs, "doc_id").select(
        "doc_id", F.col("block_idx").cast("bigint"), F.col("para").cast("bigint"), "content"
    )


@query("block_types", f"WITH {BLOCKS_SQL} SELECT doc_id, block_type, count(*) AS n, "
       "sum(length(content))::BIGINT AS chars FROM blocks GROUP BY ALL")
def block_types(spark, sf_dir):
    rows = B.explode_blocks(text_documents(spark, sf_dir), "doc_id")
    return rows.groupBy("doc_id", "block_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")
    )


@query("block_header_test", f"""WITH {BLOCKS_SQL} SELECT doc_id, block_idx, content FROM blocks WHERE is_header""")
def block_header_test(spark, sf_dir):
    rows = B.explode_blocks(text_documents(spark, sf_dir), "doc_id")
    return rows.where(B.is_header(F.col("content"))).select("doc_id", F.col("block_idx").cast("bigint"), "content")


@query("block_list_and_code_tests", f"""WITH {BLOCKS_SQL}, pieces AS (
  SELECT doc_id, block_idx, unnest(string_split(content, '. ')) AS content FROM blocks)
SELECT doc_id, sum(regexp_matches(content, '{B.LIST_ITEM}')::INT)::BIGINT AS list_items,
  sum(({" OR ".join(f"contains(content, '{m}')" for m in B.CODE_MARKS)})::INT)::BIGINT AS code_items
FROM (SELECT doc_id, {sql_strip('content')} AS content FROM pieces) GROUP BY doc_id""")
def block_list_and_code_tests(spark, sf_dir):
    rows = B.explode_blocks(text_documents(spark, sf_dir), "doc_id")
    pieces = rows.select("doc_id", F.explode(F.split("content", r"\. ")).alias("content"))
    return pieces.groupBy("doc_id").agg(
        F.count_if(B.is_list_item(F.col("content"))).alias("list_items"),
        F.count_if(B.is_code(F.col("content"))).alias("code_items"),
    )


@query("block_sections", f"""WITH {BLOCKS_SQL}
SELECT doc_id, block_idx, section,
  CASE WHEN is_header THEN coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY block_idx), 0) ELSE n - 1 END AS para_in_section
FROM (SELECT *, sum((NOT is_header)::INT) OVER (PARTITION BY doc_id, head_no ORDER BY block_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS n FROM blocks)""")
def block_sections(spark, sf_dir):
    rows = B.explode_blocks(text_documents(spark, sf_dir), "doc_id")
    return rows.select(
        "doc_id", F.col("block_idx").cast("bigint"), "section", F.col("para_in_section").cast("bigint")
    )


@query("block_embedding_text", f"WITH {BLOCKS_SQL} SELECT doc_id, block_idx, emb FROM embedded")
def block_embedding_text(spark, sf_dir):
    docs = text_documents(spark, sf_dir).withColumn("emb", F.transform("blocks", B.embedding_text))
    return explode_indexed(docs, ["doc_id"], "emb", "block_idx", "emb").select(
        "doc_id", F.col("block_idx").cast("bigint"), "emb"
    )


# Order lines as small tables: one table per order, a header row and one row per line.
_ORDER_GRID_SQL = """
SELECT l_orderkey AS order_id,
  'Part | Supplier | Quantity' AS header_line,
  count(*) AS n_rows,
  '| Part | Supplier | Quantity |' || chr(10) || '|---|---|---|' || chr(10) ||
    string_agg('| ' || l_partkey || ' | ' || l_suppkey || ' | ' || l_quantity::BIGINT || ' |', chr(10)
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS table_text,
  'Table columns: Part, Supplier, Quantity' || chr(10) ||
    array_to_string(list_slice(list(l_partkey || ' | ' || l_suppkey || ' | ' || l_quantity::BIGINT
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), 1, 5), chr(10)) ||
    CASE WHEN count(*) > 5 THEN chr(10) || '... and ' || (count(*) - 5) || ' more rows' ELSE '' END AS emb
FROM lineitem GROUP BY l_orderkey"""


@query("block_tables", _ORDER_GRID_SQL)
def block_tables(spark, sf_dir):
    """Each order as one table block. An order has few lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            F.array(
                F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                F.col("l_quantity").cast("bigint").cast("string"),
            ).alias("cells"),
        ).alias("line"),
    )
    head = F.array(F.lit("Part"), F.lit("Supplier"), F.lit("Quantity"))
    grids = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    block = B.table_block(F.concat(F.array(head), F.transform("lines", lambda x: x["cells"])))
    t = grids.withColumn("t", block).where("t IS NOT NULL")
    fields = {"block_type": F.lit("table"), "headers": F.col("t.headers"), "rows": F.col("t.rows"),
              "content": B.table_text(F.col("t.headers"), F.col("t.rows"))}
    return t.withColumn("b", B._block(fields)).select(
        F.col("l_orderkey").alias("order_id"),
        F.array_join("b.headers", " | ").alias("header_line"),
        F.size("b.rows").cast("bigint").alias("n_rows"),
        F.col("b.content").alias("table_text"),
        B.embedding_text(F.col("b")).alias("emb"),
    )


# ---- chunks -------------------------------------------------------------

def _greedy_sql(size: str, cut_also: str, limit: int, name: str = "starts") -> str:
    """Recursive walk that restarts its size at each cut; gives cut flags per block."""
    return f"""
walk AS (
  SELECT doc_id, block_idx, {size} AS size, TRUE AS cut FROM embedded WHERE block_idx = 0
  UNION ALL
  SELECT e.doc_id, e.block_idx,
    CASE WHEN {cut_also} OR w.size + e.{size} > {limit} THEN e.{size} ELSE w.size + e.{size} END,
    ({cut_also} OR w.size + e.{size} > {limit})
  FROM walk w JOIN embedded e ON e.doc_id = w.doc_id AND e.block_idx = w.block_idx + 1)"""


_ASSEMBLE_SQL = f"""
numbered AS (SELECT e.*, sum(cut::INT) OVER (PARTITION BY e.doc_id ORDER BY e.block_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS chunk_no
  FROM embedded e JOIN cuts w USING (doc_id, block_idx)),
chunks AS (
  SELECT doc_id, chunk_no::BIGINT AS chunk_no, min(filename) AS filename,
    substr(md5(min(source_path) || ':' || min(block_idx) || ':' || max(block_idx)), 1, 16) AS chunk_id,
    string_agg(content, chr(10) || chr(10) ORDER BY block_idx) AS content,
    'Source: ' || min(filename) || chr(10) || chr(10) || string_agg(emb, chr(10) || chr(10) ORDER BY block_idx) AS embedding_text,
    arg_min(coalesce(section, ''), block_idx) AS section,
    array_to_string(list_sort(list(DISTINCT block_type)), ',') AS content_types,
    '1' AS pages,
    min(block_idx)::BIGINT AS start_block, max(block_idx)::BIGINT AS end_block
  FROM numbered GROUP BY doc_id, chunk_no)"""
_CHUNK_COLS_SQL = f"""
SELECT doc_id, chunk_no, chunk_id, content, embedding_text, section, content_types, pages, start_block, end_block,
  {sql_word_count('embedding_text')}::BIGINT AS token_count, length(content)::BIGINT AS char_count FROM chunks"""


def _chunk_columns(df):
    return df.select(
        "doc_id", F.col("chunk_no").cast("bigint"), "chunk_id", "content", "embedding_text",
        F.coalesce("section", F.lit("")).alias("section"),
        F.array_join("content_types", ",").alias("content_types"),
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.col("start_block").cast("bigint"), F.col("end_block").cast("bigint"),
        F.col("token_count").cast("bigint"), F.col("char_count").cast("bigint"),
    )


_HYBRID_CUTS = "cuts AS (SELECT * FROM walk)"
_HYBRID_SQL = f"WITH RECURSIVE {BLOCKS_SQL}, " + _greedy_sql("emb_len", "e.is_header", 600).replace(
    "emb_len AS size", "length(emb) AS size").replace("e.emb_len", "length(e.emb)")
_PARA_SQL = f"WITH RECURSIVE {BLOCKS_SQL}, " + _greedy_sql("emb_len", "FALSE", 600).replace(
    "emb_len AS size", "length(content) AS size").replace("e.emb_len", "length(e.content)")
_SEMANTIC_SQL = f"WITH {BLOCKS_SQL}, cuts AS (SELECT doc_id, block_idx, (block_idx = 0 OR is_header) AS cut FROM blocks)"


@query("chunk_hybrid", f"{_HYBRID_SQL}, {_HYBRID_CUTS}, {_ASSEMBLE_SQL} {_CHUNK_COLS_SQL}")
def chunk_hybrid(spark, sf_dir):
    return _chunk_columns(C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "hybrid", 600))


@query("chunk_paragraph", f"{_PARA_SQL}, {_HYBRID_CUTS}, {_ASSEMBLE_SQL} {_CHUNK_COLS_SQL}")
def chunk_paragraph(spark, sf_dir):
    return _chunk_columns(C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "paragraph", 600))


@query("chunk_semantic", f"{_SEMANTIC_SQL}, {_ASSEMBLE_SQL} {_CHUNK_COLS_SQL}")
def chunk_semantic(spark, sf_dir):
    return _chunk_columns(C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "semantic"))


_SENTENCE_SQL = f"""WITH RECURSIVE {BLOCKS_SQL},
joined AS (SELECT doc_id, string_agg(content, ' ' ORDER BY block_idx) FILTER (WHERE block_type = 'text') AS text
  FROM blocks GROUP BY doc_id),
marked AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ ]+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM joined),
sents AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM marked),
walk AS (
  SELECT doc_id, i, length(s) AS size, 0 AS chunk_no FROM sents WHERE i = 0
  UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN w.size + length(n.s) > 400 THEN length(n.s) ELSE w.size + length(n.s) END,
    CASE WHEN w.size + length(n.s) > 400 THEN w.chunk_no + 1 ELSE w.chunk_no END
  FROM walk w JOIN sents n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
packed AS (SELECT doc_id, chunk_no, string_agg(s, ' ' ORDER BY i) AS content
  FROM walk JOIN sents USING (doc_id, i) GROUP BY doc_id, chunk_no)"""
_SIMPLE_COLS_SQL = f"""
SELECT doc_id, chunk_no::BIGINT AS chunk_no,
  substr(md5(source || '/doc' || doc_id || ':' || chunk_no || ':' || chunk_no), 1, 16) AS chunk_id,
  content, 'Source: doc' || doc_id || chr(10) || chr(10) || content AS embedding_text,
  {sql_word_count('content')}::BIGINT AS token_count, length(content)::BIGINT AS char_count,
  '1' AS pages, 'text' AS content_types
FROM packed JOIN documents USING (doc_id)"""


def _simple_columns(df):
    return df.select(
        "doc_id", F.col("chunk_no").cast("bigint"), "chunk_id", "content", "embedding_text",
        F.col("token_count").cast("bigint"), F.col("char_count").cast("bigint"),
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.array_join("content_types", ",").alias("content_types"),
    )


@query("chunk_sentence", _SENTENCE_SQL + _SIMPLE_COLS_SQL)
def chunk_sentence(spark, sf_dir):
    return _simple_columns(C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "sentence", 400))


_FIXED_SQL = f"""WITH RECURSIVE {BLOCKS_SQL},
full_text AS (SELECT doc_id, string_agg(emb, chr(10) || chr(10) ORDER BY block_idx) AS t FROM embedded GROUP BY doc_id),
walk AS (
  SELECT doc_id, 0 AS i, 0::BIGINT AS s, (CASE WHEN length(t) <= 500 THEN length(t)
      WHEN strpos(reverse(substr(t, 1, 500)), ' ') BETWEEN 1 AND 499 THEN 500 - strpos(reverse(substr(t, 1, 500)), ' ')
      ELSE 500 END)::BIGINT AS e, length(t)::BIGINT AS n
  FROM full_text WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, i + 1, ns, CASE WHEN ns + 500 >= n THEN n
      WHEN p BETWEEN 1 AND 499 THEN ns + 500 - p ELSE ns + 500 END, n
  FROM (SELECT w.doc_id, w.i, w.n, w.ns, strpos(reverse(substr(f.t, (w.ns + 1)::BIGINT, 500)), ' ') AS p
        FROM (SELECT *, CASE WHEN e - 60 > s THEN e - 60 ELSE e END AS ns FROM walk WHERE e < n) w
        JOIN full_text f ON f.doc_id = w.doc_id)),
cut AS (SELECT doc_id, i, {sql_strip('substr(t, (s + 1)::BIGINT, (e - s)::BIGINT)')} AS content FROM walk JOIN full_text USING (doc_id)),
packed AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no FROM cut WHERE content <> '')"""


@query("chunk_fixed_size", _FIXED_SQL + _SIMPLE_COLS_SQL)
def chunk_fixed_size(spark, sf_dir):
    return _simple_columns(
        C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "fixed_size", 500, overlap=60)
    )


@query("chunk_overlap", f"""{_HYBRID_SQL}, {_HYBRID_CUTS}, {_ASSEMBLE_SQL},
tails AS (
  SELECT doc_id, chunk_no, content, embedding_text, right(content, 80) AS tail, content AS full_content, embedding_text AS full_emb
  FROM chunks WHERE chunk_no = 0
  UNION ALL
  SELECT c.doc_id, c.chunk_no, c.content, c.embedding_text,
    right('[...] ' || t.tail || chr(10) || chr(10) || c.content, 80),
    '[...] ' || t.tail || chr(10) || chr(10) || c.content,
    '[Previous context:] ' || t.tail || chr(10) || chr(10) || c.embedding_text
  FROM tails t JOIN chunks c ON c.doc_id = t.doc_id AND c.chunk_no = t.chunk_no + 1)
SELECT doc_id, chunk_no, full_content AS content, full_emb AS embedding_text, length(content)::BIGINT AS char_count FROM tails""")
def chunk_overlap(spark, sf_dir):
    df = C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "hybrid", 600, overlap=80)
    return df.select(
        "doc_id", F.col("chunk_no").cast("bigint"), "content", "embedding_text", F.col("char_count").cast("bigint")
    )


@query("chunk_citations", f"""{_HYBRID_SQL}, {_HYBRID_CUTS}, {_ASSEMBLE_SQL}
SELECT chunk_id, filename || CASE WHEN section <> '' THEN ', Section: ' || section ELSE '' END || ', Page ' || pages AS citation FROM chunks""")
def chunk_citations(spark, sf_dir):
    df = C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "hybrid", 600)
    return df.select("chunk_id", C.citation(F.col("filename"), F.col("section"), F.col("pages")).alias("citation"))


@query("token_counts", f"SELECT doc_id, {sql_word_count('text')}::BIGINT AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", word_count(F.col("text")).cast("bigint").alias("tokens"))


@query("corpus_overview", f"""{_PARA_SQL}, {_HYBRID_CUTS}, {_ASSEMBLE_SQL}
SELECT lang, count(*) AS chunks, round(avg(length(content)), 4) AS mean_chars,
  round(avg((contains(lower(content), 'malicious') OR contains(lower(content), 'dangerous'))::INT), 6) AS blocked_share
FROM chunks JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang""")
def corpus_overview(spark, sf_dir):
    """Documents to chunks to a banned-word scan, then one line per language."""
    df = C.chunk_documents(text_documents(spark, sf_dir), ["doc_id", "lang"], "paragraph", 600)
    low = F.lower("content")
    banned = low.contains("malicious") | low.contains("dangerous")
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg("char_count"), 4).alias("mean_chars"),
        F.round(F.avg(banned.cast("int")), 6).alias("blocked_share"),
    )
