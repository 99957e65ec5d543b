"""Inputs shared by the named queries, and the SQL text that mirrors them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import SPACES
from foliant.operators.blocks import CODE_MARKS, LIST_ITEM, blocks_from_text
from foliant.session import spread, table

# SQL text for DuckDB. The white space characters are written out literally.
_RUN = "[" + SPACES + "]+"
_CODE = " OR ".join(f"contains(content, '{m}')" for m in CODE_MARKS)


def sql_strip(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def sql_word_count(x: str) -> str:
    return (
        f"CASE WHEN {sql_strip(x)} = '' THEN 0 ELSE "
        f"len(regexp_split_to_array({sql_strip(x)}, '{_RUN}')) END"
    )


BLOCKS_SQL = f"""
lines AS (
  SELECT doc_id, source || '/doc' || doc_id AS source_path, 'doc' || doc_id AS filename, lang,
         unnest(string_split(text, chr(10))) AS raw,
         unnest(range(len(string_split(text, chr(10))))) AS para
  FROM documents),
kept AS (SELECT *, {sql_strip('raw')} AS content FROM lines WHERE {sql_strip('raw')} <> ''),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS block_idx,
         length(content) < 100 AND regexp_matches(content, '\\p{{Lu}}')
           AND NOT regexp_matches(content, '[\\p{{Ll}}\\p{{Lt}}]') AS is_header
  FROM kept),
blocks AS (
  SELECT *,
    CASE WHEN is_header THEN 'header' WHEN regexp_matches(content, '{LIST_ITEM}') THEN 'list'
         WHEN {_CODE} THEN 'code' ELSE 'text' END AS block_type,
    last_value(CASE WHEN is_header THEN content END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
    sum(is_header::INT) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head_no
  FROM flagged),
embedded AS (
  SELECT *, CASE WHEN section IS NOT NULL AND section <> '' THEN '[Section: ' || section || ']' || chr(10) ELSE '' END || content AS emb
  FROM blocks)
"""


def text_documents(spark, sf_dir: str) -> DataFrame:
    """Document rows with their path and blocks. The test texts break at single newlines."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    named = docs.select(
        "doc_id", "lang", "source", "text",
        F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string")).alias("source_path"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
    )
    return blocks_from_text(named)
