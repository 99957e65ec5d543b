"""Metadata and language queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import extract as X
from foliant.functions import language as L
from foliant.operators.metadata import contents_of, document_metadata, full_text
from foliant.plans.registry import query
from foliant.plans.shared import BLOCKS_SQL, sql_word_count, text_documents
from foliant.session import spread, table

_FULL = f"""WITH {BLOCKS_SQL}, full_texts AS (SELECT doc_id, min(filename) AS filename, string_agg(content, ' ' ORDER BY block_idx) AS t,
  list(content ORDER BY block_idx) FILTER (WHERE is_header) AS heads FROM blocks GROUP BY doc_id)"""


def _all(pattern: str, text: str = "t") -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


def _sorted(items: str) -> str:
    return f"array_to_string(list_sort(list_distinct({items})), ' ; ')"


_B = r"\b"
_DATES = "list_concat(" + ", ".join(_all("(?i)" + _B + b + _B) for b in X.DATE_BODIES[:2]) + ")"
_DATES = f"list_concat({_DATES}, {_all('(?i)' + _B + X.DATE_BODIES[2] + _B)})"
_NUMS = (f"list_filter({_all(_B + X.NUMBER_BODY + _B)}, lambda n: contains(n, ',') OR replace(n, ',', '')::DOUBLE > 100)")


def _joined(c):
    return F.array_join(c, " ; ")


@query("entity_lists", f"""{_FULL}
SELECT doc_id, {_sorted(_DATES)} AS dates, {_sorted(_all('(?i)' + _B + X.EMAIL_BODY + _B))} AS emails,
  {_sorted(_all('(?i)' + X.URL_BODY))} AS urls FROM full_texts""")
def entity_lists(spark, sf_dir):
    docs = text_documents(spark, sf_dir).withColumn("t", full_text(F.col("blocks")))
    t = F.col("t")
    return docs.select(
        "doc_id", _joined(X.dates(t)).alias("dates"), _joined(X.emails(t)).alias("emails"), _joined(X.urls(t)).alias("urls")
    )


@query("document_phones", f"""{_FULL}
SELECT doc_id, {_sorted("regexp_extract_all(t, '(?i)(?:^|[^" + chr(92) + "p{L}" + chr(92) + "p{N}_])(" + X.PHONE_BODY + ")" + _B + "', 1)")} AS phones FROM full_texts""")
def document_phones(spark, sf_dir):
    docs = text_documents(spark, sf_dir).withColumn("t", full_text(F.col("blocks")))
    return docs.select("doc_id", _joined(X.phones(F.col("t"))).alias("phones"))


@query("page_urls", f"""SELECT page_id, {_sorted(_all('(?i)' + X.URL_BODY, "url || ' ' || html"))} AS urls,
  {_sorted(_DATES.replace('(t,', "(html,"))} AS dates FROM pages""")
def page_urls(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select(
        "page_id",
        _joined(X.urls(F.concat_ws(" ", "url", "html"))).alias("urls"),
        _joined(X.dates(F.col("html"))).alias("dates"),
    )


@query("order_date_entities", f"""SELECT o_orderkey, {_sorted(_DATES)} AS dates, {_sorted(_NUMS)} AS numbers
FROM (SELECT o_orderkey, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ', due ' || strftime(o_orderdate, '%d/%m/%Y')
  || ' or ' || strftime(o_orderdate, '%b %d, %Y') || ' for ' || (floor(o_totalprice)::BIGINT // 1000) || ',' ||
  lpad((floor(o_totalprice)::BIGINT % 1000)::VARCHAR, 3, '0') || ' and ' || o_custkey AS t FROM orders)""")
def order_date_entities(spark, sf_dir):
    """Dates in three forms and grouped numbers, in text made from every order."""
    price = F.floor("o_totalprice")
    o = table(spark, sf_dir, "orders")
    t = F.concat(
        F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", due "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit(" or "), F.date_format("o_orderdate", "MMM dd, yyyy"), F.lit(" for "), F.expr("floor(o_totalprice) div 1000").cast("string"),
        F.lit(","), F.lpad((price % 1000).cast("string"), 3, "0"), F.lit(" and "), F.col("o_custkey").cast("string"),
    )
    rows = o.select("o_orderkey", t.alias("t"))
    return rows.select("o_orderkey", _joined(X.dates(F.col("t"))).alias("dates"), _joined(X.significant_numbers(F.col("t"))).alias("numbers"))


@query("significant_numbers", f"""{_FULL} SELECT doc_id, {_sorted(_NUMS)} AS numbers FROM full_texts""")
def significant_numbers(spark, sf_dir):
    docs = text_documents(spark, sf_dir).withColumn("t", full_text(F.col("blocks")))
    return docs.select("doc_id", _joined(X.significant_numbers(F.col("t"))).alias("numbers"))


@query("text_stats", f"""{_FULL}
SELECT doc_id, length(t)::BIGINT AS char_count, ({sql_word_count('t')})::BIGINT AS word_count,
  round(({sql_word_count('t')}) / 3.0::DOUBLE, 6) AS avg_words_per_page FROM full_texts""")
def text_stats(spark, sf_dir):
    m = document_metadata(text_documents(spark, sf_dir), ["doc_id"], F.lit(None).cast("string"), pages=F.lit(3))
    return m.select(
        "doc_id", F.col("char_count").cast("bigint"), F.col("word_count").cast("bigint"),
        F.round("avg_words_per_page", 6).alias("avg_words_per_page"),
    )


@query("content_type_counts", f"""WITH {BLOCKS_SQL}
SELECT doc_id, (count(*) FILTER (WHERE block_type = 'table'))::BIGINT AS tables, count(*) FILTER (WHERE is_header) AS headers,
  coalesce(string_agg(content, ' > ' ORDER BY block_idx) FILTER (WHERE is_header), '') AS sections FROM blocks GROUP BY doc_id""")
def content_type_counts(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    heads = contents_of(F.col("blocks"), "header")
    return docs.select(
        "doc_id",
        F.size(F.filter("blocks", lambda b: b["block_type"] == "table")).cast("bigint").alias("tables"),
        F.size(heads).cast("bigint").alias("headers"),
        F.array_join(heads, " > ").alias("sections"),
    )


_KEYWORDS_SQL = """array_to_string(list_sort(list_filter(list_distinct(list_transform(
  list_filter(string_split(title || ' ' || coalesce(array_to_string(heads, ' '), ''), ' '), lambda w: length(w) > 3), lambda w: lower(w))),
  lambda w: NOT list_contains(['the','and','for','with','from','that','this','have','been'], w))), ' ; ')"""


@query("header_keywords", f"""{_FULL} SELECT doc_id, {_KEYWORDS_SQL} AS keywords
FROM (SELECT *, regexp_extract(t, '^[^.!?]*') AS title FROM full_texts)""")
def header_keywords(spark, sf_dir):
    docs = text_documents(spark, sf_dir).withColumn("title", F.regexp_extract(full_text(F.col("blocks")), "^[^.!?]*", 0))
    return docs.select(
        "doc_id", _joined(X.keywords(F.col("title"), contents_of(F.col("blocks"), "header"))).alias("keywords")
    )


def _hits(words, text="low"):
    return " + ".join(f"contains({text}, '{w}')::INT" for w in words)


_LANG_SQL = "CASE " + " ".join(
    f"WHEN s_{c} = greatest({', '.join('s_' + k for k in L.INDICATORS)}) THEN '{c}'" for c in L.INDICATORS) + " END"
_LANG_COLS = ", ".join(f"{_hits(w)} AS s_{c}" for c, w in L.INDICATORS.items())


@query("language_by_words", f"""SELECT doc_id, {_LANG_SQL} AS detected FROM (SELECT doc_id, {_LANG_COLS}
FROM (SELECT doc_id, lower(text) AS low FROM documents))""")
def language_by_words(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", L.by_indicators(F.col("text")).alias("detected"))


_SCRIPT_SQL = "CASE WHEN coalesce(text, '') = '' THEN 'en' " + " ".join(
    f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in L.SCRIPTS.items())
_GREETINGS = {0: "你好", 1: "こんにちは", 2: "안녕하세요", 3: "Привет", 4: "مرحبا", 5: "đó là", 6: ""}


@query("language_by_script", f"""WITH t AS (SELECT conv_id, turn, (['你好','こんにちは','안녕하세요','Привет','مرحبا','đó là',''])[((conv_id + turn) % 7 + 1)::INT] || ' ' || text AS text FROM conversations)
SELECT conv_id, turn, {_SCRIPT_SQL} ELSE CASE WHEN d IN ('en','ja','zh','ko','de','fr') THEN d ELSE 'en' END END AS detected
FROM (SELECT *, {_LANG_SQL} AS d FROM (SELECT *, {_LANG_COLS} FROM (SELECT *, lower(text) AS low FROM t)))""")
def language_by_script(spark, sf_dir):
    """Every turn with a greeting in one of several scripts put before it."""
    greet = F.element_at(F.array(*[F.lit(g) for g in _GREETINGS.values()]), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(greet, F.lit(" "), F.col("text")).alias("text"))
    t = F.col("text")
    return turns.select("conv_id", "turn", L.by_script(t, L.by_indicators(t)).alias("detected"))


@query("language_codes", """WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX' WHEN 2 THEN 'PT-br'
  WHEN 3 THEN 'zh-TW' ELSE 'x' || lang END AS code FROM documents)
SELECT doc_id, CASE WHEN b IN ('en','zh','vi','ja','ko','ru','ar','fr','de','es','pt') THEN b ELSE 'en' END AS code
FROM (SELECT doc_id, split_part(lower(code), '-', 1) AS b FROM c)""")
def language_codes(spark, sf_dir):
    k = F.col("doc_id") % 5
    code = (F.when(k == 0, F.col("lang")).when(k == 1, F.concat(F.upper("lang"), F.lit("-XX"))).when(k == 2, "PT-br")
            .when(k == 3, "zh-TW").otherwise(F.concat(F.lit("x"), F.col("lang"))))
    return table(spark, sf_dir, "documents").select("doc_id", L.normal_code(code).alias("code"))


_TYPE_COLS = ", ".join(f"{_hits(w)} AS s_{c}" for c, w in X.TYPE_INDICATORS.items())
_TYPE_TOP = f"greatest({', '.join('s_' + c for c in X.TYPE_INDICATORS)})"
_TYPE_SQL = "CASE " + " ".join(f"WHEN s_{c} = {_TYPE_TOP} AND s_{c} >= 2 THEN '{c}'" for c in X.TYPE_INDICATORS) + " ELSE 'document' END"


@query("document_types", f"""{_FULL} SELECT doc_id, {_TYPE_SQL} AS document_type FROM (SELECT doc_id, {_TYPE_COLS}
FROM (SELECT doc_id, lower(t || ' total steps') AS low FROM full_texts))""")
def document_types(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    t = F.concat(full_text(F.col("blocks")), F.lit(" total steps"))
    return docs.select("doc_id", X.document_type(t, F.lit(0), F.lit(1)).alias("document_type"))


_BARS = "len(regexp_extract_all(text, '\\|[^|\n]*\\|[^|\n]*\\|'))"


@query("spreadsheet_types", f"""{_FULL}, bars AS (SELECT doc_id, {_BARS} AS tables, 1 + len(text) // 3000 AS pages FROM documents)
SELECT doc_id, CASE WHEN tables / pages::DOUBLE > 0.5 THEN 'spreadsheet' ELSE {_TYPE_SQL} END AS document_type FROM (SELECT doc_id, {_TYPE_COLS}
FROM (SELECT doc_id, lower(t) AS low FROM full_texts)) JOIN bars USING (doc_id)""")
def spreadsheet_types(spark, sf_dir):
    """Document types where rows of bars count as tables and 3,000 characters as a page."""
    tables = F.size(F.regexp_extract_all("text", F.lit(r"\|[^|\n]*\|[^|\n]*\|"), F.lit(0)))
    docs = text_documents(spark, sf_dir)
    kind = X.document_type(full_text(F.col("blocks")), tables, F.floor(F.length("text") / 3000) + 1)
    return docs.select("doc_id", kind.alias("document_type"))


@query("metadata_search_text", f"""{_FULL}
SELECT doc_id, 'Title: ' || title || ' | Author: ' || source || CASE WHEN k <> '' THEN ' | Keywords: ' || replace(k, ' ; ', ', ') ELSE '' END
  || CASE WHEN heads IS NOT NULL THEN ' | Sections: ' || array_to_string(heads, ', ') ELSE '' END AS search_text
FROM (SELECT *, {_KEYWORDS_SQL} AS k FROM (SELECT f.*, d.source, 'About ' || filename AS title FROM full_texts f JOIN documents d USING (doc_id)))""")
def metadata_search_text(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    m = document_metadata(docs, ["doc_id"], F.concat(F.lit("About "), F.col("filename")), author=F.col("source"))
    return m.select("doc_id", "search_text")


@query("bibliography", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || '. ' END || '"' ||
  CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE 'doc' || doc_id END || '"' ||
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '. (2024)' END || '. Accessed: 2025-01-01.' AS entry FROM documents""")
def bibliography(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    return d.select("doc_id", X.bibliography(
        F.when(i % 3 != 0, F.col("source")), F.when(i % 2 == 0, F.concat(F.lit("Title "), i.cast("string"))),
        F.concat(F.lit("doc"), i.cast("string")), F.when(i % 5 != 0, "2024"), F.lit("2025-01-01")).alias("entry"))


@query("visual_highlight", """SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber::BIGINT AS page, l_quantity AS x, l_discount AS y,
  round(l_extendedprice - l_quantity, 6) AS width, round(l_tax + 1 - l_discount, 6) AS height FROM lineitem""")
def visual_highlight(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    box = F.struct(F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"),
                   F.col("l_extendedprice").alias("x1"), (F.col("l_tax") + 1).alias("y1"))
    h = li.withColumn("b", box).select("l_orderkey", "l_linenumber", "l_partkey", X.highlight(F.col("b"), F.col("l_linenumber").cast("bigint")).alias("h"))
    return h.select("l_orderkey", "l_linenumber", "l_partkey", "h.page", "h.highlight.x", "h.highlight.y",
                    F.round("h.highlight.width", 6).alias("width"), F.round("h.highlight.height", 6).alias("height"))
