"""Sync, sheet and structure-report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators import report as P
from foliant.operators import sheets as H
from foliant.operators import sync as Y
from foliant.operators.ordered import group_sizes, row_numbers
from foliant.plans.registry import query
from foliant.session import cut_lineage, shared_folder, spread, table
from foliant.sources.keyed_table import KeyedTable

# ---- documents as files ------------------------------------------------------
_EXTS = [".docx", ".TXT", ".pdf", ".xlsx", ".md", ".bin", ".html", ".csv", "", ".ppt"]
_FILES_SQL = "files AS (SELECT doc_id, 'in/' || source || '/doc' || doc_id || ([" + ",".join(f"'{e}'" for e in _EXTS) + \
    "])[(doc_id % 10 + 1)::INT] AS path, strlen(text)::BIGINT AS size, doc_id * 1000 AS mtime_ns, text, md5(text) AS hash FROM documents)"
_MAN_SQL = """man AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, mtime_ns, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE hash END AS hash, 'md5' AS algorithm,
  TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) AS cached_at FROM files WHERE doc_id % 3 <> 0)"""


def files(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (i % 10 + 1).cast("int"))
    return d.select(
        i, F.concat(F.lit("in/"), F.col("source"), F.lit("/doc"), i.cast("string"), ext).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"), (i * 1000).alias("mtime_ns"), F.lit("md5").alias("algorithm"),
        F.encode("text", "UTF-8").alias("content"), "text")


def hashed(spark, sf_dir):
    return files(spark, sf_dir).withColumn("hash", Y.content_hash(F.col("content"))).drop("content", "text")


def manifest(spark, sf_dir):
    i = F.col("doc_id")
    h = hashed(spark, sf_dir).where(i % 3 != 0)
    return h.select(
        "path", F.when(i % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ns",
        F.when(i % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"), "algorithm",
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 60 as int))").alias("cached_at"))


def _secs(c):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")


@query("file_kinds", f"""WITH {_FILES_SQL} SELECT path, CASE doc_id % 10 WHEN 0 THEN 'convert' WHEN 1 THEN 'copy' WHEN 2 THEN 'copy' WHEN 3 THEN 'convert' WHEN 4 THEN 'copy'
  WHEN 6 THEN 'convert' WHEN 7 THEN 'copy' WHEN 9 THEN 'convert' ELSE 'ignore' END AS kind, lower(regexp_extract(path, '[.][^./]+$')) AS ext FROM files""")
def file_kinds(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", Y.file_kind(p).alias("kind"), Y.extension(p).alias("ext"))


@query("content_hashes", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN sha256(text) ELSE '' END AS hash FROM documents")
def content_hashes(spark, sf_dir):
    names = F.element_at(F.array(F.lit("md5"), F.lit("SHA1"), F.lit("sha256"), F.lit("crc9")), (F.col("doc_id") % 4 + 1).cast("int"))
    return files(spark, sf_dir).select("doc_id", Y.content_hash(F.col("content"), names).alias("hash"))


@query("hash_reuse", f"""WITH {_FILES_SQL}, {_MAN_SQL} SELECT f.path, coalesce(m.hash, f.hash) AS hash, m.hash IS NOT NULL AS reused
FROM files f LEFT JOIN man m ON m.path = f.path AND m.size = f.size AND m.mtime_ns = f.mtime_ns""")
def hash_reuse(spark, sf_dir):
    return Y.reuse_hashes(files(spark, sf_dir), manifest(spark, sf_dir)).select("path", "hash", "reused")


@query("manifest_upsert", f"""WITH {_FILES_SQL}, {_MAN_SQL}, fresh AS (SELECT path, size, hash, TIMESTAMP '2024-02-01' AS cached_at FROM files WHERE doc_id % 2 = 0),
b AS (SELECT path, size, hash, cached_at FROM man UNION ALL SELECT * FROM fresh)
SELECT path, size, hash, epoch_us(cached_at) // 1000000 AS cached FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY cached_at DESC) AS rn FROM b) WHERE rn = 1""")
def manifest_upsert(spark, sf_dir):
    fresh = hashed(spark, sf_dir).where("doc_id % 2 = 0").withColumn("cached_at", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    return Y.upsert_manifest(manifest(spark, sf_dir), fresh).select("path", "size", "hash", _secs("cached_at").alias("cached"))


@query("manifest_in_place", f"""WITH {_FILES_SQL}, n AS (SELECT path, size, hash, doc_id FROM files)
SELECT path, size, CASE WHEN doc_id % 50 = 7 THEN 'changed' ELSE hash END AS hash, CASE WHEN doc_id % 50 = 7 THEN 3 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS version
FROM n WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 50 = 7""")
def manifest_in_place(spark, sf_dir):
    """A manifest by path in a stored table: a first load, more files, and some changes, one of them sent twice and one out of date."""
    rows = cut_lineage(hashed(spark, sf_dir).select("doc_id", "path", "size", "hash"))
    held = KeyedTable.create(spark, f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}", StructType.fromDDL("path string, size bigint, hash string, version int"), ["path"])
    version = lambda df, v: df.withColumn("version", F.lit(v))
    held.upsert(version(rows.where("doc_id % 2 = 0"), 1), ["version"], "first")
    held.upsert(version(rows.where("doc_id % 3 = 0 AND doc_id % 2 <> 0"), 2), ["version"], "more")
    changes = version(rows.where("doc_id % 50 = 7").withColumn("hash", F.lit("changed")), 3)
    for batch in ("changes", "changes"):
        held.upsert(changes, ["version"], batch)
    held.upsert(version(rows.where("doc_id % 50 = 7"), 0), ["version"], "late")
    return held.read()


@query("manifest_expiry", f"WITH {_FILES_SQL}, {_MAN_SQL} SELECT path, epoch_us(cached_at) // 1000000 AS cached FROM man WHERE cached_at >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY")
def manifest_expiry(spark, sf_dir):
    kept = Y.expire(manifest(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-02-20 00:00:00'"))
    return kept.select("path", _secs("cached_at").alias("cached"))


@query("manifest_stats", f"WITH {_FILES_SQL}, {_MAN_SQL} SELECT count(*) AS entries, epoch_us(min(cached_at)) // 1000000 AS oldest, epoch_us(max(cached_at)) // 1000000 AS newest FROM man")
def manifest_stats(spark, sf_dir):
    return Y.manifest_stats(manifest(spark, sf_dir)).select("entries", _secs("oldest").alias("oldest"), _secs("newest").alias("newest"))


@query("same_content", f"WITH {_FILES_SQL}, {_MAN_SQL} SELECT f.path, coalesce(m.size = f.size AND m.hash = f.hash, FALSE) AS identical FROM files f LEFT JOIN man m USING (path)")
def same_content(spark, sf_dir):
    return Y.with_same_content(hashed(spark, sf_dir), manifest(spark, sf_dir)).select("path", "identical")


@query("pending_files", f"""WITH {_FILES_SQL}, {_MAN_SQL}, o AS (SELECT *, CASE WHEN doc_id % 10 IN (0, 3, 6, 9) THEN path || '.pdf' ELSE path END AS out_path FROM files)
SELECT path FROM o WHERE out_path <> path OR NOT EXISTS (SELECT 1 FROM man m WHERE m.path = o.out_path AND m.size = o.size AND m.hash = o.hash)""")
def pending_files(spark, sf_dir):
    h = hashed(spark, sf_dir)
    out = F.when(Y.file_kind(F.col("path")) == "convert", F.concat(F.col("path"), F.lit(".pdf"))).otherwise(F.col("path"))
    return Y.pending(h.withColumn("out_path", out), manifest(spark, sf_dir)).select("path")


@query("output_paths", f"""WITH {_FILES_SQL} SELECT path, 'in/' || 'src' || (regexp_extract(path, 'src([0-9]+)', 1)) || '/doc' || doc_id || CASE doc_id % 10 WHEN 0 THEN '_d' WHEN 1 THEN '_t' WHEN 3 THEN '_x' WHEN 4 THEN '_t' WHEN 9 THEN '_p' ELSE '' END || '.pdf' AS out FROM files""")
def output_paths(spark, sf_dir):
    return files(spark, sf_dir).select("path", Y.output_path(F.col("path")).alias("out"))


@query("size_classes", "SELECT CASE WHEN n_chars * 1000 < 102400 THEN 'small' WHEN n_chars * 1000 > 10485760 THEN 'large' ELSE 'medium' END AS size_class, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def size_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(Y.size_class(F.col("n_chars") * 1000).alias("size_class")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("largest_first", f"WITH {_FILES_SQL} SELECT path, size, row_number() OVER (ORDER BY size DESC, path) AS position FROM files")
def largest_first(spark, sf_dir):
    ranked = row_numbers(files(spark, sf_dir).select("path", "size", (-F.col("size")).alias("_down")), [], ["_down", "path"], "position")
    return Y.largest_first(ranked.drop("_down"))


_ROUTE_SQL = """CASE doc_id % 10 WHEN 0 THEN 'office > layout > word' WHEN 3 THEN 'office > layout > sheet' WHEN 6 THEN 'office > layout' WHEN 7 THEN 'csv' WHEN 9 THEN 'office > layout > slides' END"""


@query("handler_routes", f"WITH {_FILES_SQL} SELECT path, {_ROUTE_SQL} AS handlers FROM files")
def handler_routes(spark, sf_dir):
    return Y.route(files(spark, sf_dir), Y.handler_table(spark)).select("path", F.array_join("handlers", " > ").alias("handlers"))


@query("first_success", f"""WITH {_FILES_SQL}, a AS (SELECT path, doc_id, unnest(string_split({_ROUTE_SQL}, ' > ')) AS handler, unnest(range(len(string_split({_ROUTE_SQL}, ' > ')))) AS priority FROM files)
SELECT path, arg_min(handler, priority) FILTER (WHERE (doc_id // 10 + priority) % 3 = 0) AS handler FROM a GROUP BY path""")
def first_success(spark, sf_dir):
    r = Y.route(files(spark, sf_dir).select("path", "doc_id"), Y.handler_table(spark))
    tries = r.select("path", "doc_id", F.posexplode_outer("handlers").alias("priority", "handler")).where("handler IS NOT NULL")
    return Y.first_success(tries.withColumn("success", F.expr("(doc_id div 10 + priority) % 3 = 0")))


@query("run_summary", f"""WITH {_FILES_SQL}, o AS (SELECT *, CASE WHEN doc_id % 10 IN (0, 3, 6, 9) THEN 'convert' ELSE 'copy' END AS op, doc_id % 13 <> 0 AS ok FROM files WHERE doc_id % 10 NOT IN (5, 8))
SELECT count(*) AS total, count(*) FILTER (WHERE ok AND op = 'convert') AS converted, count(*) FILTER (WHERE ok AND op = 'copy') AS copied, count(*) FILTER (WHERE NOT ok) AS failed FROM o""")
def run_summary(spark, sf_dir):
    return Y.run_summary(_outcomes(spark, sf_dir))


def _outcomes(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "doc_id", Y.file_kind(F.col("path")).alias("op"))
    return f.where("op <> 'ignore'").withColumn("success", F.col("doc_id") % 13 != 0)


@query("failed_files", f"WITH {_FILES_SQL} SELECT path, CASE WHEN doc_id % 10 IN (0, 3, 6, 9) THEN 'convert' ELSE 'copy' END AS op FROM files WHERE doc_id % 10 NOT IN (5, 8) AND doc_id % 13 = 0")
def failed_files(spark, sf_dir):
    return Y.failed_files(_outcomes(spark, sf_dir))


# ---- order lines as sheets ------------------------------------------------------
_ROWS_SQL = """rows AS (SELECT 'book' AS doc, 'S' || l_suppkey AS sheet,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS row,
  CASE WHEN l_linenumber = 7 THEN ['', ' ', ''] ELSE [l_orderkey::VARCHAR, CASE WHEN l_quantity < 5 THEN '' WHEN l_quantity = 50 THEN 'x <<<PAGE_BREAK>>>' ELSE l_partkey::VARCHAR END, l_returnflag] END AS cells
  FROM lineitem)"""
_CELLS_SQL = f"{_ROWS_SQL}, cells AS (SELECT doc, sheet, row, i AS col, cells[i + 1] AS value FROM rows, range(3) t(i) WHERE trim(cells[i + 1]) <> '')"


def sheet_rows(spark, sf_dir):
    return counted_sheet_rows(spark, sf_dir)[0]


def counted_sheet_rows(spark, sf_dir):
    """The rows of all sheets, whole sheets in a partition, and their ``group_sizes``."""
    li = table(spark, sf_dir, "lineitem").withColumn("sheet", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    sizes = group_sizes(li, ["sheet"])
    numbered = row_numbers(li.select("sheet", "l_returnflag", *order), ["sheet"], order, "n", known_largest=sizes[0], known_rows=sizes[1])
    q = F.col("l_quantity")
    second = F.when(q < 5, "").when(q == 50, "x <<<PAGE_BREAK>>>").otherwise(F.col("l_partkey").cast("string"))
    cells = F.when(F.col("l_linenumber") == 7, F.array(F.lit(""), F.lit(" "), F.lit(""))).otherwise(
        F.array(F.col("l_orderkey").cast("string"), second, F.col("l_returnflag")))
    return numbered.select(F.lit("book").alias("doc"), "sheet", (F.col("n") - 1).alias("row"), cells.alias("cells")), sizes


def sheet_cells(spark, sf_dir):
    c = sheet_rows(spark, sf_dir).select("doc", "sheet", "row", F.posexplode_outer("cells").alias("col", "value"))
    return c.where(H.filled(F.col("value")))


def sheet_panes(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k % 3 == 0).select(
        F.lit("book").alias("doc"), F.concat(F.lit("S"), k.cast("string")).alias("sheet"),
        F.concat(F.lit("A"), (k % 4 + 1).cast("string")).alias("pane"))


@query("sheet_detection", f"""WITH {_CELLS_SQL}, b AS (SELECT sheet, min(row) AS f, max(row) AS l FROM cells GROUP BY sheet),
n AS (SELECT sheet, row, f, l, count(*) AS n FROM cells JOIN b USING (sheet) WHERE row <= f + 10 GROUP BY ALL),
t AS (SELECT n.sheet, n.f, n.l, max(n) FILTER (WHERE row = f) AS h FROM n GROUP BY ALL),
g AS (SELECT t.sheet, t.h, t.l - t.f >= 2 AND t.h >= 2 AND (SELECT count(*) FROM n WHERE n.sheet = t.sheet AND n.row > t.f AND n.n >= t.h * 0.5) / least(t.l - t.f, 10)::DOUBLE >= 0.7 AS ok FROM t)
SELECT sheet, ok AS is_table, CASE WHEN ok THEN h ELSE 0 END AS n_columns FROM g""")
def sheet_detection(spark, sf_dir):
    return H.detect_tables(sheet_cells(spark, sf_dir)).select("sheet", "is_table", F.col("n_columns").cast("bigint"))


@query("sheet_page_breaks", f"""WITH RECURSIVE {_ROWS_SQL}, r AS (SELECT sheet, row, array_to_string(cells, '|') LIKE '%<<<PAGE_BREAK>>>%' AS mark, trim(array_to_string(cells, '')) = '' AS blank FROM rows),
walk AS (SELECT sheet, row, 0 AS segment, 0 AS page, 0 AS blanks, 0 AS data FROM r WHERE row = 0
  UNION ALL
  SELECT sheet, row, segment, page, blanks, CASE WHEN is_data THEN data + 1 ELSE data END FROM (
    SELECT n.sheet, n.row, CASE WHEN n.mark OR (n.blank AND w.blanks + 1 = 1) THEN w.segment + 1 ELSE w.segment END AS segment,
      CASE WHEN n.mark OR (n.blank AND w.blanks + 1 = 1) THEN 0 WHEN w.data >= 15 THEN w.page + 1 ELSE w.page END AS page,
      CASE WHEN n.mark OR NOT n.blank THEN 0 ELSE w.blanks + 1 END AS blanks,
      CASE WHEN n.mark OR (n.blank AND w.blanks + 1 = 1) OR w.data >= 15 THEN 0 ELSE w.data END AS data,
      NOT n.mark AND NOT n.blank AS is_data
    FROM walk w JOIN r n ON n.sheet = w.sheet AND n.row = w.row + 1))
SELECT sheet, row, segment::BIGINT AS segment, page::BIGINT AS page FROM walk""")
def sheet_page_breaks(spark, sf_dir):
    return H.page_segments(sheet_rows(spark, sf_dir)).select("sheet", "row", "segment", "page")


# Every fourth sheet keeps its first column only and is no table; every third has frozen rows.
_MIXED_SQL = _ROWS_SQL.replace("rows AS (", "whole AS (", 1) + """, rows AS (SELECT doc, sheet, row, CASE WHEN substr(sheet, 2)::BIGINT % 4 = 1 THEN cells[1:1] ELSE cells END AS cells FROM whole),
cells AS (SELECT sheet, row, count(*) AS n FROM (SELECT sheet, row, unnest(cells) AS v FROM rows) WHERE trim(v) <> '' GROUP BY ALL),
b AS (SELECT sheet, min(row) AS f, max(row) AS l FROM cells GROUP BY sheet),
t AS (SELECT sheet, f, l, max(n) FILTER (WHERE row = f) AS h, list(n) FILTER (WHERE row > f AND row <= f + 10) AS ns FROM cells JOIN b USING (sheet) GROUP BY ALL),
flags AS (SELECT sheet, l - f >= 2 AND h >= 2 AND len(list_filter(ns, lambda x: x >= h * 0.5)) / least(l - f, 10)::DOUBLE >= 0.7 AS tab,
  CASE WHEN substr(sheet, 2)::BIGINT % 3 = 0 THEN greatest(substr(sheet, 2)::BIGINT % 4, 1) ELSE 1 END AS heads FROM t)"""


@query("sheet_detected_pages", f"""WITH RECURSIVE {_MIXED_SQL}, r AS (SELECT sheet, row, tab, heads, array_to_string(cells, '|') LIKE '%<<<PAGE_BREAK>>>%' AS mark, trim(array_to_string(cells, '')) = '' AS blank FROM rows JOIN flags USING (sheet)),
walk AS (SELECT sheet, row, 0 AS segment, 0 AS page, 0 AS blanks, 0 AS data FROM r WHERE row = 0
  UNION ALL
  SELECT sheet, row, segment, page, blanks, CASE WHEN is_data THEN data + 1 ELSE data END FROM (
    SELECT n.sheet, n.row, CASE WHEN n.mark OR (n.blank AND w.blanks + 1 = 1) THEN w.segment + 1 ELSE w.segment END AS segment,
      CASE WHEN n.mark OR (n.blank AND w.blanks + 1 = 1) THEN 0 WHEN w.data >= 15 THEN w.page + 1 ELSE w.page END AS page,
      CASE WHEN n.mark OR NOT n.blank THEN 0 ELSE w.blanks + 1 END AS blanks,
      CASE WHEN n.mark OR (n.blank AND w.blanks + 1 = 1) OR w.data >= 15 THEN 0 ELSE w.data END AS data,
      NOT n.mark AND NOT n.blank AND n.tab AND n.row >= n.heads AS is_data
    FROM walk w JOIN r n ON n.sheet = w.sheet AND n.row = w.row + 1))
SELECT sheet, row, segment::BIGINT AS segment, page::BIGINT AS page FROM walk""")
def sheet_detected_pages(spark, sf_dir):
    """Page breaks of sheets that are tables or not, with headers as their frozen panes say."""
    number = F.substring("sheet", 2, 20).cast("bigint")
    rows, sizes = counted_sheet_rows(spark, sf_dir)
    rows = rows.withColumn("cells", F.when(number % 4 == 1, F.slice("cells", 1, 1)).otherwise(F.col("cells")))
    return H.detected_segments(rows, sheet_panes(spark, sf_dir), sizes=sizes).select("sheet", "row", "segment", "page")


@query("sheet_pagination", f"""WITH {_ROWS_SQL}, c AS (SELECT sheet, count(*) AS n FROM rows GROUP BY sheet), h AS (SELECT sheet, array_to_string(cells, '|') AS header FROM rows WHERE row = 0)
SELECT sheet, row, (row - 1) // 15 + 1 AS page, 'Table page ' || ((row - 1) // 15 + 1) || ' of ' || ((n - 1 + 14) // 15) || ' (Sheet: ' || sheet || ')' AS label,
  'book | Sheet: ' || sheet || ' | 2025-01-01' AS source_line, header FROM rows JOIN c USING (sheet) JOIN h USING (sheet) WHERE row >= 1""")
def sheet_pagination(spark, sf_dir):
    p = H.paginate(sheet_rows(spark, sf_dir), source_date="2025-01-01")
    return p.select("sheet", "row", F.col("page").cast("bigint"), "label", "source_line", F.array_join(F.col("headers")[0], "|").alias("header"))


@query("sheet_grid", f"""WITH {_CELLS_SQL}, size AS (SELECT sheet, max(row) AS last, max(col) AS w FROM cells GROUP BY sheet)
SELECT sheet, row, trim(cells[1]) || CASE WHEN w >= 1 THEN '|' || trim(cells[2]) ELSE '' END || CASE WHEN w >= 2 THEN '|' || trim(cells[3]) ELSE '' END AS cells
FROM rows JOIN size USING (sheet) WHERE row <= last""")
def sheet_grid(spark, sf_dir):
    return H.to_grid(sheet_cells(spark, sf_dir)).select("sheet", "row", F.array_join("cells", "|").alias("cells"))


@query("sheet_used_range", f"WITH {_CELLS_SQL} SELECT sheet, min(row) AS first_row, min(col) AS first_col, max(row) AS last_row, max(col) AS last_col FROM cells GROUP BY sheet")
def sheet_used_range(spark, sf_dir):
    u = H.used_range(sheet_cells(spark, sf_dir))
    return u.select("sheet", "first_row", F.col("first_col").cast("bigint"), "last_row", F.col("last_col").cast("bigint"))


@query("sheet_profile", f"""WITH {_CELLS_SQL} SELECT sheet, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, max(row) + 1 > 2 AND max(col) + 1 > 1 AS has_table,
  CASE WHEN substr(sheet, 2)::BIGINT % 3 = 0 THEN substr(sheet, 2)::BIGINT % 4 ELSE 0 END AS frozen FROM cells GROUP BY sheet""")
def sheet_profile(spark, sf_dir):
    p = H.sheet_profile(sheet_cells(spark, sf_dir), sheet_panes(spark, sf_dir))
    return p.select("sheet", "n_rows", F.col("n_cols").cast("bigint"), "has_table", F.col("frozen").cast("bigint"))


@query("wide_documents", "SELECT 'order' || l_orderkey AS doc, count(*) > 6 AS is_wide FROM lineitem GROUP BY l_orderkey")
def wide_documents(spark, sf_dir):
    """Each order as a document whose table has one column per line."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) - 1).alias("col"))
    return H.wide_documents(li.select(F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("doc"), "col"))


# ---- page addresses as a tree ------------------------------------------------------
_TREE_SQL = r"""tree AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS raw, length(html)::BIGINT AS size, html FROM pages),
tfiles AS (SELECT page_id, rtrim(raw, '/') || '/p' || page_id || CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.TXT' WHEN 2 THEN '' ELSE '.md' END AS path, size, html FROM tree)"""


def tree_files(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages"))
    raw = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    i = F.col("page_id")
    ext = F.when(i % 4 == 0, ".html").when(i % 4 == 1, ".TXT").when(i % 4 == 2, "").otherwise(".md")
    return p.select("page_id", F.concat(F.rtrim(raw, F.lit("/")), F.lit("/p"), i.cast("string"), ext).alias("path"),
                    F.length("html").cast("bigint").alias("size"), F.col("html").alias("text"))


@query("path_exclusion", f"WITH {_TREE_SQL} SELECT path FROM tfiles WHERE NOT list_has_any(string_split(path, '/'), ['de', 'spam-farm.example.org', 'p11.md'])")
def path_exclusion(spark, sf_dir):
    f = tree_files(spark, sf_dir)
    return f.where(P.not_excluded(F.col("path"), ["de", "spam-farm.example.org", "p11.md"])).select("path")


_LINKS_SQL = f"""{_TREE_SQL}, parts AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM tfiles),
links AS (SELECT DISTINCT CASE WHEN i = 0 THEN '.' ELSE array_to_string(ps[1:i], '/') END AS parent, ps[i + 1] AS name, i = len(ps) - 1 AS is_file FROM (SELECT ps, unnest(range(len(ps))) AS i FROM parts)),
fold AS (SELECT parent AS path, count(*) FILTER (WHERE is_file) AS f, count(*) FILTER (WHERE NOT is_file) AS d FROM links GROUP BY parent),
said AS (SELECT path, 'Contains ' || array_to_string(list_filter([CASE WHEN f = 1 THEN '1 file' WHEN f > 1 THEN f || ' files' END, CASE WHEN d = 1 THEN '1 subfolder' WHEN d > 1 THEN d || ' subfolders' END], lambda x: x IS NOT NULL), ' and ') AS summary FROM fold)"""


@query("folder_rollup", f"WITH {_LINKS_SQL} SELECT path, summary FROM said")
def folder_rollup(spark, sf_dir):
    return P.folders(tree_files(spark, sf_dir)).select("path", "summary")


_SUM_SQL = """CASE page_id % 4 WHEN 2 THEN 'Summary skipped for extension <no extension>' WHEN 3 THEN 'Summary skipped for extension .md'
  ELSE substr(html, 1, 150) || ' ...' END"""


@query("tree_summaries", f"WITH {_TREE_SQL} SELECT path, CASE WHEN page_id % 4 IN (0, 1) THEN rtrim(substr(html, 1, 150)) || ' ...' ELSE {_SUM_SQL} END AS summary FROM tfiles")
def tree_summaries(spark, sf_dir):
    return P.summarize(tree_files(spark, sf_dir), [".html", ".txt"], max_chars=150).select("path", "summary")


@query("placeholder_summary", """SELECT doc_id, CASE WHEN t = '' THEN '(empty or binary file)' WHEN length(t) <= 250 THEN t ELSE rtrim(substr(t, 1, 250)) || ' ...' END AS summary
FROM (SELECT doc_id, replace(regexp_replace(text, '\\n$', ''), chr(10), ' ') AS t FROM documents)""")
def placeholder_summary(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", P.placeholder_summary(F.col("text")).alias("summary"))


@query("byte_truncation", "SELECT doc_id, substr(text, 1, list_max(list_filter(range(101), lambda i: strlen(substr(text, 1, i)) <= 100))) AS head FROM documents")
def byte_truncation(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", P.truncate_bytes(F.col("text"), 100).alias("head"))


@query("summary_fallback", f"WITH {_TREE_SQL} SELECT path, CASE WHEN page_id % 3 = 0 THEN 'Page at ' || path ELSE rtrim(substr(html, 1, 60)) || ' ...' END AS summary FROM tfiles")
def summary_fallback(spark, sf_dir):
    """A first summarizer that gives nothing for two thirds of the files."""
    first = lambda path, text: F.when(F.regexp_extract(path, r"/p([0-9]+)[^/]*$", 1).cast("int") % 3 == 0, F.concat(F.lit("Page at "), path)).otherwise("")
    return P.summarize(tree_files(spark, sf_dir), [], max_chars=60, primary=first).select("path", "summary")


_ENT_SQL = f"""{_LINKS_SQL}, ent AS (SELECT path, 'folder' AS kind, NULL::BIGINT AS size, summary FROM said UNION ALL SELECT path, 'file', size, 'a | b' || chr(10) || page_id FROM tfiles)"""


def tree_entries(spark, sf_dir):
    f = tree_files(spark, sf_dir).withColumn("summary", F.concat(F.lit("a | b\n"), F.col("page_id").cast("string")))
    return P.entries(f)


@query("tree_json_rows", f"""WITH {_ENT_SQL} SELECT CASE WHEN path = '.' THEN './' ELSE './' || path END AS path, kind, coalesce(size::VARCHAR, '') AS size, replace(summary, chr(10), ' ') AS summary FROM ent""")
def tree_json_rows(spark, sf_dir):
    return P.json_fields(P.walk_order(tree_entries(spark, sf_dir)))


@query("tree_markdown_rows", f"""WITH {_ENT_SQL} SELECT '| ' || CASE WHEN path = '.' THEN './' ELSE './' || path END || ' | ' || kind || ' | ' || coalesce(size::VARCHAR, '') || ' | ' ||
  replace(replace(summary, chr(10), ' '), '|', '\\|') || ' |' AS line FROM ent""")
def tree_markdown_rows(spark, sf_dir):
    return P.markdown_rows(P.walk_order(tree_entries(spark, sf_dir))).select("line")
