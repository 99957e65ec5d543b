"""Streamed-response and streaming queries, and queries over web pages and files."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from foliant.functions import messages as M
from foliant.operators import blocks as B
from foliant.operators import chunks as C
from foliant.operators import responses as R
from foliant.operators import traffic as T
from foliant.plans.collection import tree_entries
from foliant.plans.documents import _CHUNK_COLS_SQL
from foliant.plans.registry import ORACLES, query
from foliant.plans.safety import _EVENTS_SQL, _TURNS_SQL, mark_turns, marked_turns
from foliant.plans.shared import text_documents
from foliant.session import shared_folder, spread, table
from foliant.sources import files as S
from foliant.sources import html as H
from foliant.sources import line_log, logs, sinks
from foliant.streaming import guard, ordered_guard, rates, run

RULES = ["dangerous", "as an ai", "stupid", "ignore all previous"]
_UNSAFE = "|".join(RULES)

# Assistant turns cut into deltas of twenty characters; some end with an upstream error.
_DELTAS_SQL = f"""{_TURNS_SQL}, cutup AS (SELECT conv_id * 100 + turn AS response_id, unnest(range(((length(text) + 19) // 20)::BIGINT)) AS seq, text, conv_id FROM turns WHERE role = 'assistant'),
deltas AS (SELECT response_id, seq, substr(text, (seq * 20 + 1)::BIGINT, 20) AS text, seq = (length(text) + 19) // 20 - 1 AS done,
  CASE WHEN response_id % 11 = 0 AND seq = 6 THEN 'upstream' END AS error FROM cutup)"""


def deltas(turns):
    t = F.col("text")
    n = F.ceil(F.length(t) / 20)
    rows = turns.where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("response_id"), t, n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("seq"))
    return rows.select(
        "response_id", "seq", F.substring(t, (F.col("seq") * 20 + 1).cast("int"), F.lit(20)).alias("text"), (F.col("seq") == F.col("n") - 1).alias("done"),
        F.when((F.col("response_id") % 11 == 0) & (F.col("seq") == 6), "upstream").alias("error"))


def _guard_sql(full: str) -> str:
    return f"""WITH RECURSIVE {_DELTAS_SQL}, live AS (SELECT * FROM deltas WHERE NOT (response_id % 11 = 0 AND seq >= 6)),
walk AS (SELECT response_id, seq, text AS buf, text AS held, {full.format(x='length(text)')} AS shut FROM live WHERE seq = 0
  UNION ALL
  SELECT d.response_id, d.seq, CASE WHEN w.shut THEN d.text ELSE w.buf || d.text END, '', {full.format(x="length(CASE WHEN w.shut THEN d.text ELSE w.buf || d.text END)")}
  FROM walk w JOIN live d ON d.response_id = w.response_id AND d.seq = w.seq + 1),
lastseq AS (SELECT response_id, max(seq) AS last, max(seq) FILTER (WHERE shut) AS last_shut FROM walk GROUP BY response_id),
hits AS (SELECT w.response_id, min(w.seq) AS pos, arg_min(w.shut, w.seq) AS by_full FROM walk w JOIN lastseq l USING (response_id)
  WHERE regexp_matches(lower(w.buf), '{_UNSAFE}') AND (w.shut OR (w.seq = l.last AND w.response_id NOT IN (SELECT response_id FROM deltas WHERE error IS NOT NULL))) GROUP BY w.response_id)
SELECT d.response_id, d.seq, 'delta' AS kind, d.text FROM live d LEFT JOIN hits h USING (response_id) WHERE h.pos IS NULL OR NOT h.by_full OR d.seq < h.pos
UNION ALL SELECT response_id, pos, 'blocked', NULL FROM hits
UNION ALL SELECT response_id, seq, 'error', NULL FROM deltas WHERE error IS NOT NULL AND response_id NOT IN (SELECT response_id FROM hits)"""


def unsafe_text():
    return F.lower("text").rlike(_UNSAFE)


@query("guarded_responses", _guard_sql("{x} > 50"))
def guarded_responses(spark, sf_dir):
    return R.guard_deltas(deltas(marked_turns(spark, sf_dir)), unsafe_text())


@query("guarded_responses_inclusive", _guard_sql("{x} >= 60"))
def guarded_responses_inclusive(spark, sf_dir):
    return R.guard_deltas(deltas(marked_turns(spark, sf_dir)), unsafe_text(), limit=60, inclusive=True)


@query("guarded_stream", _guard_sql("{x} > 50"))
def guarded_stream(spark, sf_dir):
    """The same guard as a stateful stream over the conversations table."""
    src = run.read_table_stream(spark, sf_dir, "conversations")
    out = run.drain(guard.guard_stream(deltas(mark_turns(src)), RULES, idle_ms=None))
    return out.select(F.col("response_id").cast("bigint"), "seq", "kind", "text")


@query("guarded_any_order", _guard_sql("{x} > 50"))
def guarded_any_order(spark, sf_dir):
    """The same guard on keyed state, from deltas that arrive shuffled over five batches."""
    rows = deltas(marked_turns(spark, sf_dir))
    lot = F.pmod(F.xxhash64("response_id", "seq"), F.lit(5))
    out = run.drain_slices([rows.where(lot == i) for i in range(5)], lambda s: ordered_guard.guard_any_order(s, RULES, idle_ms=None))
    return out.select(F.col("response_id").cast("bigint"), "seq", "kind", "text")


@query("assembled_responses", f"""WITH {_DELTAS_SQL} SELECT response_id, string_agg(text, '' ORDER BY seq) AS text, sum(CASE WHEN done THEN length(text) ELSE 0 END)::BIGINT AS prompt_tokens,
  count(*) AS completion_tokens, sum(CASE WHEN done THEN length(text) ELSE 0 END)::BIGINT + count(*) AS total_tokens FROM deltas GROUP BY response_id""")
def assembled_responses(spark, sf_dir):
    d = deltas(marked_turns(spark, sf_dir))
    d = d.withColumn("prompt_tokens", F.when(F.col("done"), F.length("text").cast("bigint"))).withColumn("completion_tokens", F.lit(1).cast("bigint"))
    return R.assemble(d)


@query("rewritten_event_stream", f"WITH {_EVENTS_SQL} SELECT event_id, event_id % 7 IN (0, 1, 2, 3, 6) AS blocked FROM ev")
def rewritten_event_stream(spark, sf_dir):
    """Block notices put into a stream of events."""
    e = run.read_table_stream(spark, sf_dir, "events").select("event_id", "event_type")
    k, t = F.col("event_id") % 7, F.col("event_type")
    payload = (
        F.when(k == 0, '{"status": 451, "error": "Request timed out"}').when(k == 1, '{"status_code": 451}')
        .when(k == 2, "HTTP 451 Unavailable For Legal Reasons").when(k == 3, '{"error_type": "content_policy_violation"}')
        .when(k == 4, '{"status": 200, "k": 451}').when(k == 5, F.concat(F.lit("all fine 451 "), t)).otherwise('{"status": 451}'))
    return run.drain(M.rewrite_events(e.select("event_id", payload.alias("p")), "p").select("event_id", "blocked"))


# Events arrive in slices of six days. Some events of the first days come with the last slice,
# long after their windows have closed.
_SLICES = ["2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25", "2100-01-01"]
_LATE_SQL = "(event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-07')"


def _event_rows(e):
    # an instant that does not depend on the session's time zone
    return e.select("event_id", F.timestamp_micros(T.micros("ts")).alias("ts"), "user_id", "event_type",
                    F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


def _event_stream(spark, sf_dir):
    return _event_rows(run.read_table_stream(spark, sf_dir, "events"))


def _sliced_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    late = F.expr("event_id % 97 = 0 AND ts < TIMESTAMP_NTZ '2024-01-07 00:00:00'")
    slices, start = [], "1900-01-01"
    for end in _SLICES:
        own = e.where(F.expr(f"ts >= TIMESTAMP_NTZ '{start} 00:00:00' AND ts < TIMESTAMP_NTZ '{end} 00:00:00'")).where(~late)
        slices.append(_event_rows(own if end != _SLICES[-1] else own.unionByName(e.where(late))))
        start = end
    return slices


def _rate_rows(df):
    return df.select(F.unix_timestamp("window_start").alias("window_sec"), "event_type", "requests", "failed")


_CLOSED_SQL = "(SELECT epoch_ms(max(ts)) - 600000 FROM events)"


@query("rate_stream", f"""SELECT (epoch_us(ts) // 60000000 * 60)::BIGINT AS window_sec, event_type, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed
FROM events WHERE NOT {_LATE_SQL} GROUP BY 1, 2 HAVING window_sec * 1000 + 60000 <= {_CLOSED_SQL}""")
def rate_stream(spark, sf_dir):
    """Rates of closed windows, over several batches, without the rows that came too late."""
    return _rate_rows(run.drain_slices(
        _sliced_events(spark, sf_dir), lambda s: rates.windowed_rates(s, "ts", ["event_type"], "1 minute", late="10 minutes")))


@query("sliding_rate_stream", f"""WITH w AS (SELECT event_type, unnest([epoch_us(ts) // 60000000 * 60 - i * 60 for i in range(5)]) AS window_sec FROM events WHERE NOT {_LATE_SQL})
SELECT window_sec::BIGINT AS window_sec, event_type, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed FROM w GROUP BY 1, 2
HAVING window_sec * 1000 + 300000 <= {_CLOSED_SQL}""")
def sliding_rate_stream(spark, sf_dir):
    return _rate_rows(run.drain_slices(
        _sliced_events(spark, sf_dir), lambda s: rates.windowed_rates(s, "ts", ["event_type"], "5 minutes", "1 minute", late="10 minutes")))


_SESSIONS_SQL = f"""marked AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {{gap}} AS fresh FROM {{rows}}),
numbered AS (SELECT *, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked),
sessions AS (SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + {{gap}} AS end_us, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed
  FROM numbered GROUP BY user_id, session)"""
_THREE_HOURS = 3 * 3600 * 1000000


def _session_rows(df):
    return df.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "requests", "failed")


@query("client_sessions", f"WITH {_SESSIONS_SQL.format(gap=_THREE_HOURS - 1, rows='events')} SELECT user_id, start_us, end_us + 1 AS end_us, requests, failed FROM sessions")
def client_sessions(spark, sf_dir):
    """Runs of requests of one client with less than three hours between them."""
    return _session_rows(rates.sessions(_event_rows(table(spark, sf_dir, "events")), "ts", ["user_id"], "3 hours"))


@query("session_stream", f"""WITH kept AS (SELECT * FROM events WHERE NOT {_LATE_SQL}), {_SESSIONS_SQL.format(gap=_THREE_HOURS - 1, rows='kept')}
SELECT user_id, start_us, end_us + 1 AS end_us, requests, failed FROM sessions WHERE (end_us + 1) // 1000 <= {_CLOSED_SQL}""")
def session_stream(spark, sf_dir):
    """The closed sessions of a stream: they grow and merge over batches, and rows that come too late are dropped."""
    return _session_rows(run.drain_slices(_sliced_events(spark, sf_dir), lambda s: rates.sessions(s, "ts", ["user_id"], "3 hours", late="10 minutes")))


@query("dedup_stream", "SELECT user_id, event_type, count(DISTINCT user_id) AS kept FROM events GROUP BY 1, 2")
def dedup_stream(spark, sf_dir):
    """First request of each client and kind, within a time longer than the table."""
    s = rates.drop_repeats(_event_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "40 days")
    return run.drain(s).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("kept"))


# ---- web pages and files --------------------------------------------------------

_HTML_SQL = "html"
for _p in H.DROP:
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_p}', ' ', 'g')"
_HTML_SQL = f"regexp_replace(regexp_replace({_HTML_SQL}, '{H.LINE_TAGS}', chr(10), 'g'), '{H.OTHER_TAGS}', '', 'g')"
for _n, _c in H.NAMED.items():
    _c = _c.replace("'", "''")
    _HTML_SQL = f"replace({_HTML_SQL}, '{_n}', '{_c}')"
_PAGE_LINES_SQL = f"""pl AS (SELECT page_id, unnest(string_split({_HTML_SQL}, chr(10))) AS raw, unnest(range(len(string_split({_HTML_SQL}, chr(10))))) AS i FROM pages),
pk AS (SELECT page_id, trim(raw, ' ') AS content, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block_idx FROM pl WHERE trim(raw, ' ') <> '')"""


@query("page_blocks", f"WITH {_PAGE_LINES_SQL} SELECT page_id, block_idx, content FROM pk")
def page_blocks(spark, sf_dir):
    p = H.page_blocks(spread(table(spark, sf_dir, "pages")))
    return B.explode_blocks(p, "page_id").select("page_id", F.col("block_idx").cast("bigint"), "content")


@query("page_references", "SELECT page_id, 'page ' || page_id || ': é’😀… © <b> &amp; Ω\u00a0€ &nosuchname; &' AS text FROM pages")
def page_references(spark, sf_dir):
    """Character references by name and number, in a line about each page."""
    line = F.concat(F.lit("<p>page "), F.col("page_id").cast("string"), F.lit(": &eacute;&#8217;&#x1F600;&hellip; &copy; &lt;b&gt; &amp;amp; &Omega;&#160;&#128; &nosuchname; &</p>"))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(H.html_text(line), F.lit("\n")).alias("text"))


@query("page_chunks", f"""WITH RECURSIVE {_PAGE_LINES_SQL}, walk AS (SELECT page_id, block_idx, length(content) AS size, 0 AS chunk_no FROM pk WHERE block_idx = 0
  UNION ALL SELECT k.page_id, k.block_idx, CASE WHEN w.size + length(k.content) > 500 THEN length(k.content) ELSE w.size + length(k.content) END,
    CASE WHEN w.size + length(k.content) > 500 THEN w.chunk_no + 1 ELSE w.chunk_no END FROM walk w JOIN pk k ON k.page_id = w.page_id AND k.block_idx = w.block_idx + 1)
SELECT page_id, chunk_no::BIGINT AS chunk_no, string_agg(content, chr(10) || chr(10) ORDER BY block_idx) AS content FROM walk JOIN pk USING (page_id, block_idx) GROUP BY page_id, chunk_no""")
def page_chunks(spark, sf_dir):
    p = H.page_blocks(spread(table(spark, sf_dir, "pages"))).withColumns({"source_path": F.col("url"), "filename": F.col("url")})
    return C.chunk_documents(p, ["page_id"], "paragraph", 500).select("page_id", F.col("chunk_no").cast("bigint"), "content")


@query("media_types", """SELECT p_partkey, CASE WHEN w > h * 1.5 THEN 'chart' WHEN w > 200 AND h > 200 THEN 'figure' ELSE 'image' END AS kind
FROM (SELECT p_partkey, p_partkey % 701 AS w, p_partkey % 397 AS h FROM part) WHERE w >= 100 AND h >= 100""")
def media_types(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, B.media_type(k % 701, k % 397).alias("kind"))
    return p.where("kind IS NOT NULL")


@F.pandas_udf(BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    def one(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            body = "".join(f"<p>{escape(line)}</p>" for line in text.split("\n"))
            z.writestr("word/document.xml", f"<d>{body}</d>")
            z.writestr("docProps/app.xml", "<d>not this</d>")
        return out.getvalue()

    return texts.map(one)


@query("office_text", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') ELSE text END AS text FROM documents")
def office_text(spark, sf_dir):
    """Half of the documents packed as office archives, half as plain files, and read back."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    even = F.col("doc_id") % 2 == 0
    packed = d.withColumn("z", _pack("text"))
    f = packed.select("doc_id", F.when(even, "a.DOCX").otherwise("a.txt").alias("path"),
                      F.when(even, F.col("z")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return f.select("doc_id", S.file_text(F.col("path"), F.col("content")).alias("text"))


@query("file_inventory", """SELECT 'lot=' || (doc_id % 7) AS folder, sum(octet_length(encode(text)) + 1)::BIGINT AS size, '.txt' AS ext
FROM documents GROUP BY 1""")
def file_inventory(spark, sf_dir):
    """The documents written as text files in folders, and the files found there."""
    home = _folder(spark, "inventory")
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("value"), (F.col("doc_id") % 7).alias("lot"))
    d.write.partitionBy("lot").text(home)
    inv = S.file_inventory(spark, home, [".TXT"])
    return inv.groupBy(F.regexp_extract("path", "/(lot=[0-9]+)/", 1).alias("folder"), "ext").agg(F.sum("size").alias("size"))


# ---- sources and sinks through the shared folder -----------------------------------

def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("chunk_sink", ORACLES["chunk_hybrid"].replace(_CHUNK_COLS_SQL, " SELECT doc_id, chunk_no, chunk_id, content FROM chunks"))
def chunk_sink(spark, sf_dir):
    """Chunks written for a loader and read back."""
    home = _folder(spark, "chunks")
    sinks.write_chunks(C.chunk_documents(text_documents(spark, sf_dir), ["doc_id"], "hybrid", 600), home, buckets=8)
    return spark.read.parquet(home).select("doc_id", F.col("chunk_no").cast("bigint"), "chunk_id", "content")


@query("tree_json_sink", ORACLES["tree_json_rows"])
def tree_json_sink(spark, sf_dir):
    home = _folder(spark, "json")
    sinks.write_entries_json(tree_entries(spark, sf_dir), home)
    return spark.read.schema("path string, kind string, size string, summary string").json(home)


@query("tree_markdown_sink", ORACLES["tree_markdown_rows"])
def tree_markdown_sink(spark, sf_dir):
    home = _folder(spark, "markdown")
    sinks.write_markdown(tree_entries(spark, sf_dir), home, "pages", "the pages table")
    lines = spark.read.text(home).withColumnRenamed("value", "line")
    return lines.where("line LIKE '| %' AND line NOT IN ('| Path | Type | Size | Summary |', '| --- | --- | --- | --- |')")


@query("csv_source", """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text,
  'say "' || source || '", twice' AS note FROM documents""")
def csv_source(spark, sf_dir):
    """Every document written as quoted CSV, with line breaks, quotes, commas and empty cells, and read back."""
    home = _folder(spark, "csv")
    d = table(spark, sf_dir, "documents")
    d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"),
             F.concat(F.lit('say "'), F.col("source"), F.lit('", twice')).alias("note")).write.csv(home, header=True, escape='"', quoteAll=True)
    return S.read_csv(spark, home).drop("_record")


@query("access_log_source", "SELECT count(*) AS lines, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT event_type) AS paths FROM events")
def access_log_source(spark, sf_dir):
    home = _folder(spark, "log")
    e = table(spark, sf_dir, "events")
    e.select(F.concat(
        F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "POST /'), F.col("event_type"), F.lit(' HTTP/1.1" '),
        F.when(F.col("event_type") == "error", "500").otherwise("200"), F.lit(' 1 "-" "-" "-" rt=1 uct="1" uht="1" urt="1"'))).write.text(home)
    log = logs.read_access_log(spark, home).where("ok")
    return log.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") >= 400).alias("failed"), F.count_distinct("path").alias("paths"))


_LOG_MINUTES = """SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS hour_sec, event_type AS endpoint, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed
FROM events GROUP BY 1, 2"""


@query("growing_log", _LOG_MINUTES)
def growing_log(spark, sf_dir):
    """An access log that arrives in five pieces, read as a stream that is started anew for each of them."""
    home = _folder(spark, "growing")
    line = F.concat(
        F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "POST /'), F.col("event_type"), F.lit(' HTTP/1.1" '),
        F.col("status").cast("string"), F.lit(' 1 "-" "-" "-" rt=1 uct="1" uht="1" urt="1"'))
    for i, part in enumerate(_sliced_events(spark, sf_dir)):
        part.select(line.alias("value")).write.text(f"{home}/log/piece-{i}")
        lines = line_log.read_lines(spark, f"{home}/log", stream=True, split=1 << 16)
        run.run_once(logs.parse_access_lines(lines), home, "append")
    log = spark.read.parquet(f"{home}/rows").where("ok")
    hour = (F.floor(F.unix_seconds("ts") / 3600) * 3600).cast("bigint").alias("hour_sec")
    return log.groupBy(hour, F.substring("path", 2, 40).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("failed"))


@query("audited_stream", f"WITH {_DELTAS_SQL} SELECT response_id, NOT regexp_matches(lower(string_agg(text, '' ORDER BY seq)), '{_UNSAFE}') AS allowed FROM deltas GROUP BY response_id")
def audited_stream(spark, sf_dir):
    """Deltas passed on unchecked, with the whole answers judged once they are done."""
    home = _folder(spark, "audit")
    src = run.read_table_stream(spark, sf_dir, "conversations")
    job = guard.audit_stream(deltas(mark_turns(src)), f"{home}/raw", f"{home}/audit", f"{home}/open", RULES, f"{home}/checkpoint")
    job.awaitTermination()
    return spark.read.parquet(f"{home}/audit").select("response_id", "allowed")
