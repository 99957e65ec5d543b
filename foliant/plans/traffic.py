"""Traffic queries over requests derived from the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import intervals as V
from foliant.operators import rollups as U
from foliant.operators import traffic as T
from foliant.plans.registry import query
from foliant.session import cut_lineage, table
from foliant.sources import logs

REQ_SQL = """req AS (SELECT event_id AS request_id, epoch_us(ts) AS start_us, epoch_us(ts) + round(value * 10000)::BIGINT AS end_us, event_type AS endpoint,
  user_id AS client, 'm' || (user_id % 3) AS model, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  (props->>'$.k')::BIGINT * 100 AS prompt_tokens, (props->>'$.k')::BIGINT * 10 + 1 AS completion_tokens, (props->>'$.k')::BIGINT AS k,
  user_id || ':' || event_type AS fingerprint FROM events)"""


def requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    start = T.micros("ts")
    return e.select(
        F.col("event_id").alias("request_id"), start.alias("start_us"), (start + F.round(F.col("value") * 10000).cast("bigint")).alias("end_us"),
        F.col("event_type").alias("endpoint"), F.col("user_id").alias("client"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (k * 100).alias("prompt_tokens"), (k * 10 + 1).alias("completion_tokens"), k.alias("k"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("fingerprint"))


@query("endpoint_totals", f"WITH {REQ_SQL} SELECT endpoint, count(*) AS total, count(*) FILTER (WHERE status < 400) AS completed, count(*) FILTER (WHERE status >= 400) AS failed FROM req GROUP BY endpoint")
def endpoint_totals(spark, sf_dir):
    return T.endpoint_totals(requests(spark, sf_dir))


_PEAK = """steps AS (SELECT {k} start_us AS t, 1 AS step FROM req UNION ALL SELECT {k} end_us, -1 FROM req),
act AS (SELECT {k} sum(step) OVER ({p} ORDER BY t, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM steps)"""


@query("peak_concurrency", f"WITH {REQ_SQL}, {_PEAK.format(k='', p='')} SELECT max(active)::BIGINT AS peak FROM act")
def peak_concurrency(spark, sf_dir):
    return T.peak_concurrency(requests(spark, sf_dir))


@query("peak_concurrency_by_endpoint", f"WITH {REQ_SQL}, {_PEAK.format(k='endpoint,', p='PARTITION BY endpoint')} SELECT endpoint, max(active)::BIGINT AS peak FROM act GROUP BY endpoint")
def peak_concurrency_by_endpoint(spark, sf_dir):
    return T.peak_concurrency(requests(spark, sf_dir), ["endpoint"])


_AT = 1705276800000000


@query("active_endpoints", f"WITH {REQ_SQL} SELECT endpoint, count(*) AS active, row_number() OVER (ORDER BY count(*) DESC, endpoint) AS position FROM req WHERE start_us - 3600000000 <= {_AT} AND end_us + 3600000000 > {_AT} GROUP BY endpoint")
def active_endpoints(spark, sf_dir):
    hour = 3_600_000_000
    wide = requests(spark, sf_dir).withColumns({"start_us": F.col("start_us") - hour, "end_us": F.col("end_us") + hour})
    busy = T.active_at(wide, _AT)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("active"), "endpoint"))  # a row an endpoint
    return busy.withColumn("position", order.cast("bigint"))


@query("running_means", f"""WITH {REQ_SQL} SELECT request_id, round(sum(k) OVER w / count(*) OVER w, 6) AS avg_wait, round(sum(end_us - start_us) OVER w / count(*) OVER w, 4) AS avg_process,
  round(sum((status < 400)::INT) OVER w / count(*) OVER w * 100, 6) AS success_rate FROM req WINDOW w AS (ORDER BY start_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_means(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("process_us", F.col("end_us") - F.col("start_us"))
    out = T.running_means(r, "k", "process_us", ["start_us", "request_id"])
    return out.select("request_id", F.round("avg_wait", 6).alias("avg_wait"), F.round("avg_process", 4).alias("avg_process"), F.round("success_rate", 6).alias("success_rate"))


@query("recent_batch_mean", f"""WITH {REQ_SQL} SELECT request_id, row_number() OVER (ORDER BY start_us, request_id) AS position,
  round(avg(k) OVER (ORDER BY start_us, request_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 2) AS avg_batch_size FROM req""")
def recent_batch_mean(spark, sf_dir):
    out = T.recent_batch_mean(requests(spark, sf_dir), ["start_us", "request_id"], "k")
    return out.select("request_id", "position", "avg_batch_size")


@query("latency_summary", f"""WITH {REQ_SQL}, d AS (SELECT endpoint, end_us - start_us AS us FROM req),
r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY us) AS rn, count(*) OVER (PARTITION BY endpoint) AS n FROM d)
SELECT endpoint, min(us) AS min, round(avg(us), 4) AS mean, max(us) AS max, max(us) FILTER (WHERE rn = floor(n * 0.5::DOUBLE)) AS p50,
  max(us) FILTER (WHERE rn = floor(n * 0.95::DOUBLE)) AS p95, max(us) FILTER (WHERE rn = floor(n * 0.99::DOUBLE)) AS p99 FROM r GROUP BY endpoint""")
def latency_summary(spark, sf_dir):
    r = requests(spark, sf_dir).select("endpoint", (F.col("end_us") - F.col("start_us")).alias("us"))
    return T.latency_summary(r, ["endpoint"], "us").withColumn("mean", F.round("mean", 4))


_WINDOW_COLS = """count(*) AS requests, round(count(*) / {s}.0::DOUBLE, 8) AS rate, round(100.0::DOUBLE * count(*) FILTER (WHERE status >= 400) / count(*), 6) AS error_rate,
  quantile_disc(end_us - start_us, 0.95) AS p95_us, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens"""


def _rounded(df):
    return df.withColumns({"rate": F.round("rate", 8), "error_rate": F.round("error_rate", 6)})


@query("model_window_metrics", f"WITH {REQ_SQL} SELECT (start_us // 3600000000 * 3600)::BIGINT AS window_sec, model, {_WINDOW_COLS.format(s=3600)} FROM req GROUP BY 1, 2")
def model_window_metrics(spark, sf_dir):
    return _rounded(T.window_metrics(requests(spark, sf_dir), 3600, ["model"]))


@query("sliding_window_metrics", f"""WITH {REQ_SQL}, w AS (SELECT *, unnest([start_us // 60000000 * 60 - i * 60 for i in range(5)]) AS window_sec FROM req)
SELECT window_sec::BIGINT AS window_sec, {_WINDOW_COLS.format(s=300)} FROM w GROUP BY window_sec""")
def sliding_window_metrics(spark, sf_dir):
    return _rounded(T.window_metrics(requests(spark, sf_dir), 300, [], step=60))


@query("slow_or_failed", f"WITH {REQ_SQL} SELECT request_id, (end_us - start_us) / 1000.0::DOUBLE AS ms, status::BIGINT AS status FROM req WHERE end_us - start_us > 1000000 OR status >= 400")
def slow_or_failed(spark, sf_dir):
    return T.slow_or_failed(requests(spark, sf_dir)).select("request_id", T.duration_ms().alias("ms"), F.col("status").cast("bigint"))


@query("traffic_alerts", f"""WITH {REQ_SQL}, w AS (SELECT (start_us // 300000000 * 300)::BIGINT AS window_sec, count(*) FILTER (WHERE endpoint = 'error') / 300.0::DOUBLE AS a,
  avg(end_us - start_us) AS b, count(*) FILTER (WHERE status >= 400) / count(*)::DOUBLE AS c FROM req GROUP BY 1)
SELECT window_sec, 'rejection_rate' AS rule, round(a, 8) AS value FROM w WHERE a > 0.006 UNION ALL SELECT window_sec, 'mean_wait', round(b, 4) FROM w WHERE b > 1500000
UNION ALL SELECT window_sec, 'failed_share', round(c, 8) FROM w WHERE c > 0.1""")
def traffic_alerts(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("wait", F.col("end_us") - F.col("start_us"))
    out = T.alerts(r, "wait", F.col("endpoint") == "error", per_second=0.006, mean_wait=1_500_000)
    value = F.when(F.col("rule") == "mean_wait", F.round("value", 4)).otherwise(F.round("value", 8))
    return out.select("window_sec", "rule", value.alias("value"))


@query("rate_limit_breaches", f"""WITH {REQ_SQL}, c AS (SELECT client, 'minute' AS span, (start_us // 60000000 * 60)::BIGINT AS window_sec, count(*) AS requests FROM req GROUP BY ALL
UNION ALL SELECT client, 'hour', (start_us // 3600000000 * 3600)::BIGINT, count(*) FROM req GROUP BY ALL UNION ALL SELECT client, 'day', (start_us // 86400000000 * 86400)::BIGINT, count(*) FROM req GROUP BY ALL)
SELECT *, CASE span WHEN 'day' THEN 5 ELSE 1 END AS max_requests FROM c WHERE requests > CASE span WHEN 'day' THEN 5 ELSE 1 END""")
def rate_limit_breaches(spark, sf_dir):
    limits = spark.createDataFrame([("minute", 1), ("hour", 1), ("day", 5)], "span string, max_requests int")
    return T.limit_breaches(requests(spark, sf_dir), "client", limits)


@query("model_limit_breaches", f"""WITH {REQ_SQL}, c AS (SELECT model, 'hour' AS span, (start_us // 3600000000 * 3600)::BIGINT AS window_sec, count(*) AS requests FROM req GROUP BY ALL)
SELECT c.*, l.max_requests FROM c JOIN (VALUES ('m0', 5), ('m1', 8), ('m2', 6)) l(model, max_requests) USING (model) WHERE requests > max_requests""")
def model_limit_breaches(spark, sf_dir):
    limits = spark.createDataFrame([("hour", "m0", 5), ("hour", "m1", 8), ("hour", "m2", 6)], "span string, model string, max_requests int")
    return T.limit_breaches(requests(spark, sf_dir), "model", limits)


@query("context_breaches", f"WITH {REQ_SQL} SELECT request_id, model, prompt_tokens FROM req WHERE prompt_tokens > CASE model WHEN 'm0' THEN 8192 WHEN 'm1' THEN 4096 ELSE 32000 END")
def context_breaches(spark, sf_dir):
    windows = spark.createDataFrame([("m0", 8192), ("m1", 4096), ("m2", 32000)], "model string, context_window int")
    return T.over_context(requests(spark, sf_dir), windows).select("request_id", "model", "prompt_tokens")


@query("cost_by_model", f"""WITH {REQ_SQL} SELECT model, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
  round(sum(prompt_tokens) / 1000.0::DOUBLE * p.i + sum(completion_tokens) / 1000.0::DOUBLE * p.o, 6) AS cost FROM req JOIN (VALUES ('m0', 0.5::DOUBLE, 1.5::DOUBLE), ('m1', 0.25::DOUBLE, 0.75::DOUBLE), ('m2', 0.0::DOUBLE, 0.0::DOUBLE)) p(model, i, o) USING (model) GROUP BY model, p.i, p.o""")
def cost_by_model(spark, sf_dir):
    prices = spark.createDataFrame([("m0", 0.5, 1.5), ("m1", 0.25, 0.75), ("m2", 0.0, 0.0)], "model string, input_price double, output_price double")
    return T.cost_by_model(requests(spark, sf_dir), prices).select("model", "prompt_tokens", "completion_tokens", F.round("cost", 6).alias("cost"))


@query("fallback_models", f"WITH {REQ_SQL} SELECT request_id, model, CASE model WHEN 'm0' THEN 'm1' WHEN 'm1' THEN 'm2' END AS fallback_1, CASE model WHEN 'm0' THEN 'm2' END AS fallback_2 FROM req WHERE status >= 400")
def fallback_models(spark, sf_dir):
    pairs = spark.createDataFrame([("m0", "m1"), ("m1", "m2")], "model string, fallback string")
    return T.with_fallbacks(requests(spark, sf_dir), pairs).select("request_id", "model", "fallback_1", "fallback_2")


@query("generation_speed", f"WITH {REQ_SQL} SELECT request_id, CASE WHEN end_us > start_us THEN round(completion_tokens / ((end_us - start_us) * 1000 / 1000000000.0::DOUBLE), 4) END AS tokens_per_second FROM req")
def generation_speed(spark, sf_dir):
    speed = T.tokens_per_second(F.col("completion_tokens"), (F.col("end_us") - F.col("start_us")) * 1000)
    return requests(spark, sf_dir).select("request_id", F.round(speed, 4).alias("tokens_per_second"))


@query("cache_effect", f"""WITH {REQ_SQL}, l AS (SELECT endpoint, start_us - lag(start_us) OVER (PARTITION BY fingerprint ORDER BY start_us, request_id) <= 86400000000 AS hit FROM req)
SELECT endpoint, round(avg(coalesce(hit, FALSE)::INT), 8) AS hit_share FROM l GROUP BY endpoint""")
def cache_effect(spark, sf_dir):
    out = T.cache_effect(requests(spark, sf_dir), 86_400_000_000, ["start_us", "request_id"])
    return out.groupBy("endpoint").agg(F.round(F.avg(F.col("hit").cast("int")), 8).alias("hit_share"))


@query("access_log", """SELECT event_id, event_id % 50 <> 7 AS ok, CASE WHEN event_id % 50 <> 7 THEN '10.0.0.' || user_id % 256 END AS remote_addr, CASE WHEN event_id % 50 <> 7 THEN 'POST' END AS method,
  CASE WHEN event_id % 50 <> 7 THEN '/v1/' || event_type END AS path, CASE WHEN event_id % 50 <> 7 THEN CASE WHEN event_type = 'error' THEN 500 ELSE 200 END END::BIGINT AS status,
  CASE WHEN event_id % 50 <> 7 THEN value END AS request_time, CASE WHEN event_id % 50 <> 7 AND event_id % 4 <> 0 THEN 0.25::DOUBLE END AS response_time,
  CASE WHEN event_id % 50 <> 7 THEN epoch_us(ts) // 1000000 END AS sec FROM events""")
def access_log(spark, sf_dir):
    """Log lines written from every event, with some broken ones, and parsed back."""
    e = table(spark, sf_dir, "events")
    good = F.concat(
        F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "POST /v1/'),
        F.col("event_type"), F.lit(' HTTP/1.1" '), F.when(F.col("event_type") == "error", "500").otherwise("200"), F.lit(' 123 "-" "agent x" "-" rt='),
        F.col("value").cast("string"), F.lit(' uct="0.01" uht="0.02" urt="'), F.when(F.col("event_id") % 4 == 0, "-").otherwise("0.25"), F.lit('"'))
    lines = e.select("event_id", F.when(F.col("event_id") % 50 == 7, F.substring(good, 1, 40)).otherwise(good).alias("value"))
    p = logs.parse_access_lines(lines)
    return p.select("event_id", "ok", "remote_addr", "method", "path", F.col("status").cast("bigint"), "request_time", "response_time",
                    F.unix_timestamp("ts").alias("sec"))


@query("delta_lines", """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 1 THEN role ELSE text END AS text, (conv_id + turn) % 4 = 0 AS done, (CASE WHEN (conv_id + turn) % 4 = 0 THEN turn ELSE 0 END)::BIGINT AS completion_tokens
FROM conversations WHERE (conv_id + turn) % 4 <> 3""")
def delta_lines(spark, sf_dir):
    """Streamed JSON lines made from every turn, with lines that are no JSON object between them."""
    c = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    js = lambda *cols: F.to_json(F.struct(*cols))
    line = (
        F.when(k == 0, js(F.col("text").alias("response"), F.lit(True).alias("done"), F.col("turn").alias("eval_count")))
        .when(k == 1, js(F.struct(F.col("role").alias("content")).alias("message")))
        .when(k == 2, js(F.col("text").alias("response"))).otherwise("[not an object]"))
    lines = c.select("conv_id", "turn", line.alias("value"))
    return logs.parse_delta_lines(lines, keep=("conv_id", "turn")).select("conv_id", "turn", "text", "done", "completion_tokens")


# ---- intervals and budgets: a third of all requests belong to one client -----------------
# A request holds its place a hundred times as long as it runs.
_HOT_SQL = f"{REQ_SQL}, hot AS (SELECT * REPLACE (start_us + (end_us - start_us) * 100 AS end_us), CASE WHEN client % 3 = 0 THEN 0 ELSE client END AS who FROM req)"
_PARTS = {"group_limit": 1000}  # so that the busy client is worked on in parts at every scale


def hot_requests(spark, sf_dir):
    who = F.when(F.col("client") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("client").cast("bigint"))
    return requests(spark, sf_dir).withColumns({"who": who, "end_us": F.col("start_us") + (F.col("end_us") - F.col("start_us")) * 100})


@query("asof_success", f"""WITH {_HOT_SQL}, ok AS (SELECT who, start_us AS at_us, max(request_id) AS last_id, arg_max(endpoint, request_id) AS last_endpoint FROM hot WHERE status < 400 GROUP BY ALL)
SELECT request_id, last_id, last_endpoint FROM (SELECT * FROM hot WHERE status >= 400) f ASOF LEFT JOIN ok ON f.who = ok.who AND f.start_us >= ok.at_us""")
def asof_success(spark, sf_dir):
    """The last request of the client that went well, at or before each failure."""
    r = hot_requests(spark, sf_dir).withColumns({"last_id": F.col("request_id"), "last_endpoint": F.col("endpoint")})
    fails, fine = r.where("status >= 400").drop("last_id", "last_endpoint"), r.where("status < 400")
    return V.asof_join(fails, fine, ["who"], "start_us", "request_id", ["last_id", "last_endpoint"], **_PARTS).select("request_id", "last_id", "last_endpoint")


@query("overlap_counts", f"""WITH {_HOT_SQL} SELECT a.request_id, count(b.request_id) AS overlaps FROM hot a LEFT JOIN hot b
ON a.who = b.who AND a.request_id <> b.request_id AND a.start_us < b.end_us AND b.start_us < a.end_us AND a.end_us > a.start_us AND b.end_us > b.start_us GROUP BY a.request_id""")
def overlap_counts(spark, sf_dir):
    """How many other requests of its client were in progress during each request."""
    return V.overlap_counts(hot_requests(spark, sf_dir), ["who"], "request_id", "start_us", "end_us", **_PARTS)


@query("overlap_pairs", f"""WITH {_HOT_SQL} SELECT a.request_id AS failed_id, b.request_id AS other_id, least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) AS shared_us
FROM hot a JOIN hot b ON a.endpoint <> b.endpoint AND a.model = b.model AND a.start_us < b.end_us AND b.start_us < a.end_us AND a.end_us > a.start_us AND b.end_us > b.start_us WHERE a.status >= 400""")
def overlap_pairs(spark, sf_dir):
    """Requests that were in progress on the same model while one failed."""
    r = hot_requests(spark, sf_dir)
    pairs = V.overlap_join(r.where("status >= 400"), r.where("status < 400"), ["model"], "start_us", "end_us")
    shared = F.least("l.end_us", "r.end_us") - F.greatest("l.start_us", "r.start_us")
    return pairs.select(F.col("l.request_id").alias("failed_id"), F.col("r.request_id").alias("other_id"), shared.alias("shared_us"))


@query("burst_breaches", f"""WITH RECURSIVE {_HOT_SQL}, n AS (SELECT who, request_id, start_us, row_number() OVER (PARTITION BY who ORDER BY start_us, request_id) AS i FROM hot),
walk AS (SELECT who, request_id, start_us, i, 3600000000::BIGINT AS level FROM n WHERE i = 1
  UNION ALL SELECT n.who, n.request_id, n.start_us, n.i, greatest(w.level - 2 * (n.start_us - w.start_us), 0) + 3600000000 FROM walk w JOIN n ON n.who = w.who AND n.i = w.i + 1)
SELECT request_id, who, level FROM walk WHERE level > 3 * 3600000000::BIGINT""")
def burst_breaches(spark, sf_dir):
    """Requests beyond two an hour with room for two more."""
    b = V.burst_breaches(hot_requests(spark, sf_dir), "who", "start_us", "request_id", 2, 3_600_000_000, 2, **_PARTS)
    return b.select("request_id", "who", "level")


# ---- many levels at once -------------------------------------------------------------------
_DAY_SQL = "(start_us // 86400000000 * 86400)"


def _daily(spark, sf_dir):
    return requests(spark, sf_dir).withColumn("day_sec", T.bucket(F.col("start_us"), 86400))


@query("traffic_cube", f"""WITH {REQ_SQL} SELECT endpoint, model, {_DAY_SQL} AS day_sec, GROUPING(endpoint, model, {_DAY_SQL})::BIGINT AS grouping_id, count(*) AS requests,
sum(completion_tokens)::BIGINT AS tokens, count(*) FILTER (WHERE status >= 400) AS failed FROM req GROUP BY CUBE (endpoint, model, {_DAY_SQL})""")
def traffic_cube(spark, sf_dir):
    """Totals by endpoint, model and day, and over all of each of them."""
    sums = {"requests": F.lit(1), "tokens": F.col("completion_tokens"), "failed": F.when(T.failed(), 1).otherwise(0)}
    out = U.grouped_totals(_daily(spark, sf_dir), ["endpoint", "model", "day_sec"], sums)
    return out.withColumns({c: F.col(c).cast("bigint") for c in sums})


_SETS_SQL = "GROUPING SETS ((endpoint, model), (client), ())"


@query("traffic_levels", f"""WITH {REQ_SQL} SELECT endpoint, model, client, GROUPING(endpoint, model, client)::BIGINT AS grouping_id, count(*) AS requests FROM req GROUP BY {_SETS_SQL}""")
def traffic_levels(spark, sf_dir):
    """Totals by endpoint and model, by client, and of all, in one pass over the requests."""
    sets = [["endpoint", "model"], ["client"], []]
    return U.grouped_totals(requests(spark, sf_dir), ["endpoint", "model", "client"], {"requests": F.lit(1)}, sets)


@query("latency_sketches", f"""WITH {REQ_SQL} SELECT endpoint, {_DAY_SQL} AS day_sec, count(*) AS n, true AS p50_within, true AS p95_within, true AS p99_within FROM req GROUP BY ALL""")
def latency_sketches(spark, sf_dir):
    """Days from the stored sketches of their minutes: is the rank of each quantile within the stated bound of its share?

    The requests are read once more only to measure that rank.
    """
    r = _daily(spark, sf_dir).withColumn("ms", T.duration_ms())
    minutes = cut_lineage(U.value_sketches(r, ["endpoint"], "start_us", "ms", 60))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    days = U.with_quantiles(U.merged_sketches(minutes, ["endpoint"], 86400), shares).drop("sketch").withColumnRenamed("window_sec", "day_sec")
    met = r.select("endpoint", "day_sec", "ms").join(F.broadcast(days), ["endpoint", "day_sec"])  # days by endpoints: few rows
    ranks = met.groupBy("endpoint", "day_sec", "n").agg(*[f(F.col("ms"), F.col(q)).alias(f"{q}_{k}") for q in shares for k, f in (
        ("below", lambda x, v: F.count_if(x < v)), ("upto", lambda x, v: F.count_if(x <= v)))])

    def within(q, share):
        slack = F.col("n") * U.RANK_ERROR + 1
        return ((F.col(f"{q}_below") <= F.col("n") * share + slack) & (F.col(f"{q}_upto") >= F.col("n") * share - slack)).alias(f"{q}_within")

    return ranks.select("endpoint", "day_sec", "n", *[within(q, s) for q, s in shares.items()])
