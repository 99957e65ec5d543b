"""Metrics and limits over request logs.

A request row has ``request_id, start_us, end_us, endpoint, client, model, status``
and, where used, ``prompt_tokens, completion_tokens``. Times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.joins import small_join
from foliant.operators.ordered import Run, nearest_rank, running, trailing_mean

# Thresholds of the metrics and alerts.
SLOW_MS = 1000
FAILED_FROM = 400
REJECTED_PER_SECOND = 0.01
WAIT_MS = 5000
FAILED_SHARE = 0.10
LIMITS = {"second": 10, "minute": 60, "hour": 1000}
_SPAN_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def bucket(us: Column, seconds: int) -> Column:
    """Start of the tumbling window, in seconds."""
    return (F.floor(us / (seconds * 1_000_000)) * seconds).cast("bigint")


def duration_ms() -> Column:
    return (F.col("end_us") - F.col("start_us")) / 1000


def failed() -> Column:
    return F.col("status") >= FAILED_FROM


def endpoint_totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~failed()).alias("completed"), F.count_if(failed()).alias("failed"))


def _steps(requests: DataFrame, keys: list[str]) -> DataFrame:
    """+1 at each start and -1 at each end, summed per instant; ends come first."""
    ends = F.explode(F.array(
        F.struct(F.col("start_us").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("step"))))
    rows = requests.select(*keys, ends.alias("e")).select(*keys, "e.*")
    return rows.groupBy(*keys, "at", "step").agg(F.sum("step").alias("change"))


def concurrency(requests: DataFrame, keys: list[str] | None = None, **kw) -> DataFrame:
    """Active requests after every change."""
    keys = keys or []
    return running(_steps(requests, keys), keys, ["at", "step"], [Run("active", "sum", F.col("change"))], **kw)


def peak_concurrency(requests: DataFrame, keys: list[str] | None = None, **kw) -> DataFrame:
    keys = keys or []
    return concurrency(requests, keys, **kw).groupBy(*keys).agg(F.max("active").alias("peak"))


def active_at(requests: DataFrame, at_us: int) -> DataFrame:
    """Endpoints that are busy at an instant, busiest first."""
    busy = requests.where((F.col("start_us") <= at_us) & (F.col("end_us") > at_us))
    return busy.groupBy("endpoint").agg(F.count(F.lit(1)).alias("active")).orderBy(F.desc("active"), "endpoint")


def running_means(requests: DataFrame, wait: str, process: str, order: list[str], **kw) -> DataFrame:
    """Mean wait and process time and the success rate over all requests so far."""
    out = running(requests, [], order, [
        Run("_n", "count"), Run("_w", "sum", F.col(wait)), Run("_p", "sum", F.col(process)),
        Run("_ok", "sum", (~failed()).cast("bigint"))], **kw)
    return out.withColumns({
        "avg_wait": F.col("_w") / F.col("_n"), "avg_process": F.col("_p") / F.col("_n"), "success_rate": F.col("_ok") / F.col("_n") * 100,
    }).drop("_n", "_w", "_p", "_ok")


def recent_batch_mean(batches: DataFrame, order: list[str], size: str, n: int = 1000, **kw) -> DataFrame:
    out = trailing_mean(batches, order, size, n, "avg_batch_size", **kw)
    return out.withColumn("avg_batch_size", F.round("avg_batch_size", 2))


def latency_summary(requests: DataFrame, keys: list[str], value: str, **kw) -> DataFrame:
    """min, mean, max and nearest-rank p50, p95, p99 per group."""
    also = {"min": F.min(value), "mean": F.avg(value), "max": F.max(value)}
    return nearest_rank(requests, keys, value, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, also, **kw)


def window_metrics(requests: DataFrame, seconds: int, keys: list[str], step: int | None = None) -> DataFrame:
    """Rate, error rate and tokens per window. ``step`` below ``seconds`` gives sliding windows."""
    rows = requests
    if step is None or step == seconds:
        rows = rows.withColumn("window_sec", bucket(F.col("start_us"), seconds))
    else:
        last = bucket(F.col("start_us"), step)
        starts = F.transform(F.sequence(F.lit(0), F.lit(seconds // step - 1)), lambda i: last - i * step)
        rows = rows.withColumn("window_sec", F.explode(starts))
    also = {
        "requests": F.count(F.lit(1)),
        "rate": F.count(F.lit(1)) / seconds,
        "error_rate": 100 * F.count_if(failed()) / F.count(F.lit(1)),
        "tokens": F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))),
    }
    rows = rows.withColumn("_us", F.col("end_us") - F.col("start_us"))
    return nearest_rank(rows, ["window_sec", *keys], "_us", {"p95_us": 0.95}, also, round_up=True)


def slow_or_failed(requests: DataFrame, slow_ms: int = SLOW_MS) -> DataFrame:
    return requests.where((duration_ms() > slow_ms) | failed())


def alerts(requests: DataFrame, wait_ms: str, rejected: Column, seconds: int = 300, per_second: float = REJECTED_PER_SECOND,
           mean_wait: float = WAIT_MS, share: float = FAILED_SHARE) -> DataFrame:
    """One row per window and rule that is broken."""
    w = requests.groupBy(bucket(F.col("start_us"), seconds).alias("window_sec")).agg(
        (F.count_if(rejected) / seconds).alias("rejection_rate"), F.avg(wait_ms).alias("mean_wait"),
        (F.count_if(failed()) / F.count(F.lit(1))).alias("failed_share"))
    rules = F.array(
        F.struct(F.lit("rejection_rate").alias("rule"), F.col("rejection_rate").alias("value"), F.lit(float(per_second)).alias("threshold")),
        F.struct(F.lit("mean_wait").alias("rule"), F.col("mean_wait").alias("value"), F.lit(float(mean_wait)).alias("threshold")),
        F.struct(F.lit("failed_share").alias("rule"), F.col("failed_share").alias("value"), F.lit(float(share)).alias("threshold")))
    return w.select("window_sec", F.explode(rules).alias("r")).select("window_sec", "r.*").where("value > threshold")


def limit_breaches(requests: DataFrame, key: str, limits: DataFrame) -> DataFrame:
    """Windows in which a key made more requests than its limit.

    ``limits(span, max_requests)`` holds for every key; with a column named ``key``
    it holds for that key only. Requests are counted per window before the join.
    """
    spans = [r[0] for r in limits.select("span").distinct().collect()]  # names of time units, a handful
    unknown = set(spans) - set(_SPAN_US)
    if unknown:
        raise ValueError(f"unknown time spans {sorted(unknown)}")
    starts = F.array(*[
        F.struct(F.lit(s).alias("span"), bucket(F.col("start_us"), _SPAN_US[s] // 1_000_000).alias("window_sec")) for s in spans])
    counts = requests.select(F.col(key), F.explode(starts).alias("w")).groupBy(key, "w.span", "w.window_sec").agg(
        F.count(F.lit(1)).alias("requests"))
    on = ["span", key] if key in limits.columns else ["span"]
    return small_join(counts, limits, on).where("requests > max_requests")


def over_context(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """Requests with more prompt tokens than the window of their model."""
    return small_join(requests, windows, ["model"]).where("prompt_tokens > context_window")


def cost_by_model(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens are summed per model before prices are joined."""
    sums = requests.groupBy("model").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"))
    cost = F.col("prompt_tokens") / 1000 * F.col("input_price") + F.col("completion_tokens") / 1000 * F.col("output_price")
    return sums.join(prices, "model", "left").withColumn("cost", cost)


def with_fallbacks(requests: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """First and second fallback model of failed requests.

    ``fallbacks(model, fallback)``, with a column ``place`` where a model has several: they are
    tried in its order. A model with one fallback goes on with that model's first fallback.
    """
    place = F.col("place") if "place" in fallbacks.columns else F.lit(0)
    lists = fallbacks.groupBy("model").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "fallback"))).alias("_fs"))
    lists = lists.select("model", F.get("_fs", F.lit(0))["fallback"].alias("fallback_1"), F.get("_fs", F.lit(1))["fallback"].alias("_own"))
    chained = lists.select(F.col("model").alias("fallback_1"), F.col("fallback_1").alias("_next"))
    both = lists.join(chained, "fallback_1", "left").select("model", "fallback_1", F.coalesce("_own", "_next").alias("fallback_2"))
    return small_join(requests.where(failed()), both, ["model"], "left")


def tokens_per_second(tokens: Column, duration_ns: Column) -> Column:
    return F.when(duration_ns > 0, tokens / (duration_ns / 1_000_000_000))


def cache_effect(requests: DataFrame, ttl_us: int, order: list[str], **kw) -> DataFrame:
    """Marks requests whose fingerprint was seen at most ``ttl_us`` before."""
    out = running(requests, ["fingerprint"], order, [Run("_seen", "max", F.col("start_us"), True)], **kw)
    return out.withColumn("hit", F.coalesce(F.col("start_us") - F.col("_seen") <= ttl_us, F.lit(False))).drop("_seen")
