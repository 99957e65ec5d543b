"""Access logs and newline-delimited JSON as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.arrays import bind

# The combined log format with request and upstream timings.
ACCESS_LINE = (
    r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" ([0-9]{3}) ([0-9]+|-) "([^"]*)" "([^"]*)" "([^"]*)" '
    r'rt=(\S+) uct="([^"]*)" uht="([^"]*)" urt="([^"]*)"'
)
FIELDS = [
    "remote_addr", "remote_user", "time_local", "request", "status", "body_bytes", "referer", "user_agent",
    "forwarded_for", "request_time", "connect_time", "header_time", "response_time",
]


def parse_access_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Typed columns per log line; ``ok`` is false, and all fields null, for other lines."""
    mark = "\u0001"
    # one match per line writes all groups out, instead of one match per field
    spread = F.regexp_replace(line, ACCESS_LINE + ".*$", mark.join(f"${i}" for i in range(1, len(FIELDS) + 1)))

    def fields(parts: Column) -> Column:
        ok = F.size(parts) == len(FIELDS)
        text = {n: F.when(ok, F.get(parts, F.lit(i))) for i, n in enumerate(FIELDS)}
        number = lambda n, t: text[n].try_cast(t)
        return F.struct(
            ok.alias("ok"),
            text["remote_addr"].alias("remote_addr"),
            F.nullif(text["remote_user"], F.lit("-")).alias("remote_user"),
            F.try_to_timestamp(text["time_local"], F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"),
            F.split_part(text["request"], F.lit(" "), F.lit(1)).alias("method"),
            F.split_part(text["request"], F.lit(" "), F.lit(2)).alias("path"),
            number("status", "int").alias("status"),
            number("body_bytes", "bigint").alias("body_bytes"),
            *[text[n].alias(n) for n in ("referer", "user_agent", "forwarded_for")],
            *[number(n, "double").alias(n) for n in ("request_time", "connect_time", "header_time", "response_time")],
        )

    return lines.withColumn("_f", bind(F.split(spread, mark), fields)).select(*lines.columns, "_f.*")


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_lines(spark.read.text(path))


def delta_fields(line: Column) -> Column:
    """struct<response_id, seq, model, text, done, error, prompt_tokens, completion_tokens>
    of one streamed JSON line; null for blank lines and for lines that are no JSON object."""
    get = lambda path: F.get_json_object(line, path)
    number = lambda path: F.coalesce(get(path).try_cast("bigint"), F.lit(0))
    ok = F.trim(line).startswith("{") & get("$").isNotNull()
    return F.when(ok, F.struct(
        get("$.id").alias("response_id"),
        get("$.seq").try_cast("bigint").alias("seq"),
        get("$.model").alias("model"),
        F.coalesce(get("$.response"), get("$.message.content"), F.lit("")).alias("text"),
        F.coalesce(get("$.done") == "true", F.lit(False)).alias("done"),
        get("$.error").alias("error"),
        number("$.prompt_eval_count").alias("prompt_tokens"),
        number("$.eval_count").alias("completion_tokens"),
    ))


def parse_delta_lines(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Deltas of NDJSON lines; other lines are skipped. Works on batch and stream."""
    rows = lines.select(*keep, delta_fields(F.col(line)).alias("d"))
    return rows.where("d IS NOT NULL").select(*keep, "d.*")


def read_deltas(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_delta_lines(reader.format("text").load(path))
