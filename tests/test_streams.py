"""The stateful stream against its batch form and a plain walk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import responses as R
from foliant.streaming import guard, rates, run

RULES = ["danger", "as an ai"]
SCHEMA = "response_id long, seq long, text string, done boolean, error string"


def make(n=25):
    rnd = random.Random(11)
    rows = []
    for r in range(n):
        words = ["some", "plain", "words", "here "] + (["danger "] if r % 3 == 0 else []) + (["as an", " ai "] if r % 4 == 0 else [])
        steps = 400 if r == 0 else rnd.randint(0, 30)
        for s in range(steps):
            err = "up" if r % 7 == 5 and s == 9 else None
            rows.append((r, s, rnd.choice(words) if rnd.random() < 0.97 else "", s == steps - 1, err))
    return rows


def walk(rows, limit, inclusive):
    out, by = set(), {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    bad = re.compile("|".join(RULES))
    for rid, ds in by.items():
        buf, ended = "", False
        for _, seq, text, done, err in sorted(ds, key=lambda d: d[1]):
            if err:
                out.add((rid, seq, "error", None))
                ended = True
                break
            buf += text
            shut = len(buf) >= limit if inclusive else len(buf) > limit
            if shut and bad.search(buf):
                out.add((rid, seq, "blocked", None))
                ended = True
                break
            out.add((rid, seq, "delta", text))
            if shut:
                buf = ""
        if not ended and buf and bad.search(buf):
            out.add((rid, ds[-1][1], "blocked", None))
    return out


@pytest.mark.parametrize("limit,inclusive,part", [(50, False, 5000), (50, True, 7), (12, False, 3)])
def test_batch_guard_equals_a_walk(spark, limit, inclusive, part):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = R.guard_deltas(df, F.col("text").rlike("|".join(RULES)), limit, inclusive, part=part)
    assert {tuple(r) for r in got.collect()} == walk(rows, limit, inclusive)


def stream_of(spark, tmp_path, rows, schema=SCHEMA, files=3):
    home = str(tmp_path / "in")
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(home)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(home)


def test_stream_guard_equals_batch(spark, tmp_path):
    rows = sorted(make(12), key=lambda r: (r[1], r[0]))  # responses arrive interleaved, over several batches
    got = run.drain(guard.guard_stream(stream_of(spark, tmp_path, rows), RULES, idle_ms=None))
    assert {(int(r.response_id), r.seq, r.kind, r.text) for r in got.collect()} == walk(rows, 50, False)


def test_holding_back_never_shows_unsafe_text(spark, tmp_path):
    rows = sorted(make(12), key=lambda r: (r[1], r[0]))
    df = spark.createDataFrame(rows, SCHEMA)
    batch = R.guard_deltas(df, F.col("text").rlike("|".join(RULES)), hold=True)
    stream = run.drain(guard.guard_stream(stream_of(spark, tmp_path, rows), RULES, hold=True, idle_ms=None))

    def texts(df):
        out = {}
        for r in sorted(df.where("kind = 'delta'").collect(), key=lambda r: r.seq):
            out[int(r.response_id)] = out.get(int(r.response_id), "") + r.text
        return {k: v for k, v in out.items() if v}

    shown = texts(stream)
    blocked = {int(r.response_id) for r in batch.where("kind = 'blocked'").collect()}
    assert blocked == {int(r.response_id) for r in stream.where("kind = 'blocked'").collect()}
    full = texts(batch)
    broken = {r[0] for r in rows if r[4]}
    assert {k: v for k, v in shown.items() if k not in broken} == {k: v for k, v in full.items() if k not in broken}


def test_assembly_in_parts(spark):
    rows = [(1, i, str(i), False, None) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("completion_tokens", F.lit(1))
    for part_rows in (3, 4, 100_000):
        got = R.assemble(df, part_rows=part_rows).collect()
        assert [(r.text, r.total_tokens) for r in got] == [("0123456789", 10)]
    seam = spark.createDataFrame([(7, 2, "dan", False, None), (7, 3, "gerous", True, None)], SCHEMA)
    assert R.assemble(seam, part_rows=3).where("text RLIKE 'dangerous'").count() == 1


def test_audit_never_blocks(spark, tmp_path):
    rows = sorted(make(8), key=lambda r: (r[1], r[0]))
    p = {n: str(tmp_path / n) for n in ("raw", "audit", "open", "cp")}
    guard.audit_stream(stream_of(spark, tmp_path, rows), p["raw"], p["audit"], p["open"], RULES, p["cp"]).awaitTermination()
    assert spark.read.parquet(p["raw"]).count() == len(rows)
    want = {}
    for r in sorted(rows):
        want[r[0]] = want.get(r[0], "") + r[2]
    got = {r.response_id: r.allowed for r in spark.read.parquet(p["audit"]).collect()}
    assert got == {k: not re.search("|".join(RULES), v) for k, v in want.items()}


def test_repeats_within_time(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:06")]
    schema = "fingerprint string, t string"
    s = stream_of(spark, tmp_path, rows, schema, files=1).withColumn("ts", F.to_timestamp("t"))
    assert run.drain(rates.drop_repeats(s, "ts", ["fingerprint"])).count() == 2


def test_a_table_of_several_files_is_read_as_a_stream(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(c, t, "assistant" if t % 2 else "user", f"words of {c} and {t} that go on " + ("as an AI it is " * (c % 3)) + "to their end") for c in range(12) for t in range(4)]
    said = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    said.repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    said.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (tmp_path / "one").mkdir()
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "one/conversations.parquet")
    found = queries()
    shown = lambda df: sorted(map(str, df.collect()))
    for at in ("one", "many"):
        want = found["guarded_responses"](spark, f"{tmp_path}/{at}")
        assert shown(found["guarded_stream"](spark, f"{tmp_path}/{at}").select(*want.columns)) == shown(want)
        texts = found["assembled_responses"](spark, f"{tmp_path}/{at}")
        judged = texts.select("response_id", (~F.lower("text").rlike("dangerous|as an ai|stupid|ignore all previous")).alias("allowed"))
        assert shown(found["audited_stream"](spark, f"{tmp_path}/{at}")) == shown(judged)
