"""Scanning policy, messages and conversations."""

import pandas as pd
from pyspark.sql import functions as F

from foliant.functions import messages as M
from foliant.functions import scanners as S
from foliant.operators import safety as G


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_fail_fast_and_combination(spark):
    df = frame(spark, "fine", "a dangerous idiot and moron", 'token = "0123456789abcdef0123"')
    chosen = [S.ban_substrings(), S.toxicity(), S.secrets()]
    fast = G.scan(df, "text", chosen).orderBy("id").select("scan.*").collect()
    assert [r.allowed for r in fast] == [True, False, False]
    assert list(fast[1].scanners) == ["ban_substrings"] and fast[1].scanners["ban_substrings"].risk_score == 100.0
    assert fast[2].sanitized == "******" and all(v.sanitized for v in fast[2].scanners.values())
    slow = G.scan(df, "text", chosen, fail_fast=False).orderBy("id").select("scan.*").collect()
    assert len(slow[1].scanners) == 3 and not slow[1].scanners["toxicity"].passed
    for r in slow:
        assert r.allowed == all(v.passed for v in r.scanners.values())


def test_error_policy(spark):
    @F.pandas_udf("double")
    def broken(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if "bad" in t else 0.1)

    df = frame(spark, "good", "bad")
    scanner = [S.model_scanner("model", broken)]
    scored = df.withColumn("risk", broken("text"))  # a Python model runs as a column of its own
    scanner = [S.model_scanner("model", lambda _: F.col("risk"))]
    block = G.scan(scored, "text", scanner).orderBy("id").select("scan.*").collect()
    allow = G.scan(scored, "text", scanner, on_error="allow").orderBy("id").select("scan.*").collect()
    assert [r.allowed for r in block] == [True, False] and block[1].error == "scanner model failed"
    assert [r.allowed for r in allow] == [True, True] and allow[0].error is None


def test_selection(spark):
    names = lambda **kw: [s.name for s in G.select_scanners(**kw)]
    assert names(side="input", env={}) == ["ban_substrings", "prompt_injection", "toxicity", "secrets", "anonymize", "token_limit"]
    assert "code" in names(side="input", env={}, scan_code_input=True)
    assert "toxicity" not in names(side="output", config={"toxicity": {"enabled": False}}, env={})
    assert "toxicity" in names(side="output", config={"toxicity": {"enabled": False}}, env={"FOLIANT_OUTPUT_TOXICITY": "yes"})
    assert "secrets" not in names(side="input", env={"FOLIANT_INPUT_SECRETS": "off"})


def test_failed_scanner_details(spark):
    schema = "scanners map<string,struct<passed:boolean,reason:string,message:string,score:double,risk_score:double>>"
    rows = [({"a": (True, None, None, 0.1, None), "b": (False, None, "msg", None, 80.0), "c": (False, "why", "msg", 0.25, 1.0), "d": (False, None, None, None, None)},)]
    got = spark.createDataFrame(rows, schema).select(G.failed_scanners(F.col("scanners"), ("reason", "message", "score", "risk_score")).alias("f")).first().f
    assert {(r.scanner, r.reason, r.score) for r in got} == {("b", "msg", 80.0), ("c", "why", 0.25), ("d", "Content policy violation", None)}


def test_percent_and_report(spark):
    df = spark.createDataFrame([(0.5,), (80.0,), (-1.0,), (400.0,), (None,)], "s double")
    assert [r[0] for r in df.select(M.score_percent(F.col("s"))).collect()] == ["50.0%", "80.0%", "0.0%", "100.0%", "-"]
    empty = spark.range(1).select(M.markdown_report("T", F.lit(""), F.array().cast("array<struct<scanner:string,reason:string,score:double>>"))).first()[0]
    assert empty == "### T\n\n" + M.ADVICE


def test_messages(spark):
    df = spark.createDataFrame([("de", "x"), ("xx", "y"), ("zh", None)], "language string, reason string")
    got = {r.language: r.message for r in M.localized(df, "prompt_blocked", reason="reason").collect()}
    assert got["de"].endswith("Grund: x") and got["xx"].startswith("Your input") and "{reason}" in got["zh"]
    assert all(len(v) == len(M.KEYS) for v in M.TEXTS.values()) and len(M.TEXTS) == 11
    forms = spark.range(1).select(M.notice(F.lit("timeout"), "plain"), M.notice(F.lit("?"), "html")).first()
    assert forms[0].startswith("ERROR: ⏱") and forms[1].startswith("<div")


def test_error_classes(spark):
    cases = [("violates Content Policy", "scanner_invalid"), ("Blocked", "scanner_invalid"), ("inappropriate", "inappropriate"),
             ("security threat", "threat_detected"), ("it timed out", "timeout"), ("hm", "generic"), ("", "generic"), (None, "generic")]
    df = spark.createDataFrame(cases, "t string, e string")
    assert all(r.e == r.g for r in df.select("e", M.error_class(F.col("t")).alias("g")).collect())
    events = [('{"status": 451}', True), ('{"status": "x"}', False), ('{"X-Error-Type": "content_policy_violation"}', True), ("451 blocked", True), ("451", False), (None, False)]
    df = spark.createDataFrame(events, "t string, e boolean")
    assert all(r.e == r.g for r in df.select("e", M.is_block_event(F.col("t")).alias("g")).collect())


def test_masking(spark):
    text = "Mail a@b.org, a@b.org or xa@b.org; call (555) 123-4567 from 10.0.0.1, Test LLC"
    r = frame(spark, text).select(S.personal_values(F.col("text")).alias("v"), S.mask_values(F.col("text"), S.personal_values(F.col("text"))).alias("m")).first()
    assert r.m == "Mail [EMAIL_1], [EMAIL_1] or [EMAIL_2]; call [PHONE_1] from [IP_1], [NAME_1]"
    masked = frame(spark, r.m)
    back = G.restore(masked, G.vault(frame(spark, text), ["id"], "text"), ["id"], "text").first().text
    assert back == text


def test_masking_next_to_written_placeholders(spark):
    text = "See [EMAIL_1] and [EMAIL_7], or mail a@b.org; id 12345678901234567890 is no card, 5555666677778888 is"
    r = frame(spark, text).select(S.mask_values(F.col("text"), S.personal_values(F.col("text"))).alias("m")).first()
    assert r.m == "See [EMAIL_1] and [EMAIL_7], or mail [EMAIL_8]; id 12345678901234567890 is no card, [CARD_1] is"
    back = G.restore(frame(spark, r.m), G.vault(frame(spark, text), ["id"], "text"), ["id"], "text").first().text
    assert back == text


def test_conversations(spark):
    rows = [(1, 0, "System", "s"), (1, 1, "USER", "u1"), (1, 2, "assistant", "a"), (1, 3, "user", "  "), (1, 4, "user", "u2"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert [r.text for r in G.conversation_text(df, ["user"]).collect()] == ["u1\nu2"]
    assert [r.text for r in G.conversation_text(df.where("conv_id = 1"), part_turns=2).collect()] == ["s\nu1\na\nu2"]
    assert [(r.conv_id, r.text) for r in G.latest_turn(df, ["user"]).collect()] == [(1, "u2")]


def test_payloads(spark):
    rows = [('{"model": null, "prompt": ["a", "b"]}',), ('{"input": "i"}',), ("bare",)]
    df = spark.createDataFrame(rows, "p string")
    got = df.select(G.model_of(F.col("p")), G.prompt_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("default", "a\nb"), ("default", "i"), ("default", "bare")]


def test_word_risk_tells_labels_apart_and_survives_odd_rows(spark):
    from foliant.operators import safety as G

    rows = [(i, ["good", "day", f"w{i % 7}"] if i % 3 else ["bad", "day", f"w{i % 7}"], int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, [], 0), (101, None, None)], "id long, words array<string>, label int")
    model = G.fit_word_risk(docs.where("id < 60"), "words", "label")
    risk = {r["id"]: r["risk"] for r in G.word_risk(docs, model, "words").collect()}
    assert all((risk[i] > 0.5) == (i % 3 == 0) for i in range(60)) and 0 <= risk[100] <= 1 and risk[100] == risk[101]
    assert model.weight.shape == (G.WORD_BUCKETS,)
    one = G.fit_word_risk(docs.where("label = 0"), "words", "label")
    assert all(r["risk"] < 1e-6 for r in G.word_risk(docs, one, "words").collect())
