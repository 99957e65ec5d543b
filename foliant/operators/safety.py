"""Running scanners over a table of texts and combining their verdicts."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import scanners as S
from foliant.functions.arrays import bind, sorted_join
from foliant.functions.scanners import Scanner
from foliant.functions.text import strip
from foliant.session import cut_lineage

INPUT_ORDER = ["ban_substrings", "prompt_injection", "toxicity", "secrets", "code", "anonymize", "token_limit"]
OUTPUT_ORDER = ["ban_substrings", "toxicity", "malicious_urls", "no_refusal", "code"]
FACTORIES = {
    "ban_substrings": S.ban_substrings, "prompt_injection": S.prompt_injection, "toxicity": S.toxicity,
    "secrets": S.secrets, "code": S.code, "anonymize": S.anonymize, "token_limit": S.token_limit,
    "malicious_urls": S.malicious_urls, "no_refusal": S.no_refusal,
}
_ON = ("1", "true", "yes", "on")
_OFF = ("0", "false", "no", "off")
DEFAULT_REASON = "Content policy violation"


def select_scanners(side: str, config: Mapping | None = None, env: Mapping[str, str] | None = None,
                    scan_code_input: bool = False) -> list[Scanner]:
    """Scanners to run for ``input`` or ``output``.

    A variable FOLIANT_<SIDE>_<NAME> decides first, then ``config[name]["enabled"]``,
    else a scanner runs. Code on the input side needs ``scan_code_input`` as well.
    """
    env = os.environ if env is None else env
    config = config or {}
    chosen = []
    for name in INPUT_ORDER if side == "input" else OUTPUT_ORDER:
        options = dict(config.get(name, {}))
        enabled = bool(options.pop("enabled", True))
        flag = env.get(f"FOLIANT_{side}_{name}".upper(), "").lower()
        enabled = True if flag in _ON else False if flag in _OFF else enabled
        if name == "code" and side == "input" and not scan_code_input:
            enabled = False
        if enabled:
            chosen.append(FACTORIES[name](**options))
    return chosen


def scan(df: DataFrame, text: str, scanners: list[Scanner], fail_fast: bool = True, on_error: str = "block",
         out: str = "scan") -> DataFrame:
    """Add ``scan``: struct<allowed, sanitized, scanners, scanner_count, error>.

    Scanners run in order, each on the text the one before left. With ``fail_fast``
    no scanner after the first failure is worked out. A scanner without a score
    failed to run; ``on_error`` says whether that blocks or allows.
    """
    if on_error not in ("block", "allow"):
        raise ValueError(on_error)
    if not scanners:
        return df.withColumn(out, F.struct(
            F.lit(True).alias("allowed"), F.col(text).alias("sanitized"),
            F.create_map().cast("map<string,struct<passed:boolean,risk_score:double,sanitized:boolean>>").alias("scanners"),
            F.lit(0).alias("scanner_count"), F.lit(None).cast("string").alias("error")))

    def finish(state: Column, done: list[Column]) -> Column:
        changed = ~state["text"].eqNullSafe(F.col(text))
        entries = F.array_compact(F.array(*[
            F.when(r["ran"], F.struct(F.lit(s.name).alias("key"), F.struct(
                r["passed"].alias("passed"),
                (F.least(F.greatest(F.coalesce(r["score"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 100).alias("risk_score"),
                changed.alias("sanitized"),
            ).alias("value"))) for s, r in zip(scanners, done)]))
        allowed, errors = F.lit(True), []
        for s, r in zip(scanners, done):
            allowed = allowed & (~r["ran"] | r["passed"])
            errors.append(F.when(r["ran"] & r["score"].isNull(), f"scanner {s.name} failed"))
        return F.struct(
            allowed.alias("allowed"), state["text"].alias("sanitized"), F.map_from_entries(entries).alias("scanners"),
            F.lit(len(scanners)).alias("scanner_count"), F.nullif(F.concat_ws("; ", *errors), F.lit("")).alias("error"))

    def run(state: Column, done: list[Column]) -> Column:
        if len(done) == len(scanners):
            return finish(state, done)
        checked = F.when(state["go"], scanners[len(done)].check(state["text"]))

        def judged(r: Column) -> Column:
            passed = F.when(r["score"].isNull(), F.lit(on_error == "allow")).otherwise(r["passed"])
            return F.struct(state["go"].alias("ran"), passed.alias("passed"), r["score"].alias("score"), r["text"].alias("text"))

        def onward(r: Column) -> Column:
            go = state["go"] & (r["passed"] if fail_fast else F.lit(True))
            left = F.when(r["ran"], F.coalesce(r["text"], state["text"])).otherwise(state["text"])
            return bind(F.struct(left.alias("text"), go.alias("go")), lambda nxt: run(nxt, [*done, r]))

        return bind(bind(checked, judged), onward)

    start = F.struct(F.col(text).alias("text"), F.lit(True).alias("go"))
    return df.withColumn(out, bind(start, lambda state: run(state, [])))


def failed_scanners(results: Column, has: tuple[str, ...] = ("risk_score",)) -> Column:
    """array<struct<scanner, reason, score>> of the scanners that did not pass.

    ``has`` names the fields that the values of the map carry besides ``passed``.
    """
    def entry(e: Column) -> Column:
        v = e["value"]
        filled = lambda n: F.nullif(v[n], F.lit(""))
        reason = F.coalesce(*[filled(n) for n in ("reason", "message") if n in has], F.lit(DEFAULT_REASON))
        score = F.coalesce(*[v[n] for n in ("score", "risk_score") if n in has]) if {"score", "risk_score"} & set(has) else F.lit(None)
        return F.struct(e["key"].alias("scanner"), reason.alias("reason"), score.cast("double").alias("score"))

    failed = F.filter(F.map_entries(results), lambda e: e["value"].isNotNull() & ~F.coalesce(e["value"]["passed"], F.lit(True)))
    return F.transform(failed, entry)


def vault(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, placeholder, original) of all masked values."""
    return df.select(*ids, F.explode_outer(S.personal_values(F.col(text))).alias("v")).where("v IS NOT NULL").select(*ids, "v.*")


def restore(masked: DataFrame, vault_rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    """Put the originals back. The values of one text fit in a row, as the text does."""
    values = vault_rows.groupBy(*ids).agg(F.collect_list(F.struct("placeholder", "original")).alias("_vs"))
    joined = masked.join(values, ids, "left")
    return joined.withColumn(text, F.when(F.col("_vs").isNull(), F.col(text)).otherwise(S.unmask(F.col(text), F.col("_vs")))).drop("_vs")


def scan_summary(scanned: DataFrame, by: list[str]) -> DataFrame:
    """Texts, blocked texts and failures per scanner, per group. One row per scanner that ran."""
    rows = scanned.select(*by, F.explode_outer("scan.scanners").alias("scanner", "v")).where("scanner IS NOT NULL")
    return rows.groupBy(*by, "scanner").agg(
        F.count(F.lit(1)).alias("ran"),
        F.count_if(~F.col("v.passed")).alias("failed"),
        F.avg((~F.col("v.passed")).cast("double")).alias("failed_share"),
    )


# ---- conversations and payloads -------------------------------------------

def conversation_text(turns: DataFrame, roles: list[str] | None = None, part_turns: int = 100_000) -> DataFrame:
    """The texts of a conversation joined by newline, in turn order: one row per conversation.

    Runs of ``part_turns`` turn numbers are joined first and then the runs; the result does
    not depend on it.
    """
    keep = strip_filled(F.col("text"))
    if roles:
        keep = keep & F.lower("role").isin([r.lower() for r in roles])
    pairs = turns.where(keep).select(
        "conv_id", F.floor(F.col("turn") / part_turns).alias("part"),
        F.struct(F.col("turn").alias("turn"), F.col("text").alias("text")).alias("p"))
    runs = pairs.groupBy("conv_id", "part").agg(sorted_join(F.collect_list("p"), "\n").alias("text"))
    return runs.groupBy("conv_id").agg(sorted_join(F.collect_list(F.struct("part", "text")), "\n").alias("text"))


def strip_filled(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) != ""


def latest_turn(turns: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """The last filled turn of the roles; combined before the shuffle."""
    keep = strip_filled(F.col("text"))
    if roles:
        keep = keep & F.lower("role").isin([r.lower() for r in roles])
    return turns.where(keep).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def model_of(payload: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(payload, "$.model"), F.lit("")), F.lit("default"))


def prompt_of(payload: Column) -> Column:
    """prompt, else input, else the payload itself; a list of prompts is joined by newline."""
    prompt = F.get_json_object(payload, "$.prompt")
    listed = F.when(prompt.startswith("["), F.array_join(F.from_json(prompt, "array<string>"), "\n"))
    return F.coalesce(listed, prompt, F.get_json_object(payload, "$.input"), payload)


def answer_of(payload: Column) -> Column:
    """response, text or output, else all string values joined by a space, else the payload."""
    named = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("response", "text", "output")])
    values = F.map_values(F.from_json(payload, "map<string,variant>"))
    strings = F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    joined = F.nullif(F.array_join(strings, " "), F.lit(""))
    return F.coalesce(named, joined, payload)


# ---- a linear model over hashed words -------------------------------------------------

#: Buckets that words are hashed into; the whole model is two arrays of this many numbers.
WORD_BUCKETS = 1 << 14


@dataclass(frozen=True)
class WordRisk:
    """Weight of one occurrence of a word of each bucket, and the intercept."""

    weight: np.ndarray
    intercept: float


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("int"))


def fit_word_risk(labelled: DataFrame, words_col: str, label_col: str, iterations: int = 20, strength: float = 0.01) -> WordRisk:
    """Logistic regression on word counts weighted by rarity; rows of ``labelled`` have a list of words and a 0/1 label.

    The counts are stored first, so what the fit reads again in every iteration is a narrow table. What is kept of
    the fitted model is its numbers: it can be used in any session, and no task carries more than two arrays.
    """
    rows = cut_lineage(labelled.select(_buckets(F.col(words_col)).alias("b"), F.col(label_col).cast("double").alias("label")))
    n = rows.count()
    seen = rows.select(F.explode(F.array_distinct("b")).alias("k")).groupBy("k").count().toArrow()  # at most one row a bucket
    held = np.zeros(WORD_BUCKETS)
    held[seen.column("k").to_numpy()] = seen.column("count").to_numpy()
    rarity = np.log((n + 1) / (held + 1))
    labels = {r["label"] for r in rows.select("label").distinct().limit(3).collect()}
    if len(labels) < 2:  # nothing to tell apart: the risk is that of the only label
        return WordRisk(np.zeros(WORD_BUCKETS), 20.0 if labels == {1.0} else -20.0)
    as_vector = F.udf(lambda b: _vector(b, rarity), VectorUDT())
    model = LogisticRegression(maxIter=iterations, regParam=strength).fit(rows.select("label", as_vector("b").alias("features")))
    return WordRisk(model.coefficients.toArray() * rarity, float(model.intercept))


def _vector(buckets: list[int], rarity: np.ndarray) -> SparseVector:
    at, times = np.unique(np.asarray(buckets, dtype="int64"), return_counts=True)
    return SparseVector(WORD_BUCKETS, at.tolist(), (times * rarity[at]).tolist())


def word_risk(rows: DataFrame, model: WordRisk, words_col: str) -> DataFrame:
    """Add ``risk`` (0 to 1). The rows stay where they are; the words are hashed and only the hashes leave the engine."""
    weight, intercept = model.weight, model.intercept

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        sizes = found.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, "int64"), *found.to_numpy()]).astype("int64")
        sums = np.bincount(np.repeat(np.arange(len(found)), sizes), weights=weight[flat], minlength=len(found))
        return pd.Series(1 / (1 + np.exp(-np.clip(sums + intercept, -500, 500))))

    return rows.withColumn("risk", score(F.coalesce(_buckets(F.col(words_col)), F.array().cast("array<int>"))))
