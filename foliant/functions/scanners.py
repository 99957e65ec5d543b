"""Scanners: from a text column to struct<passed, score, text>.

``score`` is the risk from 0 to 1 and ``text`` the text that later steps should
see. The rules are explicit and plain; a model can stand in for any of them (see
``model_scanner``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.arrays import bind
from foliant.functions.extract import EMAIL_BODY, URL_BODY, find_all
from foliant.functions.text import contains_any, word_count, words

# Default settings of the scanners.
BANNED = ["malicious", "dangerous"]
TOXICITY_THRESHOLD = 0.5
TOKEN_LIMIT = 4000
DENIED_HOSTS = 1000
ALLOWED_NAMES = ["John Doe"]
HIDDEN_NAMES = ["Test LLC"]

# Rule lists of this engine.
INJECTION_RULES = [
    r"ignore (?:all |any )?(?:the )?(?:previous|prior|above) (?:instructions|rules|messages)",
    r"disregard (?:all |any )?(?:the )?(?:previous|prior|above|your) (?:instructions|rules|guidelines)",
    r"you are now [a-z]+",
    r"(?:reveal|print|show)(?: me)? (?:the |your )?(?:system|hidden) prompt",
    r"pretend (?:to be|you are)",
    r"developer mode|jailbreak",
]
TOXIC_WORDS = [
    "trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid",
]
SECRET_RULES = [
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i:api_?key|token|secret|password) ?[=:] ?[\"']?[A-Za-z0-9_-]{16,}[\"']?",
]
REFUSALS = [
    r"i(?: am|'m) (?:sorry|unable|not able)", r"i can(?:not|'t)(?: help| assist| do| comply)", r"as an ai",
    r"against my (?:guidelines|programming)",
]
CODE_RULES = {
    "Python": ["def ", "import ", "elif ", "self.", "print(", "lambda "],
    "C#": ["using System", "namespace ", "public class ", "Console.Write", "string[] ", "async Task"],
    "C++": ["#include <", "std::", "cout <<", "template<", "nullptr", "->"],
    "C": ["#include <", "printf(", "malloc(", "int main(", "struct ", "->"],
}
CODE_FLOOR = 2
# Kinds of personal data, longest forms first.
PERSONAL = {
    "EMAIL": EMAIL_BODY,
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "CARD": r"\b[0-9]{16}\b",
    "PHONE": r"(?:\+[0-9]{1,3} ?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
}


@dataclass(frozen=True)
class Scanner:
    name: str
    check: Callable[[Column], Column]


def verdict(passed: Column, score: Column, text: Column) -> Column:
    return F.struct(passed.alias("passed"), score.cast("double").alias("score"), text.alias("text"))


def ban_substrings(substrings: list[str] = BANNED) -> Scanner:
    def check(text: Column) -> Column:
        hit = bind(F.lower(text), lambda low: contains_any(low, [s.lower() for s in substrings]))
        return bind(hit, lambda h: verdict(~h, F.when(h, 1.0).otherwise(0.0), text))

    return Scanner("ban_substrings", check)


def _rule_hits(text: Column, rules: list[str]) -> Column:
    total = F.lit(0)
    for rule in rules:
        total = total + text.rlike(rule).cast("int")
    return total


def prompt_injection(threshold: float = 0.5) -> Scanner:
    def check(text: Column) -> Column:
        hits = bind(F.lower(text), lambda low: _rule_hits(low, INJECTION_RULES))
        score = F.least(hits * 0.6, F.lit(1.0))
        return bind(score, lambda s: verdict(s <= threshold, s, text))

    return Scanner("prompt_injection", check)


def toxicity(threshold: float = TOXICITY_THRESHOLD) -> Scanner:
    """Share of the toxic vocabulary met, so that two words pass the default threshold."""
    def check(text: Column) -> Column:
        hits = bind(F.lower(text), lambda low: _rule_hits(low, [rf"\b{w}\b" for w in TOXIC_WORDS]))
        return bind(F.least(hits * 0.4, F.lit(1.0)), lambda s: verdict(s <= threshold, s, text))

    return Scanner("toxicity", check)


def find_secrets(text: Column) -> Column:
    return find_all(text, "|".join(SECRET_RULES))


def secrets(mask: str = "******") -> Scanner:
    def check(text: Column) -> Column:
        hit = text.rlike("|".join(SECRET_RULES))
        masked = F.regexp_replace(text, "|".join(SECRET_RULES), mask)
        return bind(hit, lambda h: verdict(~h, F.when(h, 1.0).otherwise(0.0), F.when(h, masked).otherwise(text)))

    return Scanner("secrets", check)


def code_scores(text: Column) -> Column:
    """map language -> number of its marks in the text."""
    entries = []
    for language, marks in CODE_RULES.items():
        hits = F.lit(0)
        for mark in marks:
            hits = hits + text.contains(mark).cast("int")
        entries += [F.lit(language), hits]
    return F.create_map(*entries)


def code(languages: list[str] | None = None, floor: int = CODE_FLOOR) -> Scanner:
    wanted = languages or list(CODE_RULES)

    def check(text: Column) -> Column:
        best = bind(code_scores(text), lambda m: F.greatest(*[F.element_at(m, w) for w in wanted]))
        return bind(best, lambda b: verdict(b < floor, F.least(b / F.lit(4.0), F.lit(1.0)), text))

    return Scanner("code", check)


def no_refusal() -> Scanner:
    def check(text: Column) -> Column:
        hit = F.lower(text).rlike("|".join(REFUSALS))
        return bind(hit, lambda h: verdict(~h, F.when(h, 1.0).otherwise(0.0), text))

    return Scanner("no_refusal", check)


def token_limit(limit: int = TOKEN_LIMIT) -> Scanner:
    """Too long a text fails, and is cut to the limit."""
    def check(text: Column) -> Column:
        cut = F.array_join(F.slice(words(text), 1, limit), " ")
        return bind(word_count(text), lambda n: verdict(
            n <= limit, F.when(n > limit, 1.0).otherwise(0.0), F.when(n > limit, cut).otherwise(text)))

    return Scanner("token_limit", check)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_risk(url: Column) -> Column:
    """Lexical risk of a URL: raw address, many labels, odd characters, bait words."""
    host = url_host(url)
    return bind(host, lambda h: F.least(
        F.when(h.rlike(r"^[0-9.]+$"), 0.6).otherwise(0.0)
        + F.when(F.size(F.split(h, r"\.")) > 4, 0.3).otherwise(0.0)
        + F.when(h.rlike("xn--|--"), 0.3).otherwise(0.0)
        + F.when(h.rlike("spam|phish|malware|free-|login-"), 0.6).otherwise(0.0)
        + F.when(F.length(url) > 200, 0.2).otherwise(0.0), F.lit(1.0)))


def malicious_urls(threshold: float = 0.5, denied: list[str] | None = None) -> Scanner:
    """Lexical risk, and full risk for hosts on a list of ``denied`` ones and all their subdomains.

    The list is part of the plan; a table of hosts is joined to the links instead, as in ``scan_urls``.
    """
    hosts = sorted({h.lower() for h in denied or []})
    if len(hosts) > DENIED_HOSTS:
        raise ValueError(f"more than {DENIED_HOSTS} denied hosts: join a table of them to the links")
    named = "(?:^|\\.)(?:" + "|".join(h.replace(".", "\\.") for h in hosts) + ")$"

    def risk(url: Column) -> Column:
        return F.when(url_host(url).rlike(named), 1.0).otherwise(url_risk(url)) if hosts else url_risk(url)

    def check(text: Column) -> Column:
        risks = F.transform(find_all(text, "(?i)" + URL_BODY), risk)
        return bind(F.coalesce(F.array_max(risks), F.lit(0.0)), lambda s: verdict(s <= threshold, s, text))

    return Scanner("malicious_urls", check)


def personal_values(text: Column, allowed: list[str] = ALLOWED_NAMES, hidden: list[str] = HIDDEN_NAMES) -> Column:
    """array<struct<placeholder, original>>, numbered per kind in order of first use.

    Values on the allow-list stay; the names to hide are always taken.
    """
    parts = []
    for kind, body in PERSONAL.items():
        found = F.array_distinct(find_all(text, body))
        keep = F.filter(found, lambda v: ~v.isin(allowed)) if allowed else found
        parts.append(_numbered(keep, kind, text))
    if hidden:
        there = F.filter(F.array(*[F.lit(n) for n in hidden]), text.contains)
        parts.append(_numbered(there, "NAME", text))
    return F.concat(*parts)


def _numbered(values: Column, kind: str, text: Column) -> Column:
    """Placeholders count on from those that stand in the text already, so that they can be told apart."""
    written = F.regexp_extract_all(text, F.lit(rf"\[{kind}_([0-9]{{1,8}})\]"), 1)
    before = F.when(text.contains(f"[{kind}_"), F.coalesce(F.array_max(F.transform(written, lambda n: n.cast("int"))), F.lit(0))).otherwise(0)
    return bind(before, lambda n: F.transform(values, lambda v, i: F.struct(
        F.concat(F.lit(f"[{kind}_"), (i + n + 1).cast("string"), F.lit("]")).alias("placeholder"), v.alias("original"))))


def mask_values(text: Column, values: Column) -> Column:
    """Put the placeholders in, longer originals first so that none is cut apart."""
    by_length = F.transform(
        F.sort_array(F.transform(values, lambda v: F.struct((-F.length(v["original"])).alias("n"), v["placeholder"], v["original"]))),
        lambda v: F.struct(v["placeholder"], v["original"]))
    return F.aggregate(by_length, text, lambda t, v: F.replace(t, v["original"], v["placeholder"]))


def unmask(text: Column, values: Column) -> Column:
    return F.aggregate(values, text, lambda t, v: F.replace(t, v["placeholder"], v["original"]))


def anonymize(allowed: list[str] = ALLOWED_NAMES, hidden: list[str] = HIDDEN_NAMES) -> Scanner:
    """Masks personal data; finding some is a failed check."""
    def check(text: Column) -> Column:
        return bind(personal_values(text, allowed, hidden), lambda vs: verdict(
            F.size(vs) == 0, F.when(F.size(vs) > 0, 1.0).otherwise(0.0), mask_values(text, vs)))

    return Scanner("anonymize", check)


def model_scanner(name: str, score_udf: Callable[[Column], Column], threshold: float = 0.5) -> Scanner:
    """A scanner around a pandas UDF of text to risk; a null risk counts as an error."""
    def check(text: Column) -> Column:
        return bind(score_udf(text), lambda s: verdict(s <= threshold, s, text))

    return Scanner(name, check)
