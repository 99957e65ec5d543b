"""URL filters: pattern rules fetched by their rarest literal token. Column expressions only.

Two kinds of rules give a verdict:

- *site rules* (action, host, path): fit the host and its subdomains if the path of the URL
  starts with the rule's; the longest fitting rule wins, a block before an allow of the
  same length. Its literal tokens are those of the host and the closed tokens of the path.
- *pattern rules* (action, tokens, regex): fit if the regular expression is found in host
  and path; ``tokens`` are literals that stand as whole tokens in every URL that fits. They
  decide where no site rule fits; a block goes before an allow.

Tokens are runs of letters and digits, lower-cased. How many URLs hold each of the rules'
tokens is counted over the whole table, and each rule is filed under its rarest token. The
file is a hash table of constant size per rule set: a URL's tokens pick their slots, and
only the rules found there run their regular expressions. A rule without a token runs on
every URL. The rules are part of the plan, so their number is checked against
``max_rules``. The work is done in the row of the URL, without a join.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed; repeated rows are judged row by row; an empty table gives an empty result. Only
the URL column is read; result columns replace columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.arrays import bind

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ["host", "path", "rule", "verdict", "pattern", "n_candidates"]
_RULE = "struct<token string, name string, regex string, site boolean, block boolean, length int>"


@dataclass(frozen=True)
class SiteRule:
    action: str
    rule: str  # host and path, like example.org/es/

    @property
    def regex(self) -> str:
        host, slash, path = self.rule.partition("/")
        return rf"\A(?:[^/]*\.)?{re.escape(host)}(?=/|\z){re.escape(slash + path)}"

    @property
    def tokens(self) -> list[str]:
        host, slash, path = self.rule.partition("/")
        closed = re.findall(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])", slash + path)
        return [t.lower() for t in re.findall(r"[0-9A-Za-z]+", host) + closed]


@dataclass(frozen=True)
class PatternRule:
    action: str
    name: str
    regex: str
    tokens: tuple[str, ...] = ()


#: The site rules of the contract.
SITE_RULES = (
    SiteRule("allow", "org/"),
    SiteRule("block", "example.org/es/"),
    SiteRule("block", "example.org/en/1"),
    SiteRule("allow", "com/fr/"),
    SiteRule("block", "com/de/"),
)


def _word_rules(words: str) -> tuple[PatternRule, ...]:
    return tuple(PatternRule("block", w, rf"(?i)(?:\A|[^0-9a-z]){re.escape(w)}(?:[^0-9a-z]|\z)", tuple(re.findall("[0-9a-z]+", w)))
                 for w in words.split())


#: Unwanted kinds of sites by words of host or path.
PATTERN_RULES = _word_rules("adult adult-x xxx porn sex casino free-bets bets betting poker viagra warez torrent malware phishing")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _A_Z, _a_z), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _A_Z, _a_z), F.lit("([0-9a-z]+)"), 1))


def token_counts(urls: DataFrame, url_col: str, wanted: list[str]) -> dict[str, int]:
    """In how many URLs each of the wanted tokens stands. The result is no longer than ``wanted``."""
    own = F.array(*[F.lit(t) for t in wanted])
    tokens = F.explode(F.array_intersect(_tokens(F.concat(host_of(F.col(url_col)), path_of(F.col(url_col)))), own))
    counted = urls.select(tokens.alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in counted}


def _file(rules: list[tuple], counts: dict[str, int], slots: int) -> tuple[list[list[str]], list[str]]:
    """SQL of the rules in each slot, and of those without a token. The token is hashed by Spark itself."""
    filed: dict[str, list[str]] = {}
    free: list[str] = []
    for name, regex, site, block, tokens in rules:
        token = min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else None
        text = [f"'{x}'" for x in (re.sub(r"(['\\])", r"\\\1", name), re.sub(r"(['\\])", r"\\\1", regex))]
        row = (f"named_struct('token', {'NULL' if token is None else repr(token)}, 'name', {text[0]}, 'regex', {text[1]}, "
               f"'site', {str(site).lower()}, 'block', {str(block).lower()}, 'length', {len(name)})")
        (free if token is None else filed.setdefault(token, [])).append(row)
    return filed, free


def judge(
    urls: DataFrame,
    site_rules: tuple[SiteRule, ...] = SITE_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
    url_col: str = "url",
    keep: list[str] | None = None,
    max_rules: int = 20_000,
) -> DataFrame:
    """The ``keep`` columns with host, path, rule, verdict, pattern and the number of rules that were run."""
    if len(site_rules) + len(pattern_rules) > max_rules:
        raise ValueError("too many rules for one plan; judge by parts of the rule set")
    keep = [c for c in (urls.columns if keep is None else keep) if c not in RESULT]
    rules = [(r.rule, r.regex, True, r.action == "block", r.tokens) for r in site_rules]
    rules += [(r.name, r.regex, False, r.action == "block", [t.lower() for t in r.tokens]) for r in pattern_rules]
    wanted = sorted({t for r in rules for t in r[4]})
    filed, free = _file(rules, token_counts(urls, url_col, wanted) if wanted else {}, 0)
    slots = 1 << max(4, (2 * len(filed)).bit_length())
    at = _slots_of(urls, sorted(filed), slots)
    empty = f"CAST(array() AS array<{_RULE}>)"
    table = [[] for _ in range(slots)]
    for token in sorted(filed):
        table[at[token]] += filed[token]
    index = F.expr("array(" + ", ".join(f"array({', '.join(rows)})" if rows else empty for rows in table) + ")")
    always = F.expr(f"array({', '.join(free)})" if free else empty)

    def fetched(subject: Column) -> Column:
        own = F.flatten(F.transform(_tokens(subject), lambda t: F.filter(
            F.get(index, F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")), lambda r: r["token"] == t)))
        return F.concat(own, always)

    def decided(rows: Column) -> Column:
        site = F.array_max(F.transform(F.filter(rows, lambda r: r["site"]), lambda r: F.struct(r["length"], r["block"], r["name"])))
        other = F.array_max(F.transform(F.filter(rows, lambda r: ~r["site"]), lambda r: F.struct(r["block"], r["length"], r["name"])))
        return F.struct(site.alias("site"), other.alias("other"))

    cut = urls.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                      host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = cut.select("_row", "host", "path", bind(F.concat("host", "path"), lambda subject: bind(
        fetched(subject), lambda rows: F.struct(
            F.size(rows).alias("n"),
            decided(F.filter(rows, lambda r: F.regexp_like(subject, r["regex"]))).alias("d")))).alias("_f"))
    site, other = F.col("_f.d.site"), F.col("_f.d.other")
    blocked = F.coalesce(site.getField("block"), other.getField("block"), F.lit(False))
    return found.select(
        *[F.col("_row").getField(c).alias(c) for c in keep], "host", "path", site.getField("name").alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
        F.when(site.isNull(), other.getField("name")).alias("pattern"), F.col("_f.n").alias("n_candidates"))


def _slots_of(urls: DataFrame, tokens: list[str], slots: int) -> dict[str, int]:
    """Slot of each token by the hash that the plan uses; one row, made of the rules alone."""
    if not tokens:
        return {}
    spark = urls.sparkSession
    one = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(slots)).cast("int").alias(f"s{i}") for i, t in enumerate(tokens)]).first()
    return {t: one[i] for i, t in enumerate(tokens)}
