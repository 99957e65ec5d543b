"""Language of a text and normal form of language codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.arrays import bind
from foliant.functions.text import count_hits, first_best

# Words whose presence points to a language, in order of preference.
INDICATORS = {
    "en": ["the", "and", "is", "are", "was", "were", "have", "has"],
    "ja": ["の", "は", "が", "を", "に", "で", "と", "です"],
    "zh": ["的", "是", "在", "有", "和", "了", "不", "我"],
    "ko": ["의", "은", "는", "이", "가", "을", "를", "에"],
    "de": ["der", "die", "und", "ist", "von", "mit", "für"],
    "fr": ["le", "la", "les", "de", "et", "est", "pour"],
}

# Letters that decide a language on sight, tried in this order.
SCRIPTS = {
    "zh": r"[\x{4e00}-\x{9fff}]",
    "vi": r"[\x{0102}\x{0103}\x{0110}\x{0111}\x{0128}\x{0129}\x{0168}\x{0169}\x{01a0}\x{01a1}\x{01af}\x{01b0}]",
    "ja": r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]",
    "ko": r"[\x{ac00}-\x{d7af}]",
    "ru": r"[\x{0400}-\x{04ff}]",
    "ar": r"[\x{0600}-\x{06ff}]",
}

# Codes with their own translations, and regional aliases.
SUPPORTED = ["en", "zh", "vi", "ja", "ko", "ru", "ar", "fr", "de", "es", "pt"]
ALIASES = {"zh-cn": "zh", "zh-tw": "zh", "pt-br": "pt", "pt-pt": "pt", "en-us": "en", "en-gb": "en"}


def by_indicators(text: Column) -> Column:
    """Language with most indicator words; the first listed wins a tie."""
    return bind(
        F.lower(text),
        lambda low: first_best([(code, count_hits(low, words)) for code, words in INDICATORS.items()]),
    )


def by_script(text: Column, fallback: Column | None = None) -> Column:
    """Language by the first script that occurs, else ``fallback``, else English."""
    out = F.when(F.coalesce(text, F.lit("")) == "", "en")
    for code, letters in SCRIPTS.items():
        out = out.when(text.rlike(letters), code)
    return out.otherwise(F.lit("en") if fallback is None else normal_code(fallback))


def normal_code(code: Column) -> Column:
    def plain(low: Column) -> Column:
        alias = F.when(F.lit(False), low)
        for regional, target in ALIASES.items():
            alias = alias.when(low == regional, target)
        return bind(
            F.substring_index(alias.otherwise(low), "-", 1),
            lambda base: F.when(base.isin(SUPPORTED), base).otherwise("en"),
        )

    return bind(F.lower(F.coalesce(code, F.lit(""))), plain)
