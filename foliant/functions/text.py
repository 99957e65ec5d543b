"""Text column expressions shared by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.arrays import bind

# The white space of Unicode, as str.split and str.strip see it.
SPACES = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a pattern; few ranges make the class quick to test.
SPACE_RUN = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ASCII_WORD = r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}(?![\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Whitespace tokens; the default tokenizer of the chunker."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of whitespace tokens, without building the token array."""
    return F.when(strip(text) == "", F.lit(0)).otherwise(
        F.size(F.split(strip(text), SPACE_RUN))
    )


def ascii_words(text: Column) -> Column:
    """Runs of letters, digits and underscore that are three or more ASCII letters."""
    return F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0))


def is_upper(text: Column) -> Column:
    """At least one upper-case letter and no lower-case or title-case one."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def contains_any(text: Column, needles: list[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | text.contains(needle)
    return test


def count_hits(text: Column, needles: list[str]) -> Column:
    """How many of ``needles`` occur in ``text`` as substrings."""
    total = F.lit(0)
    for needle in needles:
        total = total + text.contains(needle).cast("int")
    return total


def first_best(scores: list[tuple[str, Column]], default: Column | None = None, floor: int = 0) -> Column:
    """Name of the highest score; the earlier name wins a tie. Below ``floor`` the default."""
    names = F.array(*[F.lit(n) for n, _ in scores])

    def pick(values: Column) -> Column:
        best = F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)
        return best if default is None else F.when(F.array_max(values) >= floor, best).otherwise(default)

    return bind(F.array(*[s for _, s in scores]), pick)
