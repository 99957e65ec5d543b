"""Entities, numbers, keywords and document types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.arrays import bind, distinct_sorted
from foliant.functions.text import count_hits, first_best, words

# The edges of a word, spelled out so that every Java version treats letters alike.
_L = r"(?<![\p{L}\p{N}_])"
_R = r"(?![\p{L}\p{N}_])"

# Patterns of dates, addresses and numbers; case does not matter.
DATE_BODIES = [
    r"[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}",
    r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{1,2},?\s+[0-9]{4}",
]
EMAIL_BODY = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
URL_BODY = r"https?://[^\s<>\"{}|\\^`\[\]]+"
NUMBER_BODY = r"[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?"
PHONE_BODY = r"(?:\+[0-9]{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"

# Words that are never keywords of a title or header.
HEADER_STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "have", "been"]

# Phrases that point to a document type, in order of preference.
TYPE_INDICATORS = {
    "invoice": ["invoice", "bill to", "amount due", "payment", "total"],
    "report": ["executive summary", "conclusion", "findings", "analysis"],
    "manual": ["instructions", "step", "how to", "guide", "procedure"],
    "contract": ["agreement", "parties", "terms", "conditions", "hereby"],
    "resume": ["experience", "education", "skills", "employment"],
}


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _if(test: Column, found: Column) -> Column:
    """Skip the search in texts that can not match; most texts hold none of these."""
    return F.when(test, found).otherwise(F.array().cast("array<string>"))


def _whole(body: str) -> str:
    return "(?i)" + _L + body + _R


def capped(items: Column, cap: int | None) -> Column:
    """Distinct values in order; all of them unless the caller asks for the first ``cap``."""
    return distinct_sorted(items) if cap is None else F.slice(distinct_sorted(items), 1, cap)


def dates(text: Column, cap: int | None = None) -> Column:
    return capped(_if(text.rlike("[0-9]"), F.concat(*[find_all(text, _whole(b)) for b in DATE_BODIES])), cap)


def emails(text: Column, cap: int | None = None) -> Column:
    return capped(_if(text.contains("@"), find_all(text, _whole(EMAIL_BODY))), cap)


def urls(text: Column, cap: int | None = None) -> Column:
    return capped(_if(text.contains("://"), find_all(text, "(?i)" + URL_BODY)), cap)


def phones(text: Column, cap: int | None = None) -> Column:
    return capped(_if(text.rlike("[0-9]{3}"), find_all(text, "(?i)" + _L + PHONE_BODY + _R)), cap)


def significant_numbers(text: Column, cap: int | None = None) -> Column:
    """Numbers above 100 or written with thousands commas."""
    keep = lambda n: n.contains(",") | (F.replace(n, F.lit(","), F.lit("")).cast("double") > 100)
    return capped(_if(text.rlike("[0-9]"), F.filter(find_all(text, _whole(NUMBER_BODY)), keep)), cap)


def keywords(title: Column, headers: Column, cap: int | None = None) -> Column:
    """Lower-cased words of more than three letters of the title and the headers."""
    long_words = lambda t: F.transform(F.filter(words(t), lambda w: F.length(w) > 3), F.lower)
    found = F.concat(long_words(F.coalesce(title, F.lit(""))), F.flatten(F.transform(headers, long_words)))
    stop = F.array(*[F.lit(w) for w in HEADER_STOPWORDS])
    return capped(F.array_except(found, stop), cap)


def document_type(text: Column, tables: Column, pages: Column) -> Column:
    low = F.lower(text)
    guess = bind(low, lambda t: first_best(
        [(name, count_hits(t, marks)) for name, marks in TYPE_INDICATORS.items()], F.lit("document"), floor=2))
    return F.when((pages > 0) & (tables / pages > 0.5), "spreadsheet").otherwise(guess)


def search_text(title: Column, author: Column, subject: Column, keyword_list: Column, sections: Column) -> Column:
    # The labels.
    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    return F.concat_ws(
        " | ",
        part("Title: ", title), part("Author: ", author), part("Subject: ", subject),
        part("Keywords: ", F.array_join(keyword_list, ", ")), part("Sections: ", F.array_join(sections, ", ")),
    )


def bibliography(author: Column, title: Column, filename: Column, created: Column, accessed: Column | None = None) -> Column:
    # The marks and labels of an entry.
    given = lambda v: F.coalesce(v, F.lit("")) != ""
    parts = [
        F.when(given(author), author),
        F.concat(F.lit('"'), F.when(given(title), title).otherwise(filename), F.lit('"')),
        F.when(given(created), F.concat(F.lit("("), created, F.lit(")"))),
    ]
    if accessed is not None:
        parts.append(F.when(given(accessed), F.concat(F.lit("Accessed: "), accessed)))
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def highlight(bbox: Column, page: Column) -> Column:
    """Rectangle to highlight for a citation."""
    return F.struct(
        page.alias("page"),
        F.struct(
            bbox["x0"].alias("x"), bbox["y0"].alias("y"),
            (bbox["x1"] - bbox["x0"]).alias("width"), (bbox["y1"] - bbox["y0"]).alias("height"),
        ).alias("highlight"),
    )
