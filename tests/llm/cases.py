"""Small tables that hold the awkward cases, and plain Python versions of the rules."""

import re

LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Extra columns whose names meet those that operators use inside or return.
CLASHES = ("_row", "_text", "_id", "_hit", "_part", "kept", "score", "n_words", "length", "record", "hash", "rule", "label")


def lower_words(text):
    return WORD.findall((text or "").translate(_LOW))


def documents(spark, texts, ids=None, langs=None):
    """A documents table with clashing extra columns; ``ids`` may repeat or be null."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, "src0", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, g in zip(ids, texts, langs)]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def awkward(spark):
    """Null and empty texts, no words, one word, a very long text, repeated rows, null ids."""
    texts = [None, "", " \n\t ", "!!! ...", "word", "Ünï 日本", LONG, "same text here " * 30, "same text here " * 30, "same text here " * 30, "a\nb\n\nc"]
    return documents(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, None, 8], ["en", "en", None, "en", "de", "de", "en", "fr", "fr", None, "es"])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
