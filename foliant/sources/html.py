"""Web pages as text and blocks, with built-in expressions only."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.operators.blocks import blocks_from_text

# Parts without readable text, tags that end a line, and character names.
DROPPED = ["head", "script", "style", "nav", "noscript"]
DROP = [r"(?s)<!--.*?-->"] + [rf"(?is)<{t}\b.*?</{t}\s*>" for t in DROPPED]
LINE_TAGS = (
    r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|hr|tr|table|article|section|header|footer|main|blockquote|pre|title|body|html)\b[^>]*>"
)
OTHER_TAGS = r"<[^>]*>"
NAMED = {
    "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&",
}


#: A character reference other than those above, by name or number.
OTHER_NAMED = "(?s)&(?!(?:" + "|".join(n[1:-1] for n in NAMED) + ");)(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z][A-Za-z0-9]*;)"


@F.pandas_udf(StringType())
def _all_references(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unescape(t.replace("&nbsp;", " ")))


def html_text(html: Column) -> Column:
    """Readable text, one line per block element.

    The common character references are replaced by built-in expressions. Texts with any other name or number go
    through the table of the HTML standard, which reads each reference once; only those texts leave the engine.
    """
    out = html
    for part in DROP:
        out = F.regexp_replace(out, part, " ")
    out = F.regexp_replace(F.regexp_replace(out, LINE_TAGS, "\n"), OTHER_TAGS, "")
    plain = out
    for name, char in NAMED.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    odd = out.rlike(OTHER_NAMED)
    return F.when(odd, _all_references(F.when(odd, out))).otherwise(plain)


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their ``blocks``."""
    return blocks_from_text(pages.withColumn("_text", html_text(F.col(html))), "_text").drop("_text")
