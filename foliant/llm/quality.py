"""Quality rules, line by line first, then for the document. Column expressions only.

Words are runs of characters other than the six ASCII white space characters. Each line with
a word is judged alone:

- punctuation: more than ``max_symbols`` of its characters are symbols (``#*$%&|<>``), or it
  has at least four words and one exclamation or question mark for every two words;
- navigation: at least three separators (``|``, ``»``, ``›``, ``•``), one for every four words;
- boilerplate: one of the phrases of BOILERPLATE as whole words, in a line of at most ``boilerplate_times`` as
  many words as the phrase has, so that a sentence that mentions one stays.

Lines that fail are removed. A document is rejected if it fails the base rules (too few
words, or too many words in repeated three-word windows), or if the removed lines hold more
than ``max_loss`` of its word characters.

Everything happens in the row of the text: no shuffle, and the cost of a text is its length
times the logarithm of its length. Three-word windows are compared by a 64-bit hash: the
hashes are sorted with their place in the low bits, and equal neighbours are confirmed on
the full hash.

Cases: a null or empty text has no words and fails the base rules; blank lines stay and
count for nothing; repeated rows are judged row by row. Only the text column is read; result
columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.arrays import bind

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
BOILERPLATE = (
    r"(?i)(?:^|[^\p{L}\p{N}])(all rights reserved|privacy policy|cookie policy|accept (all )?cookies|terms of (use|service)|"
    "enable javascript|click here|read more|sign (in|up)|log ?in|subscribe (now|to our)|share this|skip to content|"
    r"back to top|lorem ipsum)(?:$|[^\p{L}\p{N}])"
)
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
          "n_removed_lines", "removed_chars", "kept", "clean_text"]


def _drop(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def _how_many(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included."""

    def of_hashes(hashes: Column) -> Column:
        # The place takes just the bits it needs; the hash keeps the rest.
        return bind(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(hashes).cast("long")))) - 1, lambda mask: bind(
            F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))),
            lambda order: of_order(hashes, mask, order)))

    def of_order(hashes: Column, mask: Column, order: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.get(hashes, a.bitwiseAND(mask).cast("int")) == F.get(hashes, b.bitwiseAND(mask).cast("int"))

        found = F.filter(order, lambda x, i: F.coalesce(same(F.get(order, i - 1), x), F.lit(False)) |
                         F.coalesce(same(F.get(order, i + 1), x), F.lit(False)))
        return bind(F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask))), lambda places: F.aggregate(
            F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(3).cast("long"), p - F.get(places, i - 1)), F.lit(3).cast("long"))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                          lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(bind(windows, of_hashes))


def _judge_lines(lines: Column, max_symbols: float, boilerplate_times: int) -> Column:
    """array<struct<line, chars, bad>>: each line, its word characters, and whether a rule fails it."""

    def one(line: Column) -> Column:
        return bind(_drop(line, SPACES), lambda solid: bind(
            F.struct(F.length(solid).alias("chars"), (F.length(solid) - F.length(_drop(solid, SYMBOLS))).alias("symbols"),
                     F.size(_words(line)).alias("words")), lambda n: F.struct(
                line.alias("line"), n["chars"].alias("chars"), ((n["chars"] > 0) & (
                    (n["symbols"] > n["chars"] * max_symbols)
                    | ((n["words"] >= 4) & ((_how_many(solid, "!") + _how_many(solid, "?")) * 2 >= n["words"]))
                    | bind(sum((_how_many(solid, s) for s in SEPARATORS), F.lit(0)), lambda k: (k >= 3) & (k * 4 >= n["words"]))
                    | bind(F.regexp_extract(line, BOILERPLATE, 1), lambda phrase: (phrase != "") & (n["words"] <= (_how_many(phrase, " ") + 1) * boilerplate_times)))).alias("bad"))))

    return F.transform(lines, one)


def judge(
    documents: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_symbols: float = 0.1,
    boilerplate_times: int = 4,
    max_loss: float = 0.3,
) -> DataFrame:
    """The ``keep`` columns with the counts, ``base_failed``, ``kept`` and the ``clean_text`` without failed lines."""
    keep = [c for c in (documents.columns if keep is None else keep) if c not in RESULT]
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.split(F.col("_text"), "\n")
    worded = bind(lines, lambda x: bind(F.filter(x, lambda line: F.btrim(line, F.lit(SPACES)) != ""), lambda own: F.struct(
        F.size(own).cast("long").alias("n"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("dup"))))
    counted = rows.select(
        "_row",
        bind(_words(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat"))).alias("_w"),
        bind(_drop(F.col("_text"), SPACES), lambda solid: F.struct(
            F.length(solid).cast("long").alias("chars"), (F.length(solid) - F.length(_drop(solid, SYMBOLS))).cast("long").alias("symbols"))).alias("_c"),
        worded.alias("_d"),
        bind(_judge_lines(lines, max_symbols, boilerplate_times), lambda js: F.struct(
            F.size(F.filter(js, lambda j: j["bad"])).cast("long").alias("bad"),
            F.aggregate(js, F.lit(0).cast("long"), lambda a, j: a + F.when(j["bad"], j["chars"]).otherwise(0)).alias("lost"),
            F.array_join(F.transform(F.filter(js, lambda j: ~j["bad"]), lambda j: j["line"]), "\n").alias("text"))).alias("_l"))
    base = (F.col("_w.n") < min_words) | (100 * F.col("_w.repeat") > max_repeat_percent * F.col("_w.n"))
    return counted.select(
        *[F.col("_row").getField(c).alias(c) for c in keep],
        F.col("_w.n").alias("n_words"), F.col("_c.chars").alias("word_chars"), F.col("_c.symbols").alias("n_symbols"),
        F.col("_d.dup").alias("n_dup_lines"), F.col("_w.repeat").alias("n_repeat_words"), base.alias("base_failed"),
        F.col("_d.n").alias("n_lines"), F.col("_l.bad").alias("n_removed_lines"), F.col("_l.lost").alias("removed_chars"),
        (~base & (F.col("_l.lost") <= F.col("_c.chars") * max_loss)).alias("kept"), F.col("_l.text").alias("clean_text"))


def keep_clean(documents: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents kept, without their failed lines; ``length_col``, if there is one, is worked out anew."""
    judged = judge(documents.select(F.struct("*").alias("_row"), F.col(text_col).alias("_body")), "_body", ["_row"]).where("kept")
    changed = {text_col: F.col("clean_text"), length_col: F.length("clean_text").cast("long")}
    return judged.select(*[
        changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in documents.columns])
