"""Structure report of a tree of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.arrays import bind
from foliant.functions.text import SPACES
from foliant.operators.sync import extension

# Folders left out, line breaks, texts of the summary.
EXCLUDED = ["__pycache__", ".git", "logs", "node_modules"]
LINE_BREAK = "(?:\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029])"
EMPTY_TEXT = "(empty or binary file)"
SUMMARY_CHARS = 250


def not_excluded(path: Column, names: list[str] = EXCLUDED) -> Column:
    """No part of the path is an excluded name, so whole subtrees fall away."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(True)


def tree_links(files: DataFrame) -> DataFrame:
    """Distinct (parent, name, kind) for every file and every folder above it."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")

    def links(ps: Column) -> Column:
        return F.transform(ps, lambda name, i: F.struct(
            F.when(i == 0, ".").otherwise(F.array_join(F.slice(ps, 1, i), "/")).alias("parent"),
            name.alias("name"),
            F.when(i == F.size(ps) - 1, "file").otherwise("folder").alias("kind")))

    rows = files.select(F.explode_outer(bind(parts, links)).alias("l")).where("l IS NOT NULL").select("l.*")
    return rows.distinct()


def folder_sentence(n_files: Column, n_folders: Column) -> Column:
    def counted(n: Column, word: str) -> Column:
        return F.when(n == 1, f"1 {word}").when(n > 1, F.concat(n.cast("string"), F.lit(f" {word}s")))

    text = F.concat_ws(" and ", counted(n_files, "file"), counted(n_folders, "subfolder"))
    return F.when(text == "", "Empty folder").otherwise(F.concat(F.lit("Contains "), text))


def folders(files: DataFrame) -> DataFrame:
    """One entry per folder: direct files and direct subfolders."""
    counts = tree_links(files).groupBy(F.col("parent").alias("path")).agg(
        F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if(F.col("kind") == "folder").alias("n_folders"))
    return counts.withColumn("summary", folder_sentence(F.col("n_files"), F.col("n_folders")))


def summarized(path: Column, extensions: list[str]) -> Column:
    return extension(path).isin([e.lower() for e in extensions]) if extensions else F.lit(True)


def skipped_text(path: Column) -> Column:
    ext = extension(path)
    return F.concat(F.lit("Summary skipped for extension "), F.when(ext == "", "<no extension>").otherwise(ext))


def placeholder_summary(text: Column, max_chars: int = SUMMARY_CHARS) -> Column:
    """The beginning of the text on one line."""
    one_line = F.regexp_replace(F.regexp_replace(text, LINE_BREAK + r"\z", ""), LINE_BREAK, " ")
    return bind(one_line, lambda t: F.when(t == "", EMPTY_TEXT).when(F.length(t) <= max_chars, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, max_chars), F.lit(SPACES)), F.lit(" ..."))))


def truncate_bytes(text: Column, max_bytes: int) -> Column:
    """At most ``max_bytes`` of UTF-8, without a broken character at the end."""
    raw = F.encode(text, "UTF-8")

    def cut(data: Column) -> Column:
        inside = lambda back: F.hex(F.substring(data, max_bytes - back + 1, 1)).rlike("^[89AB]")
        keep = F.when(~inside(0), max_bytes).when(~inside(1), max_bytes - 1).when(~inside(2), max_bytes - 2).otherwise(max_bytes - 3)
        return F.substring(data, F.lit(1), F.greatest(keep, F.lit(0))).cast("string")

    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(bind(raw, cut))


def summarize(files: DataFrame, extensions: list[str], max_bytes: int | None = None, max_prompt: int | None = None,
              max_chars: int = SUMMARY_CHARS, primary: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Add ``summary`` to rows of ``path, text``.

    ``primary`` maps path and text columns to a summary, for example a pandas UDF;
    the placeholder stands in where it gives null or nothing.
    """
    text = F.coalesce("text", F.lit(""))
    if max_bytes is not None:
        text = truncate_bytes(text, max_bytes)
    if max_prompt is not None:
        text = F.substring(text, 1, max_prompt)
    plain = placeholder_summary(text, max_chars)
    best = plain if primary is None else F.coalesce(F.nullif(primary(F.col("path"), text), F.lit("")), plain)
    return files.withColumn(
        "summary", F.when(summarized(F.col("path"), extensions), best).otherwise(skipped_text(F.col("path"))))


def entries(files: DataFrame) -> DataFrame:
    """Folder and file entries of a tree from files with ``path, size, summary``."""
    f = files.select("path", F.lit("file").alias("kind"), F.col("size").cast("bigint").alias("size"), "summary")
    d = folders(files).select("path", F.lit("folder").alias("kind"), F.lit(None).cast("bigint").alias("size"), "summary")
    return d.unionByName(f)


def walk_order(rows: DataFrame) -> DataFrame:
    """Folders in lexical order of their parts, each before its own files."""
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    home = F.when(F.col("kind") == "folder", parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    return rows.orderBy(home, F.when(F.col("kind") == "folder", 0).otherwise(1), "path")


def display_path(path: Column) -> Column:
    return F.when(path == ".", "./").when(path.startswith("./"), path).otherwise(F.concat(F.lit("./"), path))


def json_fields(rows: DataFrame) -> DataFrame:
    """path, kind, size and summary as text, ready for a JSON sink."""
    return rows.select(
        display_path(F.col("path")).alias("path"), "kind", F.coalesce(F.col("size").cast("string"), F.lit("")).alias("size"),
        F.replace(F.coalesce("summary", F.lit("")), F.lit("\n"), F.lit(" ")).alias("summary"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """One markdown table line per entry."""
    text = F.replace(F.replace(F.coalesce("summary", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), display_path(F.col("path")), F.lit(" | "), F.col("kind"), F.lit(" | "),
                    F.coalesce(F.col("size").cast("string"), F.lit("")), F.lit(" | "), text, F.lit(" |"))
    return rows.select(*rows.columns, line.alias("line"))
