"""Files as tables: inventory, plain and office texts, CSV."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliant.operators.report import truncate_bytes
from foliant.operators.sync import extension

# The members of an office archive that hold text.
ARCHIVE_TEXT = {
    ".docx": [("word/", ".xml")],
    ".pptx": [("ppt/", ".xml")],
    ".xlsx": [("xl/worksheets/", ".xml"), ("xl/sharedstrings.xml", ".xml")],
}


def file_inventory(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path, size, mtime and ext of all files below ``root``. File content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows.withColumn("ext", extension(F.col("path")))
    return rows.where(F.col("ext").isin([e.lower() for e in extensions])) if extensions else rows


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path and content of all files below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), "content")


def _archive_text(content: bytes, wanted: list[tuple[str, str]]) -> str:
    """Texts of the XML members, one line per member; empty when it is no archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return ""
    lines = []
    with archive:
        for name in archive.namelist():
            if not any(name.lower().startswith(head) and name.lower().endswith(tail) for head, tail in wanted):
                continue
            try:
                root = ElementTree.fromstring(archive.read(name))
            except (ElementTree.ParseError, KeyError, OSError, zipfile.BadZipFile):
                continue
            words = [e.text.strip() for e in root.iter() if e.text and e.text.strip()]
            if words:
                lines.append(" ".join(words))
    return "\n".join(lines)


@F.pandas_udf(StringType())
def _office_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for kinds, contents in batches:
        yield pd.Series([
            (_archive_text(c, ARCHIVE_TEXT[k]) if k in ARCHIVE_TEXT else "") or (c or b"").decode("utf-8", "ignore")
            for k, c in zip(kinds, contents)
        ])


@F.pandas_udf(StringType())
def _lenient(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def utf8(raw: Column) -> Column:
    """Bytes as text; those that are no UTF-8 are left out, written replacement characters stay."""
    valid = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(valid, _lenient(F.when(valid.isNull(), raw)))


def file_text(path: Column, content: Column) -> Column:
    """Text of a file: office archives by their XML, all else, and archives without text, as UTF-8.

    Bytes that are no UTF-8 are left out. Only archives and texts with such bytes go to Python.
    """
    kind = extension(path)
    archive = kind.isin(*ARCHIVE_TEXT)
    return F.when(archive, _office_text(kind, F.when(archive, content))).otherwise(utf8(content))


def read_texts(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    rows = read_files(spark, root)
    out = rows.select("path", "size", file_text(F.col("path"), F.col("content")).alias("text"))
    return out if max_bytes is None else out.withColumn("text", truncate_bytes(F.col("text"), max_bytes))


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True, rest: str = "_record") -> DataFrame:
    """Text columns named by the first row, as a reader of quoted CSV sees them.

    Doubled quotes, commas and line breaks inside quotes belong to the value; an empty or
    missing cell is an empty text, and bytes that are no UTF-8 are left out. A row with more or fewer cells than the header keeps its
    whole text in the column ``rest``, so that nothing is lost; it is null in other rows. A
    file that may have line breaks in quotes is read by one task: pass ``line_breaks=False``
    for large files known to have none.
    """
    options = {"header": True, "multiLine": line_breaks, "escape": '"', "quote": '"', "mode": "PERMISSIVE", "enforceSchema": True,
               "columnNameOfCorruptRecord": rest, "encoding": "ISO-8859-1"}  # bytes come through as they are
    names = spark.read.options(**options).csv(path).columns
    fields = StructType([StructField(c, StringType()) for c in [*names, rest]])
    rows = spark.read.options(**options).schema(fields).csv(path)
    text = lambda c: utf8(F.encode(F.col(f"`{c}`"), "ISO-8859-1"))
    return rows.select(
        *[F.coalesce(text(c), F.lit("")).alias(c.encode("latin-1").decode("utf-8", "ignore")) for c in names], text(rest).alias(rest))
