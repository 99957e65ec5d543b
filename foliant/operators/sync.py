"""Incremental sync of a document collection against a manifest.

Files are rows ``path, size, mtime_ns`` and a hash or content; the manifest has one
row per path: ``path, size, mtime_ns, hash, algorithm, cached_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name endings of converted files, and size classes.
POSTFIXES = {
    ".txt": "_t", ".md": "_t", ".doc": "_d", ".docx": "_d", ".xls": "_x", ".xlsx": "_x", ".ppt": "_p", ".pptx": "_p",
}
SMALL_BELOW = 100 * 1024
LARGE_ABOVE = 10 * 1024 * 1024
KEEP_DAYS = 30
MANIFEST_KEY = ["path", "size", "mtime_ns", "algorithm"]

# How file types are handled.
CONVERT = [".docx", ".doc", ".pptx", ".ppt", ".odt", ".ods", ".odp", ".rtf", ".html", ".htm"]
SHEETS = [".xlsx", ".xls"]
COPY = [".pdf", ".txt", ".md", ".xml", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".svg", ".zip", ".rar", ".7z"]
OWN_HANDLER = {
    "word": [".docx", ".doc"], "sheet": [".xlsx", ".xls", ".ods"], "slides": [".pptx", ".ppt", ".odp"], "csv": [".csv"],
}


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name with its dot; a leading dot is no suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def file_kind(path: Column, convert_sheets: bool = True, convert_csv: bool = False) -> Column:
    """convert, copy or ignore."""
    convert = CONVERT + (SHEETS if convert_sheets else []) + ([".csv"] if convert_csv else [])
    copy = COPY + ([] if convert_sheets else SHEETS) + ([] if convert_csv else [".csv"])
    ext = extension(path)
    return F.when(ext.isin(convert), "convert").when(ext.isin(copy), "copy").otherwise("ignore")


def content_hash(content: Column, algorithm: Column | str = "md5") -> Column:
    """Hex digest; empty text for an unknown algorithm or content that could not be read."""
    name = F.lower(F.lit(algorithm) if isinstance(algorithm, str) else algorithm)
    digest = (
        F.when(name == "md5", F.md5(content)).when(name == "sha1", F.sha1(content))
        .when(name == "sha256", F.sha2(content, 256)).when(name == "sha512", F.sha2(content, 512))
    )
    return F.coalesce(digest, F.lit(""))


def reuse_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Hash of each file, from the manifest where path, size, time and algorithm agree.

    Bodies are hashed where they are read and dropped before the join: reading a body again,
    or shuffling it to the manifest, costs more than the hash that the manifest would save.
    """
    known = manifest.select(*MANIFEST_KEY, F.col("hash").alias("_cached"))
    narrow = files.withColumn("_own", content_hash(F.col("content"), F.col("algorithm"))).drop("content")
    out = narrow.join(known, MANIFEST_KEY, "left")
    return out.withColumn("reused", F.col("_cached").isNotNull()).withColumn(
        "hash", F.coalesce("_cached", "_own")).drop("_cached", "_own")


def upsert_manifest(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Latest entry per path; combined before the shuffle, so many versions of a path are cheap."""
    rest = [c for c in manifest.columns if c != "path"]
    both = manifest.unionByName(fresh.select(manifest.columns))
    entry = F.struct("cached_at", *[c for c in rest if c != "cached_at"])
    return both.groupBy("path").agg(F.max(entry).alias("e")).select("path", *[F.col(f"e.{c}").alias(c) for c in rest])


def expire(manifest: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    return manifest.where(F.col("cached_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def manifest_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("entries"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))


def with_same_content(files: DataFrame, others: DataFrame) -> DataFrame:
    """Add ``identical`` to files by their counterpart of the same ``path``.

    No counterpart or another size is false before any hash is looked at.
    """
    other = others.select("path", F.col("size").alias("_size"), F.col("hash").alias("_hash"))
    out = files.join(other, "path", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("hash") == F.col("_hash")) & (F.col("hash") != "")
    return out.withColumn("identical", F.coalesce(same, F.lit(False))).drop("_size", "_hash")


def pending(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files that still need work. ``files`` has ``out_path``, ``outputs`` has ``path size hash``.

    A file is skipped only if its output has the same extension, size and hash.
    """
    done = outputs.where(F.col("hash") != "").select(F.col("path").alias("_done"), F.col("size").alias("_size"), F.col("hash").alias("_hash"))
    same_type = extension(F.col("path")) == extension(F.col("out_path"))
    # files of another type than their output are always due: their key is null and finds nothing
    keyed = files.withColumn("_key", F.when(same_type, F.col("out_path")))
    found = (F.col("_key") == F.col("_done")) & (F.col("size") == F.col("_size")) & (F.col("hash") == F.col("_hash"))
    return keyed.join(done, found, "left_anti").drop("_key")


def output_path(path: Column) -> Column:
    """Same folder, suffix .pdf, with the ending of its type before it."""
    endings = F.create_map(*[F.lit(x) for pair in POSTFIXES.items() for x in pair])
    ending = F.coalesce(F.element_at(endings, extension(path)), F.lit(""))
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), ending, F.lit(".pdf"))


def size_class(size: Column) -> Column:
    return F.when(size < SMALL_BELOW, "small").when(size > LARGE_ABOVE, "large").otherwise("medium")


def largest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("size"), "path")


def handler_table(spark: SparkSession, office: bool = True, alternative: bool = True, layout_level: int = 2) -> DataFrame:
    """(ext, handler, priority) in the order in which handlers are tried.

    The office tool excludes its alternative. The layout tool comes first at level 4,
    after the office tool at 2 and 3, last at 1, and not at all at 0.
    """
    rows = []
    for ext in sorted({*CONVERT, *SHEETS, ".csv"}):
        office_like = ext != ".csv"
        order = []
        if office_like and layout_level >= 4:
            order.append("layout")
        if office_like and (office or alternative):
            order.append("office" if office else "alternative")
        if office_like and layout_level in (2, 3):
            order.append("layout")
        order += [h for h, exts in OWN_HANDLER.items() if ext in exts]
        if office_like and layout_level == 1:
            order.append("layout")
        rows += [(ext, h, i) for i, h in enumerate(order)]
    return spark.createDataFrame(rows, "ext string, handler string, priority int")


def route(files: DataFrame, handlers: DataFrame) -> DataFrame:
    """Ordered handlers per file. The handler table has a few dozen fixed rows."""
    lists = handlers.groupBy("ext").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("priority", "handler"))), lambda h: h["handler"]).alias("handlers"))
    return files.withColumn("ext", extension(F.col("path"))).join(F.broadcast(lists), "ext", "left")


def first_success(attempts: DataFrame) -> DataFrame:
    """Handler of the first successful attempt per path; null when all failed."""
    won = F.when(F.col("success"), F.struct("priority", "handler"))
    return attempts.groupBy("path").agg(F.min(won).alias("w")).select("path", F.col("w.handler").alias("handler"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of a run. The failed files are a table of their own, see :func:`failed_files`."""
    ok = F.col("success")
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok & (F.col("op") == "convert")).alias("converted"),
        F.count_if(ok & (F.col("op") == "copy")).alias("copied"), F.count_if(~ok).alias("failed"))


def failed_files(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(~F.col("success")).select("path", "op")
