"""Writing chunks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.report import json_fields, markdown_rows, walk_order


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Chunks as Parquet, in folders by a hash of the chunk id, ready for a loader.

    The id spreads evenly, so a source that holds most chunks does not make one big folder.
    There are as many writers as shuffle partitions, whatever the number of buckets: each
    bucket is dealt over enough of them, and each writer holds few buckets.
    """
    lot = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")
    writers = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(-(-writers // buckets))).cast("int")
    rows = chunks.withColumns({"bucket": lot, "_deal": deal})
    rows.repartition(writers, "bucket", "_deal").drop("_deal").write.mode(mode).partitionBy("bucket").parquet(path)


def write_entries_json(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_fields(walk_order(entries)).write.mode(mode).json(path)


def write_markdown(entries: DataFrame, path: str, title: str, source: str, mode: str = "overwrite") -> None:
    """A markdown table in ordered text files; the heading comes first."""
    heading = [f"# Structure map for `{title}`", "", f"_Generated from {source}._", "",
               "| Path | Type | Size | Summary |", "| --- | --- | --- | --- |"]
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    home = F.when(F.col("kind") == "folder", parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    lines = markdown_rows(entries).select(
        F.lit(1).alias("a"), home.alias("b"), F.when(F.col("kind") == "folder", 0).otherwise(1).alias("c"), F.col("path").alias("d"),
        F.col("line").alias("value"))
    first = entries.sparkSession.createDataFrame([(0, [], i, "", t) for i, t in enumerate(heading)], lines.schema)
    first.unionByName(lines).orderBy("a", "b", "c", "d").select("value").write.mode(mode).text(path)
