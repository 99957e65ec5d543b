"""Running a stream over what is there now, into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foliant.session import shared_folder


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the files of one given table, which is a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A file stream takes its path for a folder, unless the path is a pattern.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Run until the input is used up and return what came out.

    In update mode ``keys`` name a result row, and its last state is returned.
    """
    home = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    run_once(stream, home, mode)
    return _came_out(stream, home, keys)


def drain_slices(slices: list[DataFrame], work: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Let the slices arrive one after the other and return what ``work`` made of the stream.

    Each slice is written by all its tasks. The query is started anew for every slice and goes on from its
    checkpoint, so a slice is one batch however many files it has, and each restart is a recovery.
    """
    spark = slices[0].sparkSession
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = None
    for part in slices:
        part.write.mode("append").parquet(f"{home}/arrived")
        stream = work(spark.readStream.schema(slices[0].schema).parquet(f"{home}/arrived"))
        run_once(stream, home, mode)
    return _came_out(stream, home, keys)


def run_once(stream: DataFrame, home: str, mode: str) -> None:
    """Work off what is there now into ``home``/rows, going on from the checkpoint in ``home``."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(save)
             .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def _came_out(stream: DataFrame, home: str, keys: list[str] | None) -> DataFrame:
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{home}/rows")
    if not keys:
        return rows.drop("batch")
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values if c != "batch"])
