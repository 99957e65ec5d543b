"""Session helpers: configuration, the shared checkpoint folder, table loading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "foliant", master: str = "local[8]", shuffle: int = 8) -> SparkSession:
    """A session for local tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


#: Lists of the tables stored in the open ``scratch`` blocks.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Remove the tables that operators store inside the block when it ends.

    For a job that has written its result by then; a frame made inside must not be read after.
    """
    held: list[str] = []
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH.remove(held)
        for path in held:
            store, place = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            if store.get_file_info(place).type == fs.FileType.Directory:
                store.delete_dir(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back from there.

    Used where a plan is consumed more than once and must not be recomputed
    differently after an executor is lost. The rows are worked out once; a reliable
    checkpoint() would work them out a second time to write them.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for held in _SCRATCH:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out an input of fewer splits than cores.

    Text work is heavy per row, and a file of one row group would run as one task. An input
    of many splits is left alone, whatever its size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
