"""A table of rows by key that is updated in place, part by part.

Rows lie in ``parts`` hash parts of their key. An upsert reads and rewrites only the parts that its
rows fall into; all other parts keep their files. What the table consists of is said by the newest
commit: a small file that names the folder of each part. New folders are written first, then the
commit under a temporary name, then it gets its own name; so a job that dies leaves the table as it
was, with some folders that no commit names. An upsert carries a batch name, and one that is among
the last ``BATCHES`` committed does nothing, so a job may run again. One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


BATCHES = 1000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+://", path) else re.sub(r"^(file:)?/+", "file:///", path))


@dataclass(frozen=True)
class Commit:
    number: int
    keys: list[str]
    parts: int
    schema: str  # as JSON
    folders: dict[str, str]  # part -> folder below the table
    batches: list[str]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], parts: int = 64) -> KeyedTable:
        table = cls(spark, path)
        table._write(Commit(0, keys, parts, schema.json(), {}, []))
        return table

    def newest(self) -> Commit:
        store, place = _store(f"{self.path}/commits")
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(place)) if re.fullmatch(r"\d+\.json", f.base_name)]
        with store.open_input_stream(f"{place}/{max(names)}") as f:
            return Commit(**json.loads(f.read()))

    def _write(self, commit: Commit) -> None:
        store, place = _store(f"{self.path}/commits")
        store.create_dir(place, recursive=True)
        own = f"{place}/{commit.number:010d}.json"
        if store.get_file_info(own).type != fs.FileType.NotFound:
            raise RuntimeError(f"another writer made commit {commit.number}")
        made = f"{place}/tmp-{uuid.uuid4().hex}"
        with store.open_output_stream(made) as f:
            f.write(json.dumps(commit.__dict__).encode())
        store.move(made, own)

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The table, or some of its parts, as of the newest commit."""
        now = self.newest()
        schema = StructType.fromJson(json.loads(now.schema))
        wanted = [f for p, f in now.folders.items() if parts is None or int(p) in parts]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(wanted)])

    def _part(self, now: Commit):
        return F.pmod(F.xxhash64(*now.keys), F.lit(now.parts)).cast("int")

    def upsert(self, rows: DataFrame, order: list[str], batch: str) -> list[int]:
        """Put rows in the place of those with equal keys and return the parts that were rewritten.

        Of several rows of one key, old ones included, the one that is last by ``order`` stays, the new one in a tie; so the
        rows' order of arrival does not matter. Rows with a null key are a key of their own.
        """
        now = self.newest()
        if batch in now.batches:
            return []
        schema = StructType.fromJson(json.loads(now.schema))
        fresh = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        touched = sorted(r[0] for r in fresh.select(self._part(now).alias("p")).distinct().collect())  # at most one row a part
        if not touched:
            return []
        old = self.read(touched)
        both = fresh.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        values = [f.name for f in schema.fields if f.name not in now.keys]
        last = F.max_by(F.struct(*values), F.struct(*order, "_new", *[v for v in values if v not in order]))
        merged = both.groupBy(*now.keys).agg(last.alias("_v")).select(*now.keys, "_v.*").select(*schema.names)
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn("part", self._part(now)).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        folders = now.folders | {str(p): f"{folder}/part={p}" for p in touched}
        self._write(Commit(now.number + 1, now.keys, now.parts, now.schema, folders, [*now.batches, batch][-BATCHES:]))
        return touched
