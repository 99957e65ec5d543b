"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by (id, payload digest, url) and cut into shards at exact byte totals: a
histogram of the ids, refined where a bin is heavy, gives the borders, so they depend on the
rows alone and not on how Spark happened to partition them. An id that alone outweighs a
shard is cut further by the digest. A shard is written in order, into files that are rolled
when their compressed size reaches ``roll_bytes``; each record is a gzip member of its own,
with headers, record ids and digests worked out anew, and no clock or random number in them.

Of records with equal payloads of at least ``min_bytes`` bytes, the first by (id, url) is a
response and the others revisit it; smaller payloads are all responses. The decision is made
on narrow rows and meets its record by sorting into the same place, so payloads are shuffled
once.

Tasks write under a temporary name of their own attempt. The rows of the tasks that
succeeded list these files; a second job gives the files their names, which can be repeated
safely, and then the manifest is written. Readers open only what the manifest lists. Files
are opened by pyarrow's file systems, so the folder can be any shared store.

Cases: a null payload is empty (0 bytes); null ids sort first, and lose against any other id
where payloads are equal; of fully equal rows one is the response; a null URL has no target
header; line breaks in URLs are percent-encoded. An empty table gives an empty manifest.
Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "name string, temporary string, shard int, sequence int, records long, bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
#: Bytes of headers that a record is reckoned to have beside its payload.
_HEADERS = 700


def _open(folder: str):
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def _size(payload: Column) -> Column:
    return F.octet_length(payload).cast("long") + F.lit(_HEADERS)


def shard_borders(rows: DataFrame, shard_bytes: int) -> tuple[list[int], dict[int, int]]:
    """Ids at which a new shard begins, and the number of parts of each id that outweighs a shard.

    ``rows`` has ``id`` and ``size``. At most 4096 bins a shard and round reach the driver.
    """
    whole = rows.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    low, high, total = whole
    if low is None or total <= shard_bytes:
        return [], {}
    bins = {(low, high - low + 1): total}
    leaves: list[tuple[int, int, int]] = []
    while bins:
        heavy = sorted(b for b, size in bins.items() if size > shard_bytes // 16 and b[1] > 1)
        leaves += [(b[0], b[1], size) for b, size in bins.items() if not (size > shard_bytes // 16 and b[1] > 1)]
        if not heavy:
            break
        starts = np.array([b[0] for b in heavy], dtype=object)
        step = -(-max(b[1] for b in heavy) // 256)

        @F.pandas_udf("long")
        def bin_of(ids: pd.Series) -> pd.Series:
            values = ids.to_numpy(np.int64)
            at = np.searchsorted(starts.astype(np.int64), values, "right") - 1
            base = starts.astype(np.int64)[np.maximum(at, 0)]
            width = np.array([b[1] for b in heavy], np.int64)[np.maximum(at, 0)]
            inside = (at >= 0) & (values - base < width)
            return pd.Series(np.where(inside, base + (values - base) // step * step, -1)).where(inside).astype("Int64")

        counted = rows.where(F.col("id").isNotNull()).select(bin_of("id").alias("bin"), "size").where(F.col("bin").isNotNull())
        ends = {b[0]: b[0] + b[1] for b in heavy}
        order = sorted(ends)
        bins = {}
        for r in counted.groupBy("bin").agg(F.sum("size").alias("size")).collect():
            parent = order[int(np.searchsorted(np.array(order, np.int64), r["bin"], "right")) - 1]
            bins[(r["bin"], min(step, ends[parent] - r["bin"]))] = r["size"]
    borders, filled, parts = [], 0, {}
    for first, width, size in sorted(leaves):
        if filled and filled + size > shard_bytes:
            borders.append(first)
            filled = 0
        filled += size
        if width == 1 and size > 2 * shard_bytes:
            parts[first] = -(-size // shard_bytes)
    return borders, parts


def _shard_of(borders: list[int], parts: dict[int, int]) -> Column:
    """Shard number; the parts of a heavy id follow each other."""
    cuts = np.array(borders, np.int64)
    ids = np.array(sorted(parts), np.int64)
    many = np.array([parts[i] for i in sorted(parts)], np.int64)
    before = np.concatenate([[0], np.cumsum(many - 1)]).astype(np.int64)

    @F.pandas_udf("int")
    def shard(key: pd.Series, digest: pd.Series) -> pd.Series:
        value = key.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
        out = np.searchsorted(cuts, value, "right") + before[np.searchsorted(ids, value, "left")]
        if len(ids):
            at = np.minimum(np.searchsorted(ids, value), len(ids) - 1)
            own = ids[at] == value
            lead = digest.str.slice(0, 6).map(lambda x: int(x, 16)).to_numpy(np.int64)
            out = out + np.where(own, lead * many[at] >> 24, 0)
        return pd.Series(out.astype(np.int32))

    return shard(F.col("id"), F.col("sha1"))


def _record(page: int | None, url: str | None, payload: bytes, sha1: str, bytes_: int, kind: str, first: tuple, copy: int, date: str) -> bytes:
    def urn(i, u, n) -> str:
        return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{i}|{u}|{sha1}|{n}')}>"

    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {bytes_}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page, url, copy)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(*first, 0)}"]
        if first[0] is not None:
            head.append(f"X-Refers-To-Page: {first[0]}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """The files that one task attempt writes, under names of its own."""

    def __init__(self, folder: str, prefix: str, roll_bytes: int):
        self.store, self.top = _open(folder)
        self.own = f"{self.top}/_temporary/{uuid.uuid4().hex}"
        self.prefix, self.roll_bytes = prefix, roll_bytes
        self.out = None
        self.shard, self.sequence = None, 0
        self.done: list[tuple] = []

    def add(self, shard: int, data: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.roll_bytes):
            self.close()
        if self.out is None:
            self.sequence = self.sequence + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sum = shard, 0, 0, hashlib.sha256()
            self.name = f"{self.prefix}-{shard:06d}-{self.sequence:05d}.warc.gz"
            self.store.create_dir(self.own, recursive=True)
            self.out = self.store.open_output_stream(f"{self.own}/{self.name}", compression=None)
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, f"{self.own}/{self.name}", self.shard, self.sequence, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def _rows(batch: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in batch], t) for i, t in enumerate(types)], names=names)


def _write(folder: str, prefix: str, roll_bytes: int, min_bytes: int, date: str, level: int):
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, prefix, roll_bytes)
        key, first, copy = None, None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "id", "sha1", "url", "kind", "payload", "n", "first_id", "first_url")]
            for i in range(batch.num_rows):
                shard, page, sha1, url, kind, payload, n, first_id, first_url = (c[i].as_py() for c in cols)
                if kind == 0:
                    first = first_id, first_url
                    continue
                copy = copy + 1 if key == (page, sha1, url) else 0
                key = page, sha1, url
                again = n >= min_bytes and (copy > 0 or (page, url) != first)
                raw = _record(page, url, b"" if again else payload.encode(), sha1, n, "revisit" if again else "response", first, copy, date)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                files.add(shard, pack.compress(raw) + pack.flush())
                if len(files.done) >= 100:
                    yield _rows(files.done, names, types)
                    files.done = []
        files.close()
        if files.done:
            yield _rows(files.done, names, types)

    return run


def _name_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist()):
                if store.get_file_info(temporary).type == fs.FileType.File:
                    store.move(temporary, f"{top}/{name}")
                elif store.get_file_info(f"{top}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(name)
            yield batch

    return run


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    shard_bytes: int = 1 << 30,
    roll_bytes: int = 256 << 20,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 6,
    prefix: str = "records",
) -> DataFrame:
    """Write the archives of ``pages`` under ``folder``, a new folder of a shared store; returns the manifest."""
    spark = pages.sparkSession
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    shard = _shard_of(*shard_borders(base.select("id", _size(F.col("payload")).alias("size")), shard_bytes))
    narrow = base.select("id", "url", "sha1", "n")
    first = narrow.groupBy("sha1").agg(F.min(F.struct(
        F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"))).alias("f"))
    decided = narrow.distinct().join(first, "sha1").select(
        "id", "url", "sha1", "n", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("payload"),
        F.col("f.id").alias("first_id"), F.col("f.url").alias("first_url"))
    records = base.select("id", "url", "sha1", "n", F.lit(1).alias("kind"), "payload",
                          F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    both = decided.unionByName(records).withColumn("shard", shard)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = both.repartition(n, "shard").sortWithinPartitions("shard", "id", "sha1", "url", "kind")
    placed.mapInArrow(_write(folder, prefix, roll_bytes, min_bytes, date, level), _MANIFEST).write.parquet(f"{folder}/_written")
    written = spark.read.schema(_MANIFEST).parquet(f"{folder}/_written")
    written.mapInArrow(_name_files(folder), _MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one record each."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            return
        out.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(out)
            rest, unpack, out = unpack.unused_data, zlib.decompressobj(31), []


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (lower-case names), HTTP header and payload of one record; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    if rest[len(block):] != b"\r\n\r\n" or lines[0] != "WARC/1.1":
        raise ValueError("broken record")
    if fields["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _read(folder: str, with_payload: bool):
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    if with_payload:
        names, types = [*names, "payload"], [*types, pa.binary()]

    def one(raw: bytes, name: str) -> tuple:
        fields, http, payload = parse_record(raw)
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError("payload digest differs")
        page, other = fields.get("x-page-id"), fields.get("x-refers-to-page")
        row = (page and int(page), fields.get("warc-target-uri"), size, digest, kind, other and int(other), name)
        return (*row, payload if kind == "response" else None) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                held: list[tuple] = []
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        held.append(one(raw, name))
                        if len(held) >= (50 if with_payload else 2000):
                            yield _rows(held, names, types)
                            held = []
                if held:
                    yield _rows(held, names, types)

    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """All records of the files that the manifest of ``folder`` lists."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest").select("name")
    files = max(1, min(10_000, manifest.count()))
    schema = _RECORDS + (", payload binary" if with_payload else "")
    return manifest.repartition(files, "name").mapInArrow(_read(folder, with_payload), schema)
