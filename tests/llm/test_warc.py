import base64
import gzip
import hashlib
import os
import uuid

import pytest

from foliant.llm import warc
from foliant.session import shared_folder

PAGES = [
    (3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, None), (4, "http://a/4", ""), (5, "http://a/5\r\nX: y", "é日\r\n\r\nbody"),
    (None, "http://a/n", "same"), (6, "http://a/6", "x" * 200_000), (7, "http://a/7", "twice"), (7, "http://a/7", "twice"), (8, "http://b/8", "WARC/1.1\r\n\r\n"),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, shard string, kind int")


def folder(spark):
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def want(rows, min_bytes=0):
    out, first, seen = [], {}, set()
    for i, url, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, url, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = len(raw) >= min_bytes and (i != first[html or ""] or (i, html) in seen)
        seen.add((i, html))
        out.append((i, len(raw), digest, "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
@pytest.mark.parametrize("shard_bytes,roll_bytes", [(1 << 30, 1 << 28), (2000, 1), (500, 600)])
def test_round_trip(spark, min_bytes, shard_bytes, roll_bytes):
    at = folder(spark)
    warc.write_warc(table(spark), at, min_bytes=min_bytes, shard_bytes=shard_bytes, roll_bytes=roll_bytes)
    back = warc.read_warc(spark, at, with_payload=True)
    assert got(back) == want(PAGES, min_bytes)
    held = {r["page_id"]: bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()}
    assert held[5] == "é日\r\n\r\nbody".encode() and len(held[6]) == 200_000


def files(at):
    top = at.removeprefix("file:")
    return {f: open(f"{top}/{f}", "rb").read() for f in os.listdir(top) if f.endswith(".warc.gz")}


def test_files_do_not_depend_on_partitions(spark):
    one, two = folder(spark), folder(spark)
    warc.write_warc(table(spark).coalesce(1), one, shard_bytes=3000, roll_bytes=500)
    warc.write_warc(table(spark, PAGES[::-1]).repartition(7), two, shard_bytes=3000, roll_bytes=500)
    assert files(one) == files(two) and len(files(one)) > 2
    for raw in files(one).values():
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_manifest_lists_what_is_there(spark):
    at = folder(spark)
    manifest = warc.write_warc(table(spark), at, roll_bytes=500)
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in manifest.collect()} == {
        f: (len(raw), hashlib.sha256(raw).hexdigest()) for f, raw in files(at).items()}


def test_naming_again_is_harmless(spark):
    at = folder(spark)
    manifest = warc.write_warc(table(spark), at)
    manifest.mapInArrow(warc._name_files(at), warc._MANIFEST).count()
    assert got(warc.read_warc(spark, at)) == want(PAGES)


def test_heavy_id_is_cut(spark):
    rows = [(9, f"http://a/{k}", f"page {k} " * 50) for k in range(60)] + [(1, "u", "v"), (100, "u", "w")]
    at = folder(spark)
    manifest = warc.write_warc(table(spark, rows), at, shard_bytes=8000)
    assert manifest.select("shard").distinct().count() > 4
    assert got(warc.read_warc(spark, at)) == want(rows)


def test_empty_table(spark):
    at = folder(spark)
    warc.write_warc(table(spark).limit(0), at)
    assert warc.read_warc(spark, at).count() == 0
