"""The source of growing logs: every line once, whatever the cuts, appends and restarts."""

import random

import pytest

from foliant.sources import line_log
from foliant.streaming import run


def write(path, data, mode="wb"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_line_once(spark, tmp_path, split):
    rng = random.Random(split)
    lines = {}
    for name in ("a.log", "sub/b.log", "c.log"):
        rows = ["".join(rng.choice("xyÿ ") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(12)]
        end = rng.choice(["", "\n"])
        write(tmp_path / name, ("\n".join(rows) + end).encode())
        lines[name] = rows if rows[-1] or end else rows[:-1]
    write(tmp_path / "_hidden", b"no\n")
    write(tmp_path / "empty.log", b"")
    got = line_log.read_lines(spark, str(tmp_path), split=split).collect()
    for name, rows in lines.items():
        own = sorted((r["at"], r["value"]) for r in got if r["file"].endswith(f"/{name}"))
        assert [v for _, v in own] == rows
    assert len(got) == sum(map(len, lines.values()))


def test_filters_reach_the_source(spark, tmp_path):
    write(tmp_path / "a.log", b"one\ntwo\n")
    write(tmp_path / "b.log", b"one\nbad \xff bytes\r\n")
    rows = line_log.read_lines(spark, str(tmp_path))
    name = [r["file"] for r in rows.select("file").distinct().collect() if r["file"].endswith("b.log")][0]
    assert [r["value"] for r in rows.where(rows["file"] == name).where("value LIKE '%bytes%'").collect()] == ["bad � bytes"]
    assert rows.where("value LIKE '%one%' AND at = 0").count() == 2


def test_appended_lines_and_restarts(spark, tmp_path):
    log, home = tmp_path / "in", str(tmp_path / "out")

    def go():
        run.run_once(line_log.read_lines(spark, str(log), stream=True, split=5), home, "append")
        return sorted(r["value"] for r in spark.read.parquet(f"{home}/rows").collect())

    write(log / "a.log", b"first\nsecond\nhalf")
    assert go() == ["first", "second"]
    write(log / "a.log", b" done\nthird\n", "ab")
    write(log / "b.log", b"other\n")
    assert go() == ["first", "half done", "other", "second", "third"]
    assert go() == ["first", "half done", "other", "second", "third"]
    write(log / "b.log", b"new\n")
    assert go() == ["first", "half done", "new", "other", "second", "third"]
