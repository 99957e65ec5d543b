"""The guard on keyed state against its batch form, sessions against plain gaps."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from foliant.operators import responses as R
from foliant.session import shared_folder
from foliant.streaming import ordered_guard, rates, run

RULES = ["bad", "worse thing"]
DELTAS = "response_id string, seq long, text string, done boolean, error string"


def some(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randint(1, 12)
        for s in range(size):
            text = rng.choice(["some words ", "x" * 30, "b", "ad", "bad ", "worse ", "thing", None, ""])
            rows.append((f"r{i}", s, text, s == size - 1 and i % 5 != 0, "upstream" if i % 7 == 0 and s == 3 else None))
    return rows


@pytest.mark.parametrize("hold,inclusive", [(False, False), (True, True)])
def test_shuffled_deltas_equal_the_batch_form(spark, hold, inclusive):
    rows = some(3, 40)
    rows = [r for r in rows if r[0] not in {f"r{i}" for i in range(0, 40, 5)} or r[4]] + [(f"r{i}", 0, "open", True, None) for i in range(0, 40, 5) if i % 7]
    rows = [r for r in rows if not (r[0] in {f"r{i}" for i in range(0, 40, 35)} and not r[4])]
    rows = [r for r in rows if not (r[4] and (r[0], 0) not in {(q[0], q[1]) for q in rows})]
    frame = spark.createDataFrame(rows, DELTAS)
    want = R.guard_deltas(frame, F.lower("text").rlike("|".join(RULES)), limit=40, inclusive=inclusive, hold=hold)
    rng = random.Random(9)
    lots = [rng.randrange(4) for _ in rows]
    slices = [spark.createDataFrame([r for r, lot in zip([*rows, *rows[:20]], [*lots, *[3] * 20]) if lot == i], DELTAS) for i in range(4)]
    got = run.drain_slices(slices, lambda s: ordered_guard.guard_any_order(s, RULES, limit=40, inclusive=inclusive, hold=hold, idle_ms=None))

    def plain(df):
        if not hold:
            return sorted((r["response_id"], r["seq"], r["kind"], r["text"] or "") for r in df.collect())
        out = {}
        for r in df.orderBy("response_id", "seq").collect():  # the stream passes a held buffer on in one piece
            out.setdefault(r["response_id"], []).append(r["text"] if r["kind"] == "delta" else f"<{r['kind']}>")
        return {k: "".join(t or "" for t in v) for k, v in out.items() if any(v)}

    if not hold:
        assert plain(got) == plain(want)
    else:  # a buffer that an error breaks off is passed on by the batch form and held for ever by the stream
        whole = {r[0] for r in rows} - {r[0] for r in rows if r[4]}
        a, b = plain(got), plain(want)
        assert {k: v for k, v in a.items() if k in whole} == {k: v for k, v in b.items() if k in whole}


def test_idle_responses_are_scanned_and_forgotten(spark):
    home = f"{shared_folder(spark)}/timer-{uuid.uuid4().hex}"
    rows = [("gap", 0, "fine ", False, None), ("gap", 2, "later ", False, None), ("rest", 0, "so bad", False, None)]
    spark.createDataFrame(rows, DELTAS).write.parquet(f"{home}/in")
    stream = ordered_guard.guard_any_order(spark.readStream.schema(DELTAS).parquet(f"{home}/in"), RULES, idle_ms=500)
    name = f"timer_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{home}/check").trigger(processingTime="1 second").start()
    try:
        want = {("gap", 0, "delta"), ("gap", 2, "delta"), ("rest", 0, "delta"), ("rest", 0, "blocked")}
        until = time.time() + 60
        got = set()
        while got != want and time.time() < until:
            time.sleep(1)
            got = {(r["response_id"], r["seq"], r["kind"]) for r in spark.table(name).collect()}
        assert got == want
    finally:
        query.stop()


def test_sessions_bridge_and_hot_key(spark):
    rng = random.Random(2)
    times = [("hot", rng.randrange(0, 200_000)) for _ in range(900)] + [(f"u{i % 9}", rng.randrange(0, 100_000)) for i in range(200)]
    rows = spark.createDataFrame([(u, t, 200) for u, t in times], "user_id string, s long, status int").select("user_id", F.timestamp_seconds("s").alias("ts"), "status")
    want = []
    for user in {u for u, _ in times}:
        held = None
        for t in sorted(t for u, t in times if u == user):
            if held and t < held[1]:
                held[1], held[2] = t + 300, held[2] + 1
            else:
                if held:
                    want.append((user, *held))
                held = [t, t + 300, 1]
        want.append((user, *held))
    shown = lambda df: sorted((r["user_id"], r["a"], r["b"], r["requests"]) for r in df.select(
        "user_id", F.unix_seconds("session_start").alias("a"), F.unix_seconds("session_end").alias("b"), "requests").collect())
    assert shown(rates.sessions(rows, "ts", ["user_id"], "300 seconds")) == sorted(want)
    # every second row comes a batch later: sessions of the first batch are joined by it
    slices = [rows.where(F.pmod(F.unix_seconds("ts"), F.lit(2)) == i) for i in range(2)]
    end = spark.createDataFrame([("end", 10**7, 200)], "user_id string, s long, status int").select("user_id", F.timestamp_seconds("s").alias("ts"), "status")
    got = run.drain_slices([*slices, end], lambda s: rates.sessions(s, "ts", ["user_id"], "300 seconds", late="3 days"))
    assert shown(got) == sorted(want)


class Kept(dict):
    """A state in memory that counts its calls."""

    calls = 0

    def get(self, *_):
        Kept.calls += 1
        return dict.get(self, 0)

    getValue = lambda self, key: self._counted(dict.get(self, key))
    containsKey = lambda self, key: self._counted(key in self)
    removeKey = lambda self, key: self._counted(self.pop(key))
    updateValue = lambda self, key, value: self._counted(self.__setitem__(key, value))
    exists = lambda self: self._counted(0 in self)

    def update(self, value):
        self._counted(self.__setitem__(0, value))

    @staticmethod
    def _counted(value):
        Kept.calls += 1
        return value


def test_states_are_called_by_block(monkeypatch):
    """A response of 200 deltas whose first comes last: one call a delta was too many."""
    import pandas as pd

    handle = type("Handle", (), {"getValueState": lambda *_: Kept(), "getMapState": lambda *_: Kept()})()
    work = ordered_guard.ResponseGuard(RULES, 40, False, False, None)
    work.init(handle)
    monkeypatch.setattr(Kept, "calls", 0)
    order = random.Random(4).sample(range(1, 200), 199)
    got = []
    for lot in [order[i::4] for i in range(4)] + [[0]]:
        rows = pd.DataFrame({"seq": lot, "text": [f"t{s} " for s in lot], "done": [s == 199 for s in lot], "error": [None] * len(lot)})
        got += [r for f in work.handleInputRows(("r",), iter([rows]), None) for r in f.itertuples(index=False)]
    assert [(r.seq, r.text) for r in got] == [(s, f"t{s} ") for s in range(200)]
    assert Kept.calls < 60
