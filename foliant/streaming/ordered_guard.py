"""The response guard on keyed state with timers, for deltas that arrive in any order.

Each response has a value state (the open buffer, the next sequence number, whether it ended) and
a map state of deltas that came before their turn, ``BLOCK`` numbers to an entry: each call of a
state is a message to the executor and back, so a batch calls it by block and not by delta. A delta
in its turn never touches the map; a batch that closes a gap takes as many waiting deltas as follow.
So what is passed on and where a response is blocked does not depend on how the deltas were dealt
over batches.

A timer is set when a response is touched. When nothing came for ``idle_ms`` the waiting deltas
are taken in order, gaps or not, the rest is scanned, and what is kept shrinks to a mark that the
response ended, which goes after one idle time more. Without ``idle_ms`` there are no timers: for
runs over what is there now. The states live in RocksDB, not on the heap of the executors, and a
batch reads only those of the responses it touches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.responses import SCAN_AFTER

OUT = "response_id string, seq bigint, kind string, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Sequence numbers in one entry of the waiting deltas.
BLOCK = 64


def use_rocks(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store; a cluster may have set it already."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class ResponseGuard(StatefulProcessor):
    def __init__(self, rules: list[str], limit: int, inclusive: bool, hold: bool, idle_ms: int | None):
        self.rules, self.limit, self.inclusive, self.hold, self.idle_ms = rules, limit, inclusive, hold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unsafe = re.compile("|".join(f"(?:{r})" for r in self.rules), re.IGNORECASE)
        self.progress = handle.getValueState("progress", "buffer string, held string, next bigint, ended boolean")
        self.waiting = handle.getMapState("waiting", "block bigint", "deltas string")

    def close(self) -> None:
        pass

    def _full(self, size: int) -> bool:
        return size >= self.limit if self.inclusive else size > self.limit

    def _rest(self, key: str, seq: int, buffer: str, held: str, out: list[tuple]) -> None:
        if buffer and self.unsafe.search(buffer):
            out.append((key, seq, "blocked", None))
        elif held:
            out.append((key, seq, "delta", held))

    def _take(self, key: str, seq: int, delta: tuple, state: tuple, out: list[tuple]) -> tuple:
        """The state (buffer, held, ended) after one delta in its turn."""
        buffer, held, _ = state
        text, done, error = delta
        if isinstance(error, str):
            out.append((key, seq, "error", None))
            return "", "", True
        text = text if isinstance(text, str) else ""
        buffer += text
        closed = self._full(len(buffer))
        if closed and self.unsafe.search(buffer):
            out.append((key, seq, "blocked", None))
            return "", "", True
        if self.hold:
            held += text
        else:
            out.append((key, seq, "delta", text))
        if closed:
            if self.hold:
                out.append((key, seq, "delta", held))
            buffer, held = "", ""
        if done:
            self._rest(key, seq, buffer, held, out)
            return "", "", True
        return buffer, held, False

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        name, seq, kind, text = zip(*out)
        yield pd.DataFrame({"response_id": name, "seq": np.array(seq, np.int64), "kind": kind, "text": text})

    def _block(self, block: int) -> dict[int, tuple]:
        """The waiting deltas of a block by their numbers."""
        kept = self.waiting.getValue((block,))
        return {seq: tuple(delta) for seq, *delta in json.loads(kept[0])} if kept else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, out = key[0], []
        buffer, held, turn, ended = self.progress.get() or ("", "", 0, False)
        if not ended:
            fresh: dict[int, tuple] = {}
            for frame in rows:  # what is not in its turn is kept, not held in one frame
                for seq, text, done, error in zip(*(frame[c].tolist() for c in ("seq", "text", "done", "error"))):
                    if int(seq) >= turn:
                        fresh.setdefault(int(seq), (text if isinstance(text, str) else None, bool(done), error if isinstance(error, str) else None))
            started, blocks, changed = turn, {}, set()
            while not ended:
                delta = fresh.pop(turn, None)
                if delta is None:
                    if turn == started:  # a delta whose turn it is never waits
                        break
                    at = turn // BLOCK
                    if at not in blocks:
                        blocks[at] = self._block(at)
                    delta = blocks[at].pop(turn, None)
                    if delta is None:
                        break
                    changed.add(at)
                buffer, held, ended = self._take(name, turn, delta, (buffer, held, ended), out)
                turn += 1
            if ended:
                self.waiting.clear()
            else:
                for seq, delta in fresh.items():
                    at = seq // BLOCK
                    if at not in blocks:
                        blocks[at] = self._block(at)
                    blocks[at][seq] = delta
                    changed.add(at)
                for at in changed:
                    if any(seq >= turn for seq in blocks[at]):
                        self.waiting.updateValue((at,), (json.dumps([(seq, *d) for seq, d in blocks[at].items() if seq >= turn]),))
                    elif self.waiting.containsKey((at,)):
                        self.waiting.removeKey((at,))
            self.progress.update((buffer, held, turn, ended))
        if self.idle_ms is not None:
            self._wake(timerValues)
        if out:
            yield from self._frames(out)

    def _wake(self, timers) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name, out = key[0], []
        buffer, held, turn, ended = self.progress.get() or ("", "", 0, True)
        if ended:
            self.progress.clear()
            self.waiting.clear()
            return
        state = (buffer, held, False)
        for block in sorted(k[0] for k in self.waiting.keys()):
            for seq, delta in sorted(self._block(block).items()):
                if not state[2]:
                    state, turn = self._take(name, seq, delta, state, out), seq + 1
        if not state[2]:
            self._rest(name, turn - 1, state[0], state[1], out)
        self.waiting.clear()
        self.progress.update(("", "", turn, True))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield from self._frames(out)


def guard_any_order(
    deltas: DataFrame, rules: list[str], limit: int = SCAN_AFTER, inclusive: bool = False, hold: bool = False, idle_ms: int | None = 600_000,
) -> DataFrame:
    """What a guarded stream passes on (response_id, seq, kind, text), from deltas in any order.

    Needs ``response_id``, ``seq`` (from 0, without gaps), ``text``, ``done`` and optional ``error``. A delta that comes
    twice counts once.
    """
    use_rocks(deltas.sparkSession)
    rows = deltas if "error" in deltas.columns else deltas.withColumn("error", F.lit(None).cast("string"))
    rows = rows.select(F.col("response_id").cast("string"), F.col("seq").cast("bigint"), "text", "done", "error")
    return rows.groupBy("response_id").transformWithStateInPandas(
        ResponseGuard(rules, limit, inclusive, hold, idle_ms), OUT, "append", "none" if idle_ms is None else "processingTime")
