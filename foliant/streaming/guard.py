"""Guarding streamed responses with state per response."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.responses import SCAN_AFTER, assemble

OUT = "response_id string, seq bigint, kind string, text string"
STATE = "buffer string, held string, ended boolean, last_seq bigint"


def guard_stream(deltas: DataFrame, rules: list[str], limit: int = SCAN_AFTER, inclusive: bool = False,
                 hold: bool = False, idle_ms: int | None = 600_000) -> DataFrame:
    """Streaming form of ``guard_deltas``.

    Needs ``response_id`` (text), ``seq, text, done`` and optional ``error``. Deltas are
    taken in ``seq`` order within a micro-batch. A response ends with its ``done``
    row, or when nothing came for ``idle_ms``; then the rest is scanned. The mark that
    it ended is kept for one idle time more, after which its state goes. A run over
    what is there now (trigger availableNow) must pass ``idle_ms=None``: with a
    timeout such a query never stops looking for idle responses.
    """
    unsafe = re.compile("|".join(f"(?:{r})" for r in rules), re.IGNORECASE)
    rows = deltas if "error" in deltas.columns else deltas.withColumn("error", F.lit(None).cast("string"))
    rows = rows.select(F.col("response_id").cast("string"), "seq", "text", "done", "error")

    def full(size: int) -> bool:
        return size >= limit if inclusive else size > limit

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, held, ended, last_seq = state.get if state.exists else ("", "", False, -1)
        out: list[tuple] = []
        if state.hasTimedOut:
            if not ended and buffer and unsafe.search(buffer):
                out.append((key[0], last_seq, "blocked", None))
            elif held:
                out.append((key[0], last_seq, "delta", held))
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values("seq")
            for seq, text, done, error in pdf[["seq", "text", "done", "error"]].itertuples(index=False):
                if ended:
                    break
                last_seq = int(seq)
                if isinstance(error, str):
                    out.append((key[0], last_seq, "error", None))
                    ended = True
                    break
                text = text if isinstance(text, str) else ""
                buffer += text
                closed = full(len(buffer))
                if closed and unsafe.search(buffer):
                    out.append((key[0], last_seq, "blocked", None))
                    ended = True
                    break
                if hold:
                    held += text
                else:
                    out.append((key[0], last_seq, "delta", text))
                if closed:
                    if hold:
                        out.append((key[0], last_seq, "delta", held))
                    buffer, held = "", ""
                if done:
                    if buffer and unsafe.search(buffer):
                        out.append((key[0], last_seq, "blocked", None))
                    elif held:
                        out.append((key[0], last_seq, "delta", held))
                    ended = True
            if ended:
                buffer, held = "", ""
            state.update((buffer, held, bool(ended), last_seq))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["response_id", "seq", "kind", "text"])

    return rows.groupBy("response_id").applyInPandasWithState(
        work, OUT, STATE, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def audit_stream(deltas: DataFrame, raw_path: str, audit_path: str, open_path: str, rules: list[str], checkpoint: str):
    """Pass every delta on, and scan the whole response once it is done.

    The outcome is only written down, never blocks. Deltas of responses that are not
    done yet are handed from batch to batch in ``open_path``, so each batch reads no
    more than what is open. A batch that runs again writes the same folders again.
    """
    unsafe = "(?i)" + "|".join(f"(?:{r})" for r in rules)

    def both(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{raw_path}/batch={batch_id}")
        now = spark.read.parquet(f"{raw_path}/batch={batch_id}")
        if batch_id > 0:
            now = now.unionByName(spark.read.schema(now.schema).parquet(f"{open_path}/batch={batch_id - 1}"))
        finished = now.where("done").select("response_id").distinct()
        texts = assemble(now.join(finished, "response_id", "left_semi"))
        audit = texts.withColumn("allowed", ~F.col("text").rlike(unsafe)).select("response_id", "allowed")
        audit.write.mode("overwrite").parquet(f"{audit_path}/batch={batch_id}")
        now.join(finished, "response_id", "left_anti").write.mode("overwrite").parquet(f"{open_path}/batch={batch_id}")

    return deltas.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
