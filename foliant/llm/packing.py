"""Best-two-fit packing of token sequences.

Texts are tokenised in the tasks and cut into pieces: a text of at most ``capacity`` tokens
(its end token included) is one piece, a longer one is cut into pieces of ``capacity`` tokens
of which the first may be shorter. Pieces of the same length are alike to the packer, so it
works on the number of pieces of each length, a table of at most ``capacity`` rows:

- a bin is filled greedily, each time with the longest piece that fits;
- then its smallest piece is replaced by two unpacked pieces that fit the gap, widened by
  that piece, more tightly; among equally tight pairs the one with the longest piece is
  taken. This goes on while it helps;
- the same bin is made as often as the numbers of pieces allow, which is what packing one
  bin after the other would do.

The result is a plan of bin patterns. Every piece then finds its place by its rank among the
pieces of its length: ranks are counted per task and shifted by the counts of earlier tasks,
so no group of equal pieces meets in one task.

Cases: a null text is empty and has the end token alone; repeated rows are packed each; an
empty table gives no pieces. Only named columns are read; result columns replace columns of
the same name. Where a text repeats, which copy gets which place is not part of the result's
meaning, but the stored ranks make it stable when tasks run again.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from foliant.session import cut_lineage

#: Fixed value: the pre-tokeniser pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULT = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
#: Characters whose classes all versions of Unicode agree on; ASCII controls but tab and line breaks are left out.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u0233]*")
#: Longest text without a blank that goes the fast way.
_LONGEST = 10_000


class _Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, equal to those of ``tokenizers``.

    With the ranks of the same vocabulary, texts of plain characters go through the faster
    merge loop of ``tiktoken``; its tests compare both. All other texts, and all texts
    without ranks, go through ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> bytes:
        if self.fast is not None and _PLAIN.fullmatch(text) and (len(text) < _LONGEST or max(map(len, text.split()), default=0) < _LONGEST):
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(self.special), disallowed_special=()).astype("<u4").tobytes()
            except BaseException as broken:  # its pattern gives up on very long runs of white space
                if type(broken).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_LAST: dict[tuple, _Encoder] = {}


def _cut(paths: tuple[str, str | None], capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _LAST:
            _LAST.clear()
            _LAST[paths] = _Encoder(*paths)
        encoder = _LAST[paths]
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = [t or "" for t in some.column("_text").to_pylist()]
                at, piece, start, length, crc, rank, raw = [], [], [], [], [], [], []
                for i, text in enumerate(texts):
                    ids = encoder.encode(text) + end
                    total = len(ids) // 4
                    first = total % capacity or capacity
                    a, b, k = 0, first, 0
                    while a < total:
                        own = ids[4 * a:4 * b]
                        at.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own))
                        rank.append(int(seen[b - a]))
                        seen[b - a] += 1
                        if with_ids:
                            raw.append(own)
                        a, b, k = b, b + capacity, k + 1
                arrays = [some.column("_row").take(pa.array(at, pa.int64()))] + [
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64())]
                names = ["_row", "piece", "start", "length", "ids_crc32", "_part", "_rank"]
                if with_ids:
                    arrays.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text",
           keep: list[str] | None = None, with_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """One row per piece with its ids' crc32 and, if asked for, the ids as little-endian 32-bit bytes.

    ``ranks_path`` names the ranks of the same vocabulary, for the fast way through plain texts.

    The ``keep`` columns are in the struct ``_row``. ``_part`` and ``_rank`` number the pieces
    of one length; the table is stored, so they stay.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c not in RESULT]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).alias("_text"))
    fields = [rows.schema["_row"]] + [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return cut_lineage(rows.mapInArrow(_cut((tokenizer_path, ranks_path), capacity, end_id, with_ids), T.StructType(fields)))


def _tightest_pair(count: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Lengths (a >= b) with the largest a + b in (more_than, room], the largest a among these."""
    there = np.flatnonzero(count[:room + 1] > 0)
    there = there[there > 0]
    if not len(there):
        return None
    # For each a, the longest b <= min(a, room - a); b = a needs two pieces.
    limit = np.minimum(there, room - there)
    at = np.searchsorted(there, limit, "right") - 1
    single = (at >= 0) & (there[at] == there) & (count[there] < 2)
    at = at - single
    ok = at >= 0
    if not ok.any():
        return None
    a, b = there[ok], there[at[ok]]
    total = a + b
    best = total.max()
    if best <= more_than:
        return None
    k = int(np.flatnonzero(total == best)[-1])
    return int(a[k]), int(b[k])


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, number of such bins) by best-two-fit; the lengths of a bin never exceed ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    plan = []
    longest = [-length for length in counts]
    heapq.heapify(longest)
    while longest:
        if not count[-longest[0]]:
            heapq.heappop(longest)
            continue
        own: list[int] = []
        room = capacity
        while True:
            fits = np.flatnonzero(count[1:room + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            # One length may fill the rest several times over.
            times = min(room // length, int(count[length]))
            own += [length] * times
            count[length] -= times
            room -= length * times
        while room and own:
            pair = _tightest_pair(count, room + own[-1], own[-1])
            if pair is None:
                break
            smallest = own.pop()
            count[smallest] += 1
            own = sorted([*own, *pair], reverse=True)
            for length in pair:
                count[length] -= 1
            room += smallest - sum(pair)
        used, times = np.unique(own, return_counts=True)
        more = int((count[used] // times).min())
        count[used] -= more * times
        plan.append((own, 1 + more))
    return plan


def _places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, sequence of that rank, and offset, for each slot of each pattern."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for own, times in plan:
        offset = 0
        for length in own:
            rank = used.get(length, 0)
            slots.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in slots.items()}


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                first, number, place = places[int(own)]
                slot = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = number[slot] + rank[at] - first[slot]
                offset[at] = place[slot]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece of :func:`pieces` its ``sequence_id`` and ``offset``."""
    # Ranks inside a task become ranks among all pieces of a length.
    by_part = cut.groupBy("length", "_part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = cut_lineage(by_part.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    counts = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    places = _places(plan_bins(counts, capacity))
    shared = cut.sparkSession.sparkContext.broadcast(places)
    ranked = cut.join(shifts.drop("n"), ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("shift")).drop("_part", "shift")
    fields = [f for f in ranked.schema.fields if f.name != "_rank"] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    placed = ranked.mapInArrow(_assign(shared), T.StructType(fields))
    return placed.select("_row.*", *[c for c in RESULT if c in placed.columns])
