"""Benchmark decontamination by Wu-Manber search over words.

The alphabet of the search is the word. Every window of ``window`` consecutive words of a
benchmark item is a pattern; an item of fewer words is one pattern of its own length, and
patterns of one length m form one search. The text is read through a cursor that stands on
the last word of a possible match. The hash of the block of B = min(2, m) words that ends
at the cursor gives a shift: m - B + 1 if no pattern has the block, else the distance from
the block's last place in a pattern to the pattern's end. A shift of 0 selects the bucket
of patterns that end in this block, and the words themselves are compared byte by byte.

Texts stay in the rows they came in: the scan is one narrow pass, without a shuffle, and a
passage that a third of all documents share only costs its own comparisons. The patterns
are broadcast in blocks of at most ``block_bytes``; more patterns mean more passes, between
which the state is written to the folder of ``spark.checkpoint.dir``.

Cases: a null or empty text has no words; items without words have no pattern; items of
equal ids count as one item, and a null item_id counts as the id ''. Repeated documents are
judged row by row. An empty benchmark leaves all documents clean. Only the named columns
are read, so other columns may have any names; they come through unchanged.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.bytetext import ALNUM, mix, slices, text_bytes, words
from foliant.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words per cursor. Long texts are searched by many cursors side by side.
_SEGMENT = 256


def patterns(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(pattern, item): the distinct windows, as words joined by a blank, with each of their items."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), _A_Z, _a_z), F.lit(f"({WORD})"), 1).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    windows = items.select("item", "w", F.explode(starts).alias("at"))
    return windows.select(F.array_join(F.slice("w", F.col("at") + 1, window), " ").alias("pattern"), "item").distinct()


class PatternIndex:
    """Shift tables and suffix buckets of one block of patterns, one set for each length."""

    def __init__(self, texts: list[str], items: list[list[str]]):
        self.items = items
        self.texts = [t.encode() for t in texts]
        by_length: dict[int, list[int]] = {}
        coded = words(pa.array(texts, pa.string())) if texts else None
        for i in range(len(texts)):
            by_length.setdefault(int(coded.bounds[i + 1] - coded.bounds[i]), []).append(i)
        self.searches = []
        for m, own in sorted(by_length.items()):
            block = min(2, m)
            bits = max(10, int(len(own) * m).bit_length() + 2)
            shift = np.full(1 << bits, m - block + 1, np.int64)
            codes = np.stack([coded.hash[coded.bounds[i]:coded.bounds[i + 1]] for i in own])
            for end in range(block - 1, m):
                at = _bucket(codes[:, end], codes[:, end - 1] if block == 2 else None, bits)
                np.minimum.at(shift, at, m - 1 - end)
            suffix = _block_hash(codes[:, m - 1], codes[:, m - 2] if block == 2 else None)
            order = np.argsort(suffix, kind="stable")
            self.searches.append((m, block, bits, shift, suffix[order], np.array(own)[order], codes[order]))


def _block_hash(last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    return mix(last if before is None else last + before * _STEP)


def _bucket(last: np.ndarray, before: np.ndarray | None, bits: int) -> np.ndarray:
    return (_block_hash(last, before) >> np.uint64(64 - bits)).astype(np.int64)


def _candidates(code: np.ndarray, bounds: np.ndarray, m: int, block: int, bits: int, shift: np.ndarray) -> np.ndarray:
    """Ends of possible matches: the places where a cursor met a shift of 0."""
    lo, hi = bounds[:-1], bounds[1:]
    long = hi - lo >= m
    lo, hi = lo[long] + m - 1, hi[long]
    parts = -(-(hi - lo) // _SEGMENT)
    owner = np.repeat(np.arange(len(lo)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cursor = lo[owner] + nth * _SEGMENT
    stop = np.minimum(cursor + _SEGMENT, hi[owner])
    found = []
    while len(cursor):
        step = shift[_bucket(code[cursor], code[cursor - 1] if block == 2 else None, bits)]
        zero = step == 0
        if zero.any():
            found.append(cursor[zero])
        cursor = cursor + np.maximum(step, 1)
        alive = cursor < stop
        cursor, stop = cursor[alive], stop[alive]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def search(texts: pa.Array, index: PatternIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds of the rows, and the confirmed matches: last word, length and pattern of each."""
    found = words(texts)
    ends, lengths, hits = [], [], []
    for m, block, bits, shift, suffix, own, codes in index.searches:
        at = _candidates(found.hash, found.bounds, m, block, bits, shift)
        if not len(at):
            continue
        key = _block_hash(found.hash[at], found.hash[at - 1] if block == 2 else None)
        lo, hi = np.searchsorted(suffix, key, "left"), np.searchsorted(suffix, key, "right")
        several = hi - lo
        at = np.repeat(at, several)
        which = np.arange(len(at)) - np.repeat(np.cumsum(several) - several, several) + np.repeat(lo, several)
        for back in range(m):  # most false candidates fall at the first word
            same = found.hash[at - back] == codes[which, m - 1 - back]
            at, which = at[same], which[same]
        for end, k in zip(at.tolist(), own[which].tolist()):
            span = (bytes(ALNUM[found.data[found.start[j]:found.end[j]]]) for j in range(end - m + 1, end + 1))
            if b" ".join(span) == index.texts[k]:
                ends.append(end)
                lengths.append(m)
                hits.append(k)
    return found.bounds, np.array(ends, np.int64), np.array(lengths, np.int64), np.array(hits, np.int64)


def _scan(index: PatternIndex):
    """Merge the matches of one block of patterns into ``_hit`` (a bit per word) and ``_items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                bounds, ends, lengths, hits = search(batch.column("_text"), index)
                n = batch.num_rows
                row = np.searchsorted(bounds, ends, "right") - 1
                delta = np.zeros(int(bounds[-1]) + 1, np.int32)
                np.add.at(delta, ends - lengths + 1, 1)
                np.add.at(delta, ends + 1, -1)
                hit = np.cumsum(delta)[:-1] > 0
                items: dict[int, set[str]] = {}
                for r, k in set(zip(row.tolist(), hits.tolist())):
                    items.setdefault(r, set()).update(index.items[k])
                old_hit, old_items = batch.column("_hit"), batch.column("_items")
                bits: list[bytes | None] = [None] * n
                names: list[list[str] | None] = [None] * n
                for i in range(n):
                    before = old_hit[i].as_py()
                    if i not in items:
                        bits[i], names[i] = before, old_items[i].as_py()
                        continue
                    now = np.packbits(hit[bounds[i]:bounds[i + 1]])
                    if before is not None:
                        now = now | np.frombuffer(before, np.uint8)
                    bits[i] = now.tobytes()
                    names[i] = sorted(items[i].union(old_items[i].as_py() or ()))
                made = {"_n_words": pa.array(np.diff(bounds), pa.int64()), "_hit": pa.array(bits, pa.binary()),
                        "_items": pa.array(names, pa.list_(pa.string()))}
                columns = [made.get(f, batch.column(f) if f in batch.schema.names else None) for f in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in batch.column("_hit").to_pylist()]
        names = [x or [] for x in batch.column("_items").to_pylist()]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("_n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
             pa.array(digest, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array([h > 0 for h in hits], pa.bool_())],
            names=["_row", "n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"])


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per document: the ``keep`` columns, n_words, n_hit, n_items, items_sha256, items, contaminated.

    ``items`` are the ids of the benchmark items found, as sorted strings. Result columns
    replace ``keep`` columns of the same name.
    """
    result = ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in result]
    spark = documents.sparkSession
    found = cut_lineage(patterns(benchmark, window, text_col=text_col))
    size = found.agg(F.sum(F.octet_length("pattern") + F.octet_length("item") + 200)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    state = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("_n_words"),
        F.lit(None).cast("binary").alias("_hit"), F.lit(None).cast("array<string>").alias("_items"))
    for k in range(blocks):
        own = found.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k) if blocks > 1 else found
        rows = own.groupBy("pattern").agg(F.sort_array(F.collect_list("item"))).collect()  # one block of checked size
        rows.sort()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [r[0] for r in rows], [list(r[1]) for r in rows]))
        if k:
            state = cut_lineage(state)
        state = state.mapInArrow(_with_index(shared), state.schema)
    schema = T.StructType(
        [state.schema["_row"]] + [
            T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("contaminated", T.BooleanType())])
    done = state.select("_row", "_n_words", "_hit", "_items").mapInArrow(_finish, schema)
    return done.select("_row.*", *result)


#: The index of the block of patterns that this worker used last.
_LAST: dict[str, PatternIndex] = {}


def _with_index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *rows = shared.value
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = PatternIndex(*rows)
        return _scan(_LAST[name])(batches)

    return run


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, with their columns as they came."""
    marked = find_contamination(documents.select(F.struct("*").alias("_whole"), "text"), benchmark, window, keep=["_whole"])
    return marked.where(~F.col("contaminated")).select("_whole.*")
