"""An inverted index for BM25 with block maxima, written once and read by term.

:func:`build` stores posting lists cut into blocks of ``BLOCK`` documents, each with the largest
share that a document of the block can add to a score. Documents are dealt over shards of a
bounded size by a hash of their id, and lists are cut by shard, so a word that every document
holds is spread like any other. Blocks lie in folders by a hash of their term; a search reads the
folders and terms of its queries only.

:func:`search` brings the blocks of the wanted terms together by shard. There a query's terms are
ordered by what they can add at most. Terms that together can not reach the k-th score so far are
not read for new documents, only looked up for documents that are still open, and a block is
decoded only if such a document lies between its ends. The result is that of scoring all postings.

Items without a word are counted for the mean length but never found; a null text has no word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.retrieval import TERM_BLOCK, _query_blocks, _rounded, _union_top, query_keywords
from foliant.session import cut_lineage, shared_folder, spread

BLOCK = 128
#: Documents of one shard, about.
SHARD = 50_000
FOLDERS = 64


@dataclass(frozen=True)
class TextIndex:
    """Blocks (folder, term, shard, first, last, n, most, ids, parts) and terms (term, df)."""

    blocks: str
    terms: str
    n_items: int
    mean_length: float


def _postings(k1: float, b: float, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                lists = batch.column("toks")
                sizes = np.array([len(t) for t in lists.to_pylist()], np.int64)
                words = lists.flatten().dictionary_encode()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                width = max(1, len(words.dictionary))
                pair, times = np.unique(owner * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at = pair // width
                part = times * (k1 + 1) / (times + k1 * (1 - b + b * sizes[at] / mean))
                yield pa.RecordBatch.from_arrays(
                    [words.dictionary.take(pa.array(pair % width)), batch.column("item_id").take(pa.array(at)),
                     batch.column("shard").take(pa.array(at)), pa.array(part)], names=["term", "item_id", "shard", "part"])

    return run


def _blocks(size: int):
    return lambda batches: _cut_blocks(batches, size)


def _cut_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (term, shard, item) to blocks."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    out: list[tuple] = []
    for (term, shard), members in groupby(rows, key=lambda r: (r[0], r[2])):
        held = []
        for row in members:
            held.append(row)
            if len(held) == size:
                out.append(_block(term, shard, held))
                held = []
        if held:
            out.append(_block(term, shard, held))
        if len(out) >= 2000:
            yield _block_batch(out)
            out = []
    yield _block_batch(out)


def _block(term: str, shard: int, rows: list[tuple]) -> tuple:
    ids, parts = np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows])
    return term, shard, int(ids[0]), int(ids[-1]), len(ids), float(parts.max()), ids.tobytes(), parts.tobytes()


_BLOCK_COLUMNS = [("term", pa.string()), ("shard", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("most", pa.float64()),
                  ("ids", pa.binary()), ("parts", pa.binary())]
_BLOCK_SCHEMA = "term string, shard bigint, first bigint, last bigint, n bigint, most double, ids binary, parts binary"


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _BLOCK_COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _BLOCK_COLUMNS)], names=[n for n, _ in _BLOCK_COLUMNS])


def build(items: DataFrame, k1: float = 1.2, b: float = 0.75, block: int = BLOCK, shard: int = SHARD, path: str | None = None) -> TextIndex:
    """Index ``items(item_id, text)``; ids must not repeat."""
    spark = items.sparkSession
    path = path or f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    tokens = spread(items).select(F.col("item_id").cast("bigint").alias("item_id"), query_keywords(F.col("text")).alias("toks"))
    told = tokens.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size("toks"), F.lit(0))).alias("mean")).first()
    shards = -(-told["n"] // shard) or 1
    some = tokens.where(F.size("toks") > 0).withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    postings = some.mapInArrow(_postings(k1, b, told["mean"] or 1.0), "term string, item_id bigint, shard bigint, part double")
    blocks = postings.repartition("term", "shard").sortWithinPartitions("term", "shard", "item_id").mapInArrow(_blocks(block), _BLOCK_SCHEMA)
    folder = F.pmod(F.xxhash64("term"), F.lit(FOLDERS))
    blocks.withColumn("folder", folder).sortWithinPartitions("folder", "term", "shard", "first").write.partitionBy("folder").parquet(f"{path}/blocks")
    stored = spark.read.schema(f"{_BLOCK_SCHEMA}, folder bigint").parquet(f"{path}/blocks")
    stored.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    return TextIndex(f"{path}/blocks", f"{path}/terms", told["n"], told["mean"] or 0.0)


def _look_up(blocks: list[tuple], ids: np.ndarray, read: list[int]) -> np.ndarray:
    """Shares of sorted ``ids`` in one list; blocks between whose ends none lies are not decoded."""
    out = np.zeros(len(ids))
    for first, last, n, _, packed, parts in blocks:
        lo, hi = np.searchsorted(ids, first), np.searchsorted(ids, last, "right")
        if lo == hi:
            continue
        read[0] += n
        held = np.frombuffer(packed, np.int64)
        at = np.minimum(np.searchsorted(held, ids[lo:hi]), n - 1)
        out[lo:hi] = np.where(held[at] == ids[lo:hi], np.frombuffer(parts)[at], 0.0)
    return out


def best_of_shard(lists: list[tuple[float, list[tuple]]], k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the best ``k`` documents, and the postings decoded.

    ``lists`` has (idf, blocks) for each term; a block is (first, last, n, most, ids, parts).
    """
    lists = sorted(lists, key=lambda t: -t[0] * max(b[3] for b in t[1]))
    top = np.array([idf * max(b[3] for b in blocks) for idf, blocks in lists])
    after = np.append(np.cumsum(top[::-1])[::-1][1:], 0.0)  # what all later terms can add
    slack = 1e-9 + (10.0 ** -digits if digits is not None else 0.0)
    read = [0]
    ids, sums = np.zeros(0, np.int64), np.zeros(0)
    bar = -np.inf
    for at, (idf, blocks) in enumerate(lists):
        if top[at] + after[at] >= bar - slack:  # a document not met yet may still be among the best
            fresh = [b for b in blocks if idf * b[3] + after[at] >= bar - slack]
            others = [b for b in blocks if idf * b[3] + after[at] < bar - slack]
            read[0] += sum(b[2] for b in fresh)
            new = np.concatenate([np.frombuffer(b[4], np.int64) for b in fresh]) if fresh else np.zeros(0, np.int64)
            add = np.concatenate([np.frombuffer(b[5]) for b in fresh]) * idf if fresh else np.zeros(0)
            if others and len(ids):
                sums = sums + idf * _look_up(others, ids, read)
            merged, place = np.unique(np.concatenate([ids, new]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([sums, add]), len(merged))
            ids = merged
        else:
            sums = sums + idf * _look_up(blocks, ids, read)
        if len(ids) >= k:
            bar = max(bar, float(np.partition(sums, len(sums) - k)[len(sums) - k]))
            open_ones = sums + after[at] >= bar - slack
            ids, sums = ids[open_ones], sums[open_ones]
    score = _rounded(sums, digits)
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order], read[0]


def _search_shards(shared, k: int, digits: int | None):
    """Blocks sorted by (shard, term, first) to the best of each shard and query; a null item tells the postings read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value  # query -> [(term, idf)]
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, members in groupby(rows, key=lambda r: r[0]):
            held = {term: [r[2:] for r in blocks] for term, blocks in groupby(members, key=lambda r: r[1])}
            q, item, score, read = [], [], [], []
            for query, terms in asked.items():
                lists = [(idf, held[t]) for t, idf in terms if t in held]
                if lists:
                    ids, sums, n = best_of_shard(lists, k, digits)
                    q += [query] * (len(ids) + 1)
                    item += [*ids.tolist(), None]
                    score += [*sums.tolist(), None]
                    read += [0] * len(ids) + [n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(read, pa.int64())],
                names=["query_id", "item_id", "score", "read"])

    return run


def search(queries: DataFrame, index: TextIndex, k: int, block: int = TERM_BLOCK, digits: int | None = None) -> DataFrame:
    """The best ``k`` items of ``queries(query_id, text)``: query_id, item_id, score, rank, postings (of the terms), postings_read."""
    spark = queries.sparkSession
    terms = queries.select("query_id", F.explode(F.array_distinct(query_keywords(F.col("text")))).alias("term"))
    df_of = cut_lineage(terms.join(spark.read.parquet(index.terms), "term"))
    found = []
    for part in _query_blocks(queries, terms, block):
        mine = df_of.join(part.select("query_id"), "query_id", "left_semi")
        asked: dict[int, list[tuple[str, float]]] = {}
        for r in mine.orderBy("query_id", "term").collect():  # at most about one block
            idf = float(np.log(1 + (index.n_items - r["df"] + 0.5) / (r["df"] + 0.5)))
            asked.setdefault(r["query_id"], []).append((r["term"], idf))
        if not asked:
            continue
        wanted = mine.select("term").distinct()
        folders = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).alias("f")).distinct().collect()]
        blocks = spark.read.schema(f"{_BLOCK_SCHEMA}, folder bigint").parquet(index.blocks).where(F.col("folder").isin(folders))
        held = blocks.join(F.broadcast(wanted), "term", "left_semi").select("shard", "term", "first", "last", "n", "most", "ids", "parts")
        shared = spark.sparkContext.broadcast(asked)
        found.append(held.repartition("shard").sortWithinPartitions("shard", "term", "first").mapInArrow(
            _search_shards(shared, k, digits), "query_id bigint, item_id bigint, score double, read bigint"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, item_id bigint, score double, rank int, postings bigint, postings_read bigint")
    found = [cut_lineage(f) for f in found]
    best = _union_top([f.where("item_id IS NOT NULL").select("query_id", "item_id", "score") for f in found], k)
    reads = found[0]
    for more in found[1:]:
        reads = reads.unionByName(more)
    reads = reads.groupBy("query_id").agg(F.sum("read").alias("postings_read"))
    totals = df_of.groupBy("query_id").agg(F.sum("df").alias("postings")).join(reads, "query_id")
    return best.join(totals, "query_id")
