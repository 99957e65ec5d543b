"""An inverted file over vectors with product-quantised codes.

:func:`build` fits coarse cells and a code book on a bounded sample, then files every row under
its nearest cell in a stored table, with a short code of what the cell's center leaves over.
:func:`search` reads only the cells nearest to a query, ranks their rows by the codes and scores
the best of them in full. :func:`search_exact` goes on to every cell that may still hold a better
row: a cell's widest angle bounds the cosine of all its rows, so its result is that of a full
scan, whatever share of the cells it had to read.

The cells and books are small arrays of a stated size. Rows of a full cell are written by as many
tasks as adaptive execution cuts them into; a query meets a cell's rows where they are read, and
each task keeps its own best rows only, so no list of a cell is gathered and nothing but k rows a
query and task is shuffled.

Rows without a vector, and vectors of length zero, are filed nowhere and never found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.retrieval import _query_blocks, _rounded, _union_top
from foliant.session import shared_folder

#: Rows that cells and books are fitted on, at most.
SAMPLE = 20_000
#: Cells, at most; all centers of 1,024 dimensions then take 16 MB.
MOST_CELLS = 4096
#: Folders that the cells are dealt over, at most.
FOLDERS = 256
CODES = 256
#: Queries that one pass serves; their score tables take 16 MB.
BLOCK = 500
_FOUND = "query_id bigint, item_id bigint, score double"


@dataclass(frozen=True)
class VectorIndex:
    """Where the rows are, and the arrays to find them by. ``radius`` is each cell's widest angle, -1 if it is empty."""

    path: str
    centers: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    books: np.ndarray  # (parts of the vector, CODES, dimensions of a part)
    probes: int = 1  # cells that hold the wanted share of the neighbours, measured on the sample

    @property
    def cells_per_folder(self) -> int:
        return -(-len(self.centers) // FOLDERS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=kind)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centers of ``x``; empty ones restart at the rows worst served."""
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        far = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
        own = far.argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0][:, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centers[empty] = x[np.argsort(-far[np.arange(len(x)), own])[:len(empty)]]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)


def _filed(shared, cells_per_folder: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, books = shared.value
        width = books.shape[2]
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                x = _unit(_matrix(batch.column("vec")))
                cell = _nearest(x, centers)
                angle = np.arccos(np.clip((x * _unit(centers)[cell]).sum(1), -1, 1))
                rest = np.pad(x - centers[cell], ((0, 0), (0, books.shape[0] * width - x.shape[1])))
                code = np.stack([_nearest(rest[:, p * width:(p + 1) * width], books[p]) for p in range(len(books))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id"), pa.array(cell), pa.array(cell // cells_per_folder), pa.array(angle),
                     pa.array([c.tobytes() for c in code], pa.binary()), batch.column("vec")],
                    names=["item_id", "cell", "folder", "angle", "code", "vec"])

    return run


def probes_for(x: np.ndarray, centers: np.ndarray, share: float, k: int = 10, asked: int = 256) -> int:
    """Cells to read so that ``share`` of the ``k`` nearest sampled rows of sampled rows lie in them."""
    queries = x[:asked]
    nearest = np.argsort(-(queries @ x.T), axis=1)[:, 1:k + 1]  # the first is the row itself
    if not nearest.size:
        return len(centers)
    order = np.argsort(-(queries @ _unit(centers).T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centers))[None, :].repeat(len(queries), 0), 1)
    needed = np.take_along_axis(place, _nearest(x, centers)[nearest], 1).ravel()
    return int(np.quantile(needed, share, method="higher")) + 1


def build(
    items: DataFrame, cells: int | None = None, parts: int = 16, sample: int = SAMPLE, share: float = 0.97, path: str | None = None,
) -> VectorIndex:
    """File ``items(item_id, vec)`` under ``cells`` cells (by default the root of the number of rows).

    ``share`` of the neighbours decides how many cells :func:`search` reads unless it is told.
    """
    spark = items.sparkSession
    length = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "vec").where(F.col("vec").isNotNull() & (length > 0))
    n = rows.count()
    if not n:
        return VectorIndex("", np.zeros((0, 1)), np.zeros(0), np.zeros(0, int), np.zeros((0, CODES, 1)))
    grain = 1 << 30
    drawn = rows.where(F.pmod(F.xxhash64("item_id", "vec"), F.lit(grain)) < min(grain, 2 * sample * grain // n + 1))
    held = drawn.orderBy(F.xxhash64("item_id", "vec")).limit(sample).select("vec").toArrow()  # the stated bound
    x = _unit(_matrix(held.column("vec")))
    centers = k_means(x, min(len(x), MOST_CELLS, cells or max(1, round(n ** 0.5))))
    rest = x - centers[_nearest(x, centers)]
    parts = min(parts, x.shape[1])
    width = -(-x.shape[1] // parts)
    rest = np.pad(rest, ((0, 0), (0, parts * width - x.shape[1])))
    books = np.zeros((parts, CODES, width))
    for p in range(parts):
        fitted = k_means(rest[:, p * width:(p + 1) * width], min(CODES, len(x)))
        books[p] = np.concatenate([fitted, np.repeat(fitted[:1], CODES - len(fitted), 0)])
    per_folder = -(-len(centers) // FOLDERS)
    shared = spark.sparkContext.broadcast((centers, books))
    schema = f"item_id bigint, cell bigint, folder bigint, angle double, code binary, vec {items.schema['vec'].dataType.simpleString()}"
    path = path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    filed = rows.mapInArrow(_filed(shared, per_folder), schema)
    filed.hint("rebalance", "folder").sortWithinPartitions("folder", "cell").write.partitionBy("folder").parquet(path)
    told = spark.read.parquet(path).groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toArrow()  # a row a cell
    radius, sizes = np.full(len(centers), -1.0), np.zeros(len(centers), int)
    at = told.column("cell").to_numpy()
    radius[at], sizes[at] = told.column("radius").to_numpy(), told.column("n").to_numpy()
    return VectorIndex(path, centers, radius, sizes, books, probes_for(x, centers, share))


def _scan(shared, k: int, keep: int | None, digits: int):
    """Score the rows of wanted cells. With ``keep``, the codes choose that many rows a query, of each batch, to score in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, wanted, center_score, lookup = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                cells, items = batch.column("cell").to_numpy(), batch.column("item_id").to_numpy()
                x = _unit(_matrix(batch.column("vec")))
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), -1).astype(np.intp)
                met: dict[int, list[np.ndarray]] = {}
                for cell in np.unique(cells).tolist():
                    for q in wanted.get(cell, ()):
                        met.setdefault(q, []).append(np.flatnonzero(cells == cell))
                for q, rows in met.items():
                    at = np.concatenate(rows)
                    if keep is not None and len(at) > keep:
                        near = center_score[q, cells[at]] + lookup[q][np.arange(codes.shape[1]), codes[at]].sum(1)
                        at = at[np.argpartition(-near, keep - 1)[:keep]]
                    score = _rounded(x[at] @ queries[q], digits)
                    if q in best:
                        score, named = np.concatenate([best[q][0], score]), np.concatenate([best[q][1], items[at]])
                    else:
                        named = items[at]
                    order = np.lexsort((named, -score))[:k]
                    best[q] = score[order], named[order]
        for q, (score, named) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(named), ids[q])), pa.array(named), pa.array(score)], names=["query_id", "item_id", "score"])

    return run


def _pass(index: VectorIndex, ids: np.ndarray, queries: np.ndarray, cells: np.ndarray, k: int, keep: int | None, digits: int, spark) -> DataFrame:
    """Best rows of the cells marked in ``cells`` (queries, cells); only their folders are read."""
    read = np.flatnonzero(cells.any(0))
    wanted = {int(c): np.flatnonzero(cells[:, c]).tolist() for c in read}
    width = index.books.shape[2]
    padded = np.pad(queries, ((0, 0), (0, index.books.shape[0] * width - queries.shape[1]))).reshape(len(queries), len(index.books), width)
    lookup = np.einsum("qpw,pcw->qpc", padded, index.books)
    shared = spark.sparkContext.broadcast((ids, queries, wanted, queries @ index.centers.T, lookup))
    rows = spark.read.parquet(index.path).where(
        F.col("folder").isin(sorted({int(c) // index.cells_per_folder for c in read})) & F.col("cell").isin([int(c) for c in read]))
    return rows.select("item_id", "cell", "code", "vec").mapInArrow(_scan(shared, k, keep, digits), _FOUND)


def _held(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = part.select("query_id", "vec").where("vec IS NOT NULL").collect()  # at most about one block
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return np.array([r[0] for r in rows], np.int64), _unit(np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1))


def _nearest_cells(index: VectorIndex, queries: np.ndarray, probes: int) -> np.ndarray:
    near = np.where(index.sizes > 0, queries @ _unit(index.centers).T, -2.0)
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, 1)
    return out & (index.sizes > 0)


def _nothing(spark) -> DataFrame:
    return spark.createDataFrame([], f"{_FOUND}, rank int")


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, keep: int = 128, block: int = BLOCK, digits: int = 12) -> DataFrame:
    """The best ``k`` rows of the cells nearest to each of ``queries(query_id, vec)``: query_id, item_id, score, rank."""
    spark = queries.sparkSession
    passes = []
    for part in _query_blocks(queries, queries, block):
        ids, mat = _held(part)
        if len(ids) and index.path:
            passes.append(_pass(index, ids, mat, _nearest_cells(index, mat, probes or index.probes), k, max(keep, k), digits, spark))
    return _union_top(passes, k) if passes else _nothing(spark)


def search_exact(queries: DataFrame, index: VectorIndex, k: int, probes: int = 8, block: int = BLOCK, digits: int = 12) -> DataFrame:
    """As a full scan, from the cells that can matter: query_id, item_id, score, rank, cells_read, rows_read.

    The first cells give each query a k-th score; then every cell is read whose bound reaches it.
    """
    spark = queries.sparkSession
    out = None
    for part in _query_blocks(queries, queries, block):
        ids, mat = _held(part)
        if not len(ids) or not index.path:
            continue
        first = _nearest_cells(index, mat, probes)
        found = _pass(index, ids, mat, first, k, None, digits, spark)
        bar = {r["query_id"]: r["bar"] for r in _union_top([found], k).groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("score")).alias("bar")).collect()}  # a row a query of the block
        angle = np.arccos(np.clip(mat @ _unit(index.centers).T, -1, 1))
        reach = np.cos(np.maximum(0.0, angle - index.radius)) + 1e-9
        bars = np.array([bar.get(int(i)) if bar.get(int(i)) is not None else -2.0 for i in ids])
        more = (reach >= bars[:, None] - 10.0 ** -digits) & ~first & (index.sizes > 0)
        passes = [found] + ([_pass(index, ids, mat, more, k, None, digits, spark)] if more.any() else [])
        read = spark.createDataFrame(
            [(int(i), int(c.sum()), int(index.sizes[c].sum())) for i, c in zip(ids, first | more)], "query_id bigint, cells_read bigint, rows_read bigint")
        best = _union_top(passes, k).join(F.broadcast(read), "query_id")
        out = best if out is None else out.unionByName(best)
    return _nothing(spark).selectExpr("*", "0L AS cells_read", "0L AS rows_read") if out is None else out


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true best ``k`` (query_id, item_id) that was found, for each query."""
    hits = truth.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_true"))
