"""N-gram Jaccard self-join by the chosen-path method.

A text is the set of its five-word shingles (words: A-Z lower-cased runs of ASCII letters,
digits and other than ASCII characters; a text of fewer words is one shingle). Texts with the
same set are copies of one *record*; records are joined if their sets have a Jaccard
similarity of at least ``threshold``.

1. Each record gets ``SKETCH`` min-hash tokens, which two records share with a probability of
   their similarity. In each run, a record follows from a node every token whose hash, salted
   by the node, is small enough: about ``BRANCH / threshold`` children, the same ones in all
   records that share the token. After ``DEPTH`` steps the nodes are buckets. Records at the
   threshold meet in a run with a probability that follows from these numbers, and as many
   runs are made as ``recall`` asks for. No record needs another one for this, so all runs
   are one narrow pass.
2. Buckets are counted, singles dropped, and of buckets with the same members one is kept.
   Only links enough to connect what looks similar leave a task, never all pairs. A bucket
   whose records are connected already has nothing to add, so three passes are made:

   a. The buckets of the first ``EARLY`` runs, cut into blocks of ``LIMIT`` records; each
      record is compared in its own block only.
   b. The other runs, where a bucket holds the first and the last record of each connected
      part, if it holds several parts.
   c. Buckets that were not compared whole and still hold several parts, with all their
      records. One of more than ``LIMIT`` records whose tokens differ is split on sampled
      tokens again, up to ``MAX_DEPTH``; a large one of like records is cut into blocks, and
      pairs of blocks are compared.
3. The connected parts of these links are compared exactly: the shingles of their records
   are read again from the texts, in blocks of ``BLOCK`` records, each pair of blocks in one
   place. Each record gets its number of links, and what exact links connect is one
   class.

Copies are counted, not expanded. A group of like records is joined by the first runs and
takes no rows in the others but those of two records a bucket; so no link is lost, as all that
a bucket can add is to connect parts that are not connected yet. In step 3 a record is repeated
once for each block of its group.

Cases: null and empty texts and texts without words have no shingle: they have no links and
are classes of their own. Repeated rows are copies; a class without any id has a null
class_id. Only the named columns are read; result columns replace columns of the same name.
Records are told apart by a 64-bit hash of their set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.bytetext import Words, mix, slices, words
from foliant.llm.components import components
from foliant.session import cut_lineage

SHINGLE = 5
SKETCH = 64
BRANCH = 1.5
DEPTH = 2
MAX_DEPTH = 5
#: Runs that are compared first; two records that are alike meet in them with probability 0.96.
EARLY = 2
LIMIT = 1024
BLOCK = 256
#: Standard errors by which the share of equal tokens may lie below the threshold.
SLACK = 4.0
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def runs_for(recall: float, branch: float = BRANCH, depth: int = DEPTH) -> int:
    """Runs after which two records at the threshold have met with probability ``recall``."""
    miss = 0.0  # of a path that has reached its last level
    for _ in range(depth):
        miss = math.exp(-branch * (1 - miss))
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def shingles(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted in the row, and the bounds of the rows."""
    n = np.diff(found.bounds)
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), made)
    at = found.bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made)
    code = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        there = at + k < found.bounds[1:][row]
        word = found.hash[np.minimum(at + k, max(len(found.hash) - 1, 0))] if len(row) else code
        code = mix(code + _SALT) ^ np.where(there, word, np.uint64(k))
    code = mix(code)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[first], row[first]
    return code, np.searchsorted(row, np.arange(len(n) + 1))


def record_keys(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on the order of its shingles."""
    total = np.zeros(len(code) + 1, np.uint64)
    other = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code + _SALT), out=total[1:])
    np.cumsum(mix(code ^ _SALT), out=other[1:])
    a, b = total[bounds[1:]] - total[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]]
    return mix(mix(a) + b * _SALT).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "_text"):
            code, bounds = shingles(words(batch.column("_text")))
            size = np.diff(bounds)
            some = size > 0
            tokens = np.zeros((len(size), SKETCH), np.uint32)
            if some.any():
                starts = bounds[:-1][some]
                for k in range(SKETCH):
                    value = (code * _A[k] + _B[k]) >> np.uint64(32)
                    tokens[some, k] = np.minimum.reduceat(value, starts)
            keys = record_keys(code, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_hash"), pa.array(keys, mask=~some), pa.array(size.astype(np.int64)),
                 pa.array([t.tobytes() if s else None for t, s in zip(tokens, some)], pa.binary())],
                names=["id", "hash", "record", "size", "sketch"])


def _children(node: np.ndarray, token: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``node`` and the nodes they lead to by the tokens that the node samples."""
    row, child = [], []
    bar = np.uint64(min(rate, 1.0) * (2**64 - 1025))
    for k in range(SKETCH):
        step = mix((token[:, k].astype(np.uint64) << np.uint64(8)) + np.uint64(k) + _SALT)
        met = mix(node ^ step)
        own = np.flatnonzero(met <= bar)
        row.append(own)
        child.append(mix(met[own] + _SALT))
    return np.concatenate(row), np.concatenate(child)


def _tokens(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint32).reshape(len(sketches), SKETCH)


def _paths(runs: range, threshold: float, also: tuple[str, ...] = ()):
    """The buckets of each record in these runs; columns named in ``also`` come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                token = _tokens(batch.column("sketch"))
                for r in runs:
                    row = np.arange(len(token))
                    node = np.full(len(token), mix(np.array([r + 1], np.uint64))[0])
                    for _ in range(DEPTH):
                        at, node = _children(node, token[row], BRANCH / threshold / SKETCH)
                        row = row[at]
                    own = [batch.column(c).take(pa.array(row)) for c in ("record", *also)]
                    yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *own], names=["node", "record", *also])

    return run


def _deeper(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                batch = whole.slice(lo, 4000)
                # A node that is split again samples more, so that its pairs are not lost.
                at, node = _children(batch.column("node").to_numpy().astype(np.uint64), _tokens(batch.column("sketch")), 2 * BRANCH / threshold / SKETCH)
                own = [batch.column(c).take(pa.array(at)) for c in ("record", "bits")]
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *own], names=["node", "record", "bits"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from rows sorted by them; many small groups come in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != v[0]
        starts = np.flatnonzero(change)
        if held and len(starts):
            held.append(batch.slice(0, int(starts[0])))
            yield pa.Table.from_batches(held)
            held = []
            batch, starts = batch.slice(int(starts[0])), starts - starts[0]
        if not held and len(starts) and starts[-1] > 0:
            yield pa.Table.from_batches([batch.slice(0, int(starts[-1]))])
            batch = batch.slice(int(starts[-1]))
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    todo = near.any(1)
    edges = []
    while todo.any():
        root = int(np.argmax(todo))
        todo[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(near[at] & todo)
            todo[new] = False
            edges += [(at, int(x)) for x in new]
            queue += new.tolist()
    return edges


def stars(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first row of each part of a symmetric boolean matrix to its others."""
    first: dict[int, int] = {}
    for at, new in spanning(near):
        first[new] = first.get(at, at)
    return [(root, other) for other, root in first.items()]


def _near_sketches(token: np.ndarray, size: np.ndarray, least: int, threshold: float) -> np.ndarray:
    n = len(token)
    near = np.zeros((n, n), bool)
    step = max(1, (1 << 24) // (n * SKETCH))
    for lo in range(0, n, step):
        near[lo:lo + step] = (token[lo:lo + step, None, :] == token[None]).sum(2, dtype=np.uint8) >= least
    small, large = np.minimum(size[:, None], size[None]), np.maximum(size[:, None], size[None])
    near &= small >= threshold * large - 1e-9
    np.fill_diagonal(near, False)
    return near


def _bucket_links(threshold: float):
    """Links that connect the records of each bucket, or pair of blocks, whose sketches agree."""
    least = math.floor((threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SKETCH)) * SKETCH)
    keys = ["node", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, keys):
            record, size = table.column("record").to_numpy(), table.column("size").to_numpy()
            token = _tokens(table.column("sketch").combine_chunks())
            bounds = _group_bounds(table, keys)
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo == 2:
                    if (token[lo] == token[lo + 1]).sum() >= least and min(size[lo:hi]) >= threshold * max(size[lo:hi]) - 1e-9:
                        a.append(record[lo])
                        b.append(record[lo + 1])
                    continue
                for i, j in stars(_near_sketches(token[lo:hi], size[lo:hi], least, threshold)):
                    a.append(record[lo + i])
                    b.append(record[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _counts(code: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(code)
    owner = np.repeat(np.arange(n), [len(c) for c in code])
    values, place, times = np.unique(np.concatenate(code), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    column, owner = number[place[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, (1 << 22) // n)
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        matrix = np.zeros((n, width), np.float32)
        matrix[owner[i:j], column[i:j] - lo] = 1
        out += matrix @ matrix.T
    return out


def _exact_links(threshold: float):
    """Of each pair of blocks: links and linked documents by record, and pairs that connect what is linked."""
    keys = ["label", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, keys):
            record, copies = table.column("record").to_numpy(), table.column("copies").to_numpy()
            block, x, y = (table.column(c).to_numpy() for c in ("block", "x", "y"))
            code = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            bounds = _group_bounds(table, keys)
            a, b, links, documents = [], [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo < 2:
                    continue
                size = np.array([len(c) for c in code[lo:hi]], np.float64)
                both = _counts(code[lo:hi]).astype(np.float64)
                near = both >= threshold * (size[:, None] + size[None] - both) - 1e-6
                np.fill_diagonal(near, False)
                if x[lo] != y[lo]:  # pairs inside a block are met where the block meets itself
                    near &= block[lo:hi, None] != block[None, lo:hi]
                for i in np.flatnonzero(near.any(1)).tolist():
                    a.append(record[lo + i])
                    b.append(None)
                    links.append(int(near[i].sum()))
                    documents.append(int(copies[lo:hi][near[i]].sum()))
                for i, j in stars(near):
                    a.append(record[lo + i])
                    b.append(record[lo + j])
                    links.append(0)
                    documents.append(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64()), pa.array(documents, pa.int64())],
                names=["a", "b", "links", "documents"])

    return run


def _in_blocks(rows: DataFrame, group: str, members: str, most: int, salt: int) -> DataFrame:
    """Repeat each row for the pairs (x, y) of blocks of its group that its own block takes part in."""
    parts = F.ceil(F.col(members) / most).cast("int")
    block = F.pmod(F.xxhash64("record", F.lit(salt)), parts).cast("int")
    return rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "*", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).drop("other")


def _own_block(rows: DataFrame) -> DataFrame:
    """Each row once, in a block of its bucket; the blocks are dealt anew in every bucket."""
    block = F.pmod(F.xxhash64("node", "record"), F.ceil(F.col("n") / LIMIT)).cast("int")
    return rows.withColumns({"x": block, "y": block})


def _streamed(rows: DataFrame, keys: list[str], task: Callable, schema: str) -> DataFrame:
    # the records of a group in order, so that stars() has its smallest one in the middle and components() few rounds
    return rows.repartition(*keys).sortWithinPartitions(*keys, "record").mapInArrow(task, schema)


def _bits():
    """Sixteen low bits of the sketch, from which the mean likeness of a bucket follows."""
    low = (F.conv(F.hex(F.substring("sketch", 4 * k + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1)) for k in range(16))
    return sum((F.shiftleft(bit, k) for k, bit in enumerate(low)), F.lit(0)).alias("bits")


def _shared(leaves: DataFrame, **told) -> tuple[DataFrame, DataFrame]:
    """Buckets (node, n, what is ``told`` of its members) of several records, each set of members once; the leaves in them."""
    leaves = cut_lineage(leaves)
    counted = leaves.groupBy("node").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("record")).alias("p"), F.bit_xor(F.xxhash64("record", F.lit(7))).alias("q"),
        *[made.alias(name) for name, made in told.items()])
    kept = cut_lineage(counted.where("n > 1").groupBy("n", "p", "q", *told).agg(F.min("node").alias("node")).select("node", "n", *told))
    return kept, _filtered(leaves, kept).join(kept, "node")  # most buckets hold one record; they need no shuffle


def _filtered(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose node may be one of ``nodes``."""
    return rows.mapInArrow(_only(rows.sparkSession.sparkContext.broadcast(wanted_table(nodes, "node"))), rows.schema)


def _buckets(sketches: DataFrame, leaves: DataFrame, threshold: float) -> DataFrame:
    """(node, n, record): the buckets worth comparing, each set of members once; leaves are joined once at each depth."""
    # Mean agreement of one bit of the tokens in a bucket is (1 + likeness) / 2.
    shares = [F.avg(F.shiftright("bits", k).bitwiseAND(F.lit(1))) for k in range(16)]
    agree = sum((F.pow(s, 2) + F.pow(1 - s, 2) for s in shares), F.lit(0.0)) / 16
    split = ~F.col("alike") & (F.col("n") > LIMIT)
    done = None
    for depth in range(DEPTH, MAX_DEPTH + 1):
        kept, full = _shared(leaves, alike=2 * agree - 1 >= threshold / 2)
        last = depth == MAX_DEPTH or kept.where(split).isEmpty()
        full = full if last else cut_lineage(full)
        finished = (full if last else full.where(~split)).select("node", "n", "record")
        done = finished if done is None else done.unionByName(finished)
        if last:
            return done
        leaves = full.where(split).select("node", "record").join(sketches, "record").mapInArrow(
            _deeper(threshold), "node long, record long, bits int").distinct()
    return done


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links."""
    return cut_lineage(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)))


def _relabelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Add ``label``, the part that the record in ``column`` belongs to; a record alone is its own part."""
    told = labels.select(F.col("node").alias("_at"), F.col("label").alias("_label"))
    return rows.join(told, F.col(column) == F.col("_at"), "left").withColumn("label", F.coalesce("_label", column)).drop("_at", "_label")


def _likely(records: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(node, label): the connected parts of records that look similar in some bucket."""
    paths = "node long, record long"
    early = min(EARLY, runs)

    def links(rows: DataFrame) -> DataFrame:
        return _streamed(rows.join(records.select("record", "size", "sketch"), "record"), ["node", "x", "y"], _bucket_links(threshold), "a long, b long")

    sketches = records.select("record", "sketch")
    _, met = _shared(sketches.mapInArrow(_paths(range(early), threshold), paths))
    met = cut_lineage(met)
    labels = cut_lineage(components(links(_own_block(met))))

    later = _relabelled(sketches, "record", labels).mapInArrow(_paths(range(early, runs), threshold, ("label",)), f"{paths}, label long")
    first, last = F.min("record"), F.max("record")
    # most parts of a bucket are one record that is its own label; nulls take no room
    parts = cut_lineage(later.groupBy("node", "label").agg(
        F.count("*").alias("members"), F.nullif(first, F.col("label")).alias("first"), F.when(first < last, last).alias("last")))
    mixed = cut_lineage(parts.groupBy("node").agg(
        F.sum(F.least("members", F.lit(2))).alias("n"), F.max("members").alias("most"), F.min("label").alias("a"), F.max("label").alias("b"),
    ).where("a < b").select("node", "n", ((F.col("most") > 2) | (F.col("n") > LIMIT)).alias("in_part")))
    parts = cut_lineage(_filtered(parts, mixed).join(mixed, "node"))
    ends = F.array_compact(F.array(F.coalesce("first", "label"), "last"))
    labels = _joined(labels, links(_own_block(parts.select("node", "n", F.explode(ends).alias("record")))))

    left = parts.where("in_part").select("node", F.col("label").alias("record")).unionByName(
        met.where(F.col("n") > LIMIT).select("node", "record"))
    apart = cut_lineage(_relabelled(left, "record", labels).groupBy("node").agg(
        F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("node"))
    if apart.isEmpty():
        return labels
    sketches = records.select("record", "sketch", _bits())
    leaves = _filtered(sketches.mapInArrow(_paths(range(runs), threshold, ("bits",)), f"{paths}, bits int"), apart).join(apart, "node", "left_semi")
    return _joined(labels, links(_in_blocks(_buckets(sketches, leaves, threshold), "node", "n", LIMIT, 1)))


def _read_again(shared):
    """(record, shingles) of the texts whose record may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for whole in batches:
            for batch in slices(whole, "_text"):
                code, bounds = shingles(words(batch.column("_text")))
                keys = record_keys(code, bounds)
                own = np.flatnonzero((np.diff(bounds) > 0) & wanted.may_hold(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[own]), pa.array([code[bounds[i]:bounds[i + 1]].tobytes() for i in own.tolist()], pa.binary())],
                    names=["record", "shingles"])

    return run


class _Wanted:
    """Membership of longs by a bit table; it may say yes too often, never no."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def spots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        code = keys.astype(np.uint64)
        return [mix(code + np.uint64(k * int(_SALT) % 2**64)) >> np.uint64(64 - bits) for k in range(3)]

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for spot in self.spots(keys, self.bits):
            out &= (self.table[(spot >> np.uint64(5)).astype(np.int64)] >> (spot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
        return out


def _spots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = np.concatenate(_Wanted.spots(batch.column("key").to_numpy(), bits))
            word, value = spot >> np.uint64(5), np.uint64(1) << (spot & np.uint64(31))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.astype(np.int64))], names=["w", "v"])

    return run


def _only(shared):
    """The rows whose node may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.may_hold(batch.column("node").to_numpy())))

    return run


def wanted_table(rows: DataFrame, key: str, most_bits: int = 27) -> _Wanted:
    """A bit table of a column of longs, of at most 16 MB however many there are."""
    bits = min(most_bits, max(16, (16 * rows.count()).bit_length()))
    filled = rows.select(F.col(key).alias("key")).mapInArrow(_spots(bits), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[filled.column("w").to_numpy()] = filled.column("v").to_numpy().astype(np.uint32)
    return _Wanted(table, bits)


def link(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: id, hash (of the text), class_key, class_id, n_links, n_text_links, n_copies, keeper.

    ``class_id`` is the smallest id of the class and ``keeper`` marks the row, or the equal
    rows, of the class that come first by (id, hash). ``n_links`` counts linked documents,
    copies included, ``n_text_links`` linked records, ``n_copies`` documents of the same set.
    """
    rows = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    made = cut_lineage(rows.mapInArrow(_sketch, f"id {kind}, hash long, record long, size long, sketch binary"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("hash").alias("hash"))).alias("first")
    records = cut_lineage(made.where("record IS NOT NULL").groupBy("record").agg(
        first, F.count("*").alias("copies"), F.max("size").alias("size"), F.max("sketch").alias("sketch")))
    likely = _likely(records, threshold, runs_for(recall)).select(F.col("node").alias("record"), "label")
    sizes = likely.groupBy("label").agg(F.count("*").alias("n"))
    shared = documents.sparkSession.sparkContext.broadcast(wanted_table(likely, "record"))
    again = rows.select("_text").mapInArrow(_read_again(shared), "record long, shingles binary").groupBy("record").agg(
        F.first("shingles").alias("shingles"))
    held = likely.join(sizes, "label").join(records.select("record", "copies"), "record").join(again, "record")
    judged = cut_lineage(_streamed(
        _in_blocks(held, "label", "n", BLOCK, 2), ["label", "x", "y"], _exact_links(threshold),
        "a long, b long, links long, documents long"))
    counts = judged.where("b IS NULL").groupBy(F.col("a").alias("record")).agg(
        F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    classes = components(judged.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("record"), "label")
    told = cut_lineage(records.select("record", "first", "copies").join(counts, "record", "left").join(classes, "record", "left").select(
        "record", "first", "copies", "links", "documents", F.coalesce("label", "record").alias("class_key")))
    heads = told.groupBy("class_key").agg(F.min("first").alias("head"))
    told = told.join(heads, "class_key").select(
        "record", "class_key", "head", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("documents", F.lit(0)).alias("documents"))
    out = made.select("id", "hash", "record").join(told, "record", "left")
    alone = F.col("record").isNull()
    return out.select(
        F.col("id").alias(id_col), "hash", "class_key", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.col("documents")).cast("long").alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("hash") == F.col("head.hash")))).alias("keeper"))


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each class, with the columns as they came: the first by (id, hash of the text)."""
    keepers = link(documents, id_col, text_col, threshold).where("keeper").select(
        F.col(id_col).alias("_id"), F.col("hash").alias("_hash")).distinct()
    rows = documents.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_text_hash"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    return rows.join(keepers, same, "left_semi").dropDuplicates(["_own", "_text_hash"]).select("_row.*")
