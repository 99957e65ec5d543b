"""Prefix trie of conversations, built as a burst trie.

A conversation is the sequence of its turns, each known by an id of (role, text). Turns are
numbered in their conversation, and every prefix gets a 128-bit key: the exclusive or of
hashes of (depth, turn id), so a prefix is known without its texts.

1. The root is the first trie head, and all conversations are suffixes in its container. A
   container of more than ``limit`` rows is burst by the next turn id: its suffixes, one turn
   shorter, go to the containers of the heads one level below. This is repeated ``rounds``
   times. What is still too large then (long conversations, long common beginnings) is burst
   at all its levels at once.
2. The remaining containers are dealt over shards. A task takes one container after the
   other, sorts its suffixes and sweeps over them: neighbours tell by their common part where
   a node opens and closes. A container holds its whole subtree, so its counts are final.
3. The heads are counted by key. What subtrees add up to is summed from below: a node's
   share is booked on its smallest member, summed backwards along each conversation and then
   over the members of each head. No head is collected; a conversation of any length is
   summed in parts.

The digest of the conversations that end at a node is a sequential hash; for a head their
ids are joined to pieces of ``PIECE`` ids where they lie, and one task reads the pieces of a
head in order, holding one batch of them.

Cases: null role or text is empty; turns of equal number go by role and text, those without
number come first, repeated rows are repeated turns. Rows without a conversation id belong to
no conversation and are left out. Only the four named columns are read. An empty table has no
node at all, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.joins import small_join
from foliant.operators.ordered import Run, running
from foliant.session import cut_lineage

#: Rows (turns and roots) that one container may hold.
LIMIT = 20_000
#: Levels that are burst one by one.
ROUNDS = 10
#: Ids joined to one row before the digest of a head.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    group_limit: int = 1_000_000,
) -> DataFrame:
    """(conv, pos, t1, t2, bytes): turns from 1 on, with a 128-bit id and the UTF-8 length of the text."""
    said = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = running(said, ["conv"], ["turn", "role", "text"], [Run("pos", "count")], group_limit)
    return placed.select(
        "conv", "pos", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(7), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"))


def keyed_prefixes(rows: DataFrame, order: list[str], largest: int, group_limit: int = 1_000_000) -> DataFrame:
    """(conv, d, a, b, pa, pb, bytes): key of the first d turns and of the first d - 1.

    ``rows`` has conv, t1, t2, bytes and the columns of ``order``; ``largest`` bounds the turns of a conversation.
    """
    placed = running(rows, ["conv"], order, [Run("d", "count")], group_limit, largest)
    placed = placed.withColumn("ha", F.xxhash64("t1", "t2", "d")).withColumn("hb", F.xxhash64("d", "t2", "t1", F.lit(11)))
    summed = running(
        placed, ["conv"], ["d"], [Run("a", "xor", F.col("ha")), Run("b", "xor", F.col("hb"))], group_limit, largest)
    return summed.select(
        "conv", "d", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "bytes")


def _digest(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest() if convs else EMPTY


class _Node:
    __slots__ = ("depth", "bytes", "parent", "n", "least", "children", "leaves", "saved", "ends", "digest")

    def __init__(self, depth: int, size: int, parent: _Node | None):
        self.depth, self.bytes, self.parent = depth, size, parent
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.digest = None, [], EMPTY

    def close(self) -> None:
        self.n += len(self.ends)
        for c in self.ends:
            self.least = c if self.least is None else min(self.least, c)
        self.digest = _digest(self.ends)
        self.ends = []
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.bytes
        up = self.parent
        if up is not None:
            up.n, up.children, up.leaves, up.saved = up.n + self.n, up.children + 1, up.leaves + self.leaves, up.saved + self.saved
            up.least = self.least if up.least is None else min(up.least, self.least)


def sweep(depth: int, size: int, suffixes: list[tuple[list, int, list[int]]]) -> list[_Node]:
    """Nodes of one container, its top first: sorted suffixes (keys, conversation, text bytes) are swept once."""
    top = _Node(depth, size, None)
    nodes, stack, before = [top], [top], []
    for keys, conv, sizes in sorted(suffixes, key=lambda s: (s[0], s[1])):
        common = 0
        while common < len(before) and common < len(keys) and before[common] == keys[common]:
            common += 1
        while len(stack) - 1 > common:
            stack.pop().close()
        for at in range(common, len(keys)):
            node = _Node(depth + at + 1, sizes[at], stack[-1])
            nodes.append(node)
            stack.append(node)
        stack[-1].ends.append(conv)
        before = keys
    while stack:
        stack.pop().close()
    return nodes


_NODES = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
          ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("top", pa.bool_()),
          ("a", pa.int64()), ("b", pa.int64()), ("pa", pa.int64()), ("pb", pa.int64())]
_NODE_SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'boolean' if t == pa.bool_() else 'long'}" for n, t in _NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _NODES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _NODES)], names=[n for n, _ in _NODES])


def _sweep_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, ca, cb, conv, d, a, b, pa, pb, bytes), sorted by the first five, to the nodes of their containers."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    out: list[tuple] = []
    for (k, ca, cb), members in groupby(rows, key=lambda r: r[:3]):
        suffixes, up, size = [], (None, None), 0
        for conv, turns in groupby(members, key=lambda r: r[3]):
            first = next(turns)  # the row of the container's own head
            up, size = (first[7], first[8]), first[9]
            rest = list(turns)
            suffixes.append(([r[5:7] for r in rest], conv, [r[9] for r in rest]))
        for node in sweep(k, size, suffixes):
            top = node.parent is None
            out.append((
                node.least, node.depth, None if top else node.parent.least, node.n, node.children, node.leaves, node.saved, node.digest, top,
                *((ca, cb, *up) if top else (None,) * 4)))
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, a, b, conv) to (d, a, b, first, ids): up to PIECE ids in one text."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, members in groupby(rows, key=lambda r: r[:3]):
        held: list[int] = []
        for row in members:
            held.append(row[3])
            if len(held) == PIECE:
                yield _piece(key, held)
                held = []
        if held:
            yield _piece(key, held)


def _piece(key: tuple, held: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], pa.int64()) for v in (*key, held[0])] + [pa.array([",".join(map(str, held))])], names=["d", "a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (d, a, b, first) to one digest a node."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, members in groupby(rows, key=lambda r: r[:3]):
        code = hashlib.sha256(next(members)[4].encode())
        for row in members:
            code.update(b"," + row[4].encode())
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in key] + [pa.array([code.hexdigest()])], names=["d", "a", "b", "ends"])


def burst(prefixes: DataFrame, lengths: DataFrame, limit: int, rounds: int) -> tuple[DataFrame | None, bool]:
    """(conv, k, ca, cb): depth and key of the container in which the conversation ends up, and if any was burst.

    Conversations without a row ended at a head, or are burst at all their levels.
    """
    active, placed = lengths, None
    for k in range(rounds + 1):
        at = cut_lineage(prefixes.where(F.col("d") == k).select("conv", "a", "b").join(active, "conv"))
        sizes = at.groupBy("a", "b").agg(F.sum(F.col("len") - k + 1).alias("size"))
        large = cut_lineage(sizes.where(F.col("size") > limit).select("a", "b"))  # at most rows / limit of them
        over = not large.isEmpty()
        fits = small_join(at, large, ["a", "b"], "left_anti") if over else at
        fits = fits.select("conv", F.lit(k).cast("long").alias("k"), F.col("a").alias("ca"), F.col("b").alias("cb"))
        placed = fits if placed is None else placed.unionByName(fits)
        if not over:
            return placed, k > 0
        active = cut_lineage(small_join(at, large, ["a", "b"], "left_semi").select("conv", "len"))
    return placed, True


def nodes(prefixes: DataFrame, limit: int = LIMIT, rounds: int = ROUNDS, group_limit: int = 1_000_000) -> DataFrame:
    """All nodes of the trie of ``prefixes`` (conv, d, a, b, pa, pb, bytes), with one row of d = 0 for each conversation.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    shown = [n for n, _ in _NODES[:8]]
    lengths = cut_lineage(prefixes.groupBy("conv").agg(F.max("d").alias("len")))
    placed, any_burst = burst(prefixes, lengths, limit, rounds)
    # A conversation in a container is short, so a long one needs no join to be known as burst.
    long_ones = lengths.where(F.col("len") > limit + rounds).select("conv") if any_burst else None
    short = prefixes if long_ones is None else small_join(prefixes, long_ones, ["conv"], "left_anti")
    joined = cut_lineage(short.join(placed, "conv", "left"))
    held = joined.where("d >= k").select("k", "ca", "cb", "conv", "d", "a", "b", "pa", "pb", "bytes")
    swept = held.repartition("k", "ca", "cb").sortWithinPartitions("k", "ca", "cb", "conv", "d").mapInArrow(_sweep_shard, _NODE_SCHEMA)
    if not any_burst:
        return swept.select(*shown)
    swept = cut_lineage(swept)
    columns = ["conv", "d", "a", "b", "pa", "pb", "bytes"]
    above = joined.where("k IS NULL OR d < k").select(*columns).unionByName(small_join(prefixes, long_ones, ["conv"], "left_semi").select(*columns))
    above = cut_lineage(above)
    key = ["d", "a", "b"]
    heads = cut_lineage(above.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("conv").alias("least"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.max("bytes").alias("bytes")))
    tops = swept.where("top")
    below = heads.select(F.col("d"), "pa", "pb").unionByName(tops.select(F.col("depth").alias("d"), "pa", "pb")).where("d > 0")
    kids = below.groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    heads = cut_lineage(heads.join(kids, key, "left").withColumn("kids", F.coalesce("kids", F.lit(0))))

    none = F.lit(None).cast("long")
    shares = heads.select(
        F.col("least").alias("conv"), "d", ((F.col("n") - 1) * F.col("bytes")).alias("v"), (F.col("kids") == 0).cast("long").alias("leaf")).unionByName(
        tops.select(F.col("conv_id").alias("conv"), F.col("depth").alias("d"), F.col("saved_tokens").alias("v"), F.col("n_leaves").alias("leaf")))
    booked = shares.select("conv", (-F.col("d")).alias("up"), F.lit(0).alias("kind"), none.alias("a"), none.alias("b"), "v", "leaf").unionByName(
        above.select("conv", (-F.col("d")).alias("up"), F.lit(1).alias("kind"), "a", "b", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("leaf")))
    summed = running(booked, ["conv"], ["up", "kind"], [Run("vs", "sum", F.col("v")), Run("leaves", "sum", F.col("leaf"))], group_limit)
    totals = summed.where("kind = 1").groupBy((-F.col("up")).alias("d"), "a", "b").agg(F.sum("vs").alias("saved"), F.sum("leaves").alias("leaves"))

    last = above.join(lengths.select("conv", F.col("len").alias("d")), ["conv", "d"]).select(*key, "conv")
    pieces = last.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_pieces, "d long, a long, b long, first long, ids string")
    ends = pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "d long, a long, b long, ends string")

    full = heads.join(totals, key).join(ends, key, "left").select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"), "pa", "pb")
    hung = full.unionByName(tops.select(*full.columns)).withColumn("d", F.col("depth") - 1)
    parents = heads.select("d", F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("least").alias("parent_conv_id"))
    return small_join(hung, parents, ["d", "pa", "pb"], "left").select(*shown).unionByName(swept.where("NOT top").select(*shown))


def with_roots(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Add the row of depth 0 for each conversation of ``convs`` (conv), turnless ones included."""
    zero = F.lit(0).cast("long")
    return prefixes.unionByName(convs.select("conv", *[zero.alias(c) for c in ("d", "a", "b", "pa", "pb", "bytes")]))


def shared_beginnings(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    every: int = 5, most: int = 9, limit: int = LIMIT, rounds: int = ROUNDS, group_limit: int = 1_000_000,
) -> DataFrame:
    """Trie of rebuilt conversations.

    Conversation c begins with the first h turns of c - c % every, h being crc32(c) % most, and goes on with its own
    turns after its first h.
    """
    turns = cut_lineage(numbered_turns(turns, conv_col, turn_col, role_col, text_col, group_limit))
    largest = (turns.agg(F.max("pos")).first()[0] or 0) + most
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.where("pos = 1").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    start = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "t1", "t2", "bytes")
    lent = convs.where("base <> conv AND h > 0").join(start, "base").where("pos <= h")
    columns = ["conv", "part", "pos", "t1", "t2", "bytes"]
    own = turns.where((F.col("pos") > h) | (F.col("conv") % every == 0))
    rebuilt = lent.withColumn("part", F.lit(0)).select(*columns).unionByName(own.withColumn("part", F.lit(1)).select(*columns))
    prefixes = cut_lineage(with_roots(keyed_prefixes(rebuilt, ["part", "pos"], largest, group_limit), convs))
    return nodes(prefixes, limit, rounds, group_limit)


def conversation_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    limit: int = LIMIT, rounds: int = ROUNDS, group_limit: int = 1_000_000,
) -> DataFrame:
    """Trie of the conversations as they are."""
    turns = cut_lineage(numbered_turns(turns, conv_col, turn_col, role_col, text_col, group_limit))
    largest = turns.agg(F.max("pos")).first()[0] or 0
    convs = turns.where("pos = 1").select("conv")
    return nodes(cut_lineage(with_roots(keyed_prefixes(turns, ["pos"], largest, group_limit), convs)), limit, rounds, group_limit)
