"""Burst trie of conversations against plain Python."""

import hashlib
import random
import zlib

import pytest

import foliant.llm.trie as T
from tests.llm.cases import CLASHES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in (*CLASHES, "conv", "d", "a", "pos"))
    return spark.createDataFrame([(*r, *["x"] * (len(CLASHES) + 4)) for r in rows], f"conv_id long, turn long, role string, text string, {extra}")


def brute(rows, rebuild=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [k[2:] for k in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = [*own.get(base, [])[:h], *turns[h:]]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    total = {}
    for key in sorted(nodes, key=len, reverse=True):
        leaves, saved = (0 if key in kids else 1), (len(nodes[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        for k in kids.get(key, []):
            leaves, saved = leaves + total[k][0], saved + total[k][1]
        total[key] = leaves, saved
    return sorted([(
        min(m), len(key), min(nodes[key[:-1]]) if key else None, len(m), len(kids.get(key, [])), *total[key],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(key)).encode()).hexdigest()) for key, m in nodes.items()], key=str)


def check(spark, rows, **options):
    got = T.shared_beginnings(conversations(spark, rows), **options).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def some(seed, n, words="ab", longest=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("limit,rounds", [(20_000, 10), (30, 10), (1, 3), (25, 1)])
def test_against_plain_python(spark, limit, rounds):
    check(spark, some(1, 120), limit=limit, rounds=rounds)


def test_copies_long_conversations_and_combs(spark):
    same = [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(9)]
    long = [(5, t, "user", f"turn {t}") for t in range(400)]
    comb = [(c, t, "user", f"turn {t}") for c in range(200, 240) for t in range(c - 190)]
    check(spark, [*same, *long, *comb, *some(2, 20)], limit=40, rounds=4)
    check(spark, [*same, *long, *comb], limit=40, rounds=2, group_limit=50)


def test_many_ends_at_one_head(spark):
    check(spark, [(5 * c, 0, "user", "hello") for c in range(T.PIECE + 60)], limit=4, rounds=2)


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "", ""),
        (1, 2, "user", "x" * 300_000), (2, 5, "b", "tie"), (2, 5, "a", "tie"), (2, 5, "a", "also"), (-7, 1, "user", "Ünï 日本 \U0001F600"),
        (-5, 1, "user", "a"), (-5, 2, "user", "b"), (3, None, None, None), (10**15, 1, "ab", "c"), (10**15 + 5, 1, "a", "bc")]
    check(spark, rows)
    check(spark, rows, limit=1, rounds=2)


def test_empty_table_and_plain_trie(spark):
    assert T.shared_beginnings(conversations(spark, some(1, 2)).limit(0)).count() == 0
    rows = some(4, 50, "abc")
    got = T.conversation_trie(conversations(spark, rows), limit=20).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, rebuild=False)
