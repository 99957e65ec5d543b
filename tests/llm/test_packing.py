import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from foliant.llm.packing import _Encoder, pack, pieces, plan_bins
from foliant.llm.queries import tokenizer_path
from tests.llm.cases import LONG, awkward, documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return _Encoder(tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))


def same(encoder, tokenizer, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_both_ways_give_the_same_ids(encoder, tokenizer):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "1", "é", "日", "\u3000", ".", "%%", "<|endoftext|>", "ß", "²", "\xa0", "\xad"]
    for _ in range(1500):
        same(encoder, tokenizer, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
    for code in [*range(0x250), *range(0x250, 0xD800, 97)]:
        same(encoder, tokenizer, f"a{chr(code)}b {chr(code)}1 {chr(code)}{chr(code)} x")


def test_long_runs(encoder, tokenizer):
    for text in ("a" * 30_000, " " * 30_000, "\n" * 30_000 + "x", "ab " * 20_000, LONG):
        same(encoder, tokenizer, text)


def plain_bins(lengths, capacity):
    """Best-two-fit, one bin after the other."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        own, room = [], capacity
        for x in list(left):
            if x <= room:
                own.append(x)
                left.remove(x)
                room -= x
        while room and own:
            best = None
            for i, a in enumerate(left):
                for b in left[i + 1:]:
                    if own[-1] < a + b <= room + own[-1] and (best is None or (a + b, a) > (sum(best), best[0])):
                        best = a, b
            if best is None:
                break
            small = own.pop()
            for x in best:
                left.remove(x)
            left = sorted([*left, small], reverse=True)
            room += small - sum(best)
            own = sorted([*own, *best], reverse=True)
        bins.append(own)
    return bins


def test_counted_plan_equals_one_bin_after_the_other():
    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        plan = plan_bins(counts, capacity)
        got = sorted(tuple(own) for own, times in plan for _ in range(times))
        assert got == sorted(map(tuple, plain_bins(lengths, capacity)))


def check(docs, tokenizer, capacity):
    rows = pack(pieces(docs, tokenizer_path(), capacity, 0, keep=["doc_id"], with_ids=True), capacity).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for d in docs.collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want += [(str(d["doc_id"]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    return len(by_sequence), sum(r["length"] for r in rows)


def test_pieces_and_places(spark, tokenizer):
    rng = random.Random(4)
    docs = documents(spark, [" ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(rng.randint(0, 120))) for _ in range(200)] + [LONG[:20_000]])
    bins, total = check(docs, tokenizer, 64)
    assert bins <= total / 64 * 1.03 + 1


def test_awkward_rows(spark, tokenizer):
    check(awkward(spark), tokenizer, 2048)
    whole = pack(pieces(awkward(spark), tokenizer_path()))
    assert {"kept", "_row", "_text", "_part", "length"} <= set(whole.columns) and whole.count() > 11


def test_empty_table(spark):
    assert pack(pieces(documents(spark, ["a"]).limit(0), tokenizer_path())).count() == 0
