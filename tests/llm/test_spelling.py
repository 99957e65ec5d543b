"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import foliant.llm.spelling as S
from tests.llm.cases import awkward, documents

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows, every=199, least=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault(w[:i] + "?" + w[i + 1:], set()).add(w)
            holes.setdefault(w[:i] + w[i + 1:], set()).add(w)
        holes.setdefault(w, set()).add(w)
    met = {w: {o for i in range(len(w)) for p in (w[:i] + "?" + w[i + 1:], w[:i] + w[i + 1:], w) for o in holes[p] if near(w, o)} for w in n}
    form = {}
    for w in n:
        best = min(met[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(met[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def columns(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def vocabulary(seed, letters, n, lengths=(6, 14)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        words.add(w[:i] + ("" if kind == 0 else rng.choice(letters)) + w[i + (kind < 2):])
    return sorted(w for w in words if len(w) >= 6)


@pytest.mark.parametrize("letters,few,most", [("ab", 1, 1 << 20), ("abé", 3, 1 << 20), ("abcd", 64, 1 << 20), ("abc", 2, 50), ("aÿ", 10**9, 1 << 20)])
def test_pairs_against_all_pairs(spark, letters, few, most):
    words = vocabulary(len(letters) + few, letters, 300)
    want = {(a, b) for a in words for b in words if near(a, b) and (len(a), a) < (len(b), b)}
    got = [tuple(r) for r in S.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), few, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bound_holds_for_every_edit():
    """All but the bounded number of grams of a word are grams of any word one edit apart, in order."""
    rng = random.Random(5)
    words = vocabulary(9, "abc", 200)
    found = np.unique(np.concatenate([code[there] for _, code, there in S._Padded(words).grams()]), return_counts=True)
    often = found[1] > 5
    frequent = (found[0][often], found[1][often])

    def grams(w):
        padded = S._Padded([w])
        made = S.decompose(padded, frequent)
        return [(int(h), int(p)) for h, p in zip(made["hash"], made["place"])], int(S.affected_bounds(padded, made)[0])

    for w in words:
        i, c = rng.randrange(len(w)), rng.choice("abc")
        for other, shift in ((w[:i] + c + w[i + 1:], 0), (w[:i] + c + w[i:], 1), (w[:i] + w[i + 1:], -1)):
            own, bound = grams(w)
            theirs = set(grams(other)[0])
            kept = sum((h, p) in theirs if p + 1 <= i + S.PAD else (h, p + shift) in theirs for h, p in own)
            assert len(own) - kept <= bound


def test_whole_query(spark):
    words = vocabulary(3, "abcdefg", 60)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(120)) for _ in range(30)]
    texts += [" ".join([words[0]] * 400), "recieve " * 6 + "receive " * 40 + "receives " * 300, None, "", "1234 !!"]
    rows = list(enumerate(texts))
    for every in (199, 3):
        assert columns(S.variants(documents(spark, texts), every=every)) == brute(rows, every)


def test_chains_and_ties(spark):
    texts = ["abcdef " * 5 + "abcdeg " * 30 + "abcdhg " * 200 + "abidhg " * 1200 + "zzzzzz " * 5 + "zzzzza " * 25 + "zzzzzb " * 25]
    got = columns(S.variants(documents(spark, texts), every=10**9))
    assert got == brute([(0, texts[0])], 10**9)
    assert {r[0]: r[5] for r in got}["abcdef"] == "abidhg" and {r[0]: r[3] for r in got}["zzzzzz"] == "zzzzza"


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert columns(S.variants(docs, min_count=1)) == brute(rows, least=1)
    long = "ab" * 400
    texts = [f"{long} {long}x {long[:-1]}", "ÀÿÏÎÍ× ÀÿÏÎÍ÷"] * 5
    assert columns(S.variants(documents(spark, texts), every=10**9)) == brute(list(enumerate(texts)), 10**9)
    long = "abc" * 30_000  # too long for the plain version
    got = S.variants(documents(spark, [f"{long} {long}x {long[:-1]}"] * 5), every=10**9).collect()
    assert sorted((len(r["word"]), r["n"], r["n_near"], r["form"]) for r in got) == [(89_999, 5, 1, None), (90_000, 5, 2, None), (90_001, 5, 1, None)]
    assert S.variants(docs.limit(0)).count() == 0
