"""Base patterns against regular expressions; the tagger by its gradient, held-out accuracy and cuts of windows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import foliant.llm.bilstm as B
import foliant.llm.pii as P
from foliant.session import table
from tests.llm.cases import awkward, documents

SF = "/root/testdata/sf0.01"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            checks = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                      12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0,
                      9 <= len(digits) <= 15]
            if checks[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(deadline=None, max_examples=600)
@given(st.text("a.@-1290+() %é\n", max_size=40))
def test_base_against_patterns(text):
    assert P.base_spans(text) == plain(text)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["4111111111111111", "4111-1111 1111-1111", "a@b.c", "@", ".", "a@b.c.d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (171) 555-2028",
                                 "+49 30", " ", "-", "0", "é", "x"]), max_size=8).map("".join))
def test_base_on_parts(text):
    assert P.base_spans(text) == plain(text)


def test_base_is_linear():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1" + " " * 1_000_000, "a@" * 500_000, "9" * 5000 + ".1.1.1"):
        P.base_spans(text)


def test_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in B.init(7, 3, rng, hidden=4, embed=3).items()}
    x, y = rng.integers(0, 7, (6, 5)), rng.integers(0, 3, (6, 5))
    _, grad = B.loss_and_gradient(p, x, y)
    for name, values in p.items():
        flat = values.reshape(-1)
        for at in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[at]
            flat[at] = old + 1e-6
            above = B.loss_and_gradient(p, x, y)[0]
            flat[at] = old - 1e-6
            below = B.loss_and_gradient(p, x, y)[0]
            flat[at] = old
            assert abs((above - below) / 2e-6 - grad[name].reshape(-1)[at]) < 1e-5, name


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    p = B.init(7, 3, rng, hidden=4, embed=3)
    x = rng.integers(0, 7, (5, 4))
    e, _ = B.emissions(p, x)
    tags, _ = B.decode(p, x)
    assert np.allclose(B.tag_scores(p, x).transpose(0, 2, 1), e, atol=1e-5)
    paths = np.stack(np.meshgrid(*[range(3)] * 5, indexing="ij"), -1).reshape(-1, 5)
    for b in range(4):
        score = p["start"][paths[:, 0]] + e[np.arange(5), b][np.arange(5), paths].sum(1) + p["step"][paths[:, :-1], paths[:, 1:]].sum(1)
        assert tags[:, b].tolist() == paths[score.argmax()].tolist()


@pytest.fixture(scope="module")
def tagger(spark):
    return P.train(P.draw_sample(table(spark, SF, "documents")))


def test_held_out_forms(spark, tagger):
    """Broken-up forms in texts that were not learned from; nothing is added to clean texts."""
    texts = [r["text"] for r in table(spark, SF, "documents").where("length(text) BETWEEN 200 AND 3000").orderBy("doc_id").collect()]
    rng = np.random.default_rng(77)
    found = asked = added = 0
    for text in texts[:400]:
        kind, said = P.personal(rng)
        words = text[:300].split(" ")
        at = int(rng.integers(0, len(words) + 1))
        head = " ".join(words[:at]) + (" " if at else "")
        spans = P.all_spans(tagger.parameters, [head + said + " " + " ".join(words[at:])])[0]
        found += (len(head), kind, len(head) + len(said)) in {s[:3] for s in spans}
        asked += 1
    for spans in P.all_spans(tagger.parameters, [t for t in texts if not P.base_spans(t)]):
        added += bool(spans)
    assert found / asked >= 0.8
    assert added <= len(texts) * 0.005


def test_cut_covers_and_long_texts(tagger):
    for n in (0, 1, P.WINDOW, P.WINDOW + 1, 1000):
        owner, start = P.cut(np.array([n]))
        covered = np.zeros(n, int)
        for s in start:
            covered[s:s + P.WINDOW] += 1
        assert (covered > 0).all() and (not n or start[-1] + P.WINDOW >= n)
    said, found = "97[.]51[.]17[.]173", 0
    shifts = range(0, 2 * P.STRIDE, 7)
    for shift in shifts:  # wherever the windows are cut
        text = ("the words of a text that is long " * 20)[shift:] + said + " and more words follow here"
        found += [s[:3] for s in P.all_spans(tagger.parameters, [text])[0]] == [(text.index(said), 1, text.index(said) + len(said))]
    assert found >= 0.85 * len(shifts)


def test_windows_passed_over_hold_nothing(spark, tagger):
    texts = [r["text"] for r in table(spark, SF, "documents").where("text IS NOT NULL AND length(text) < 6000").orderBy("doc_id").limit(400).collect()]
    rng = np.random.default_rng(5)
    texts = [t[:len(t) // 2] + " " + (P.personal(rng)[1] if k % 3 else P.look_alike(rng)) + " " + t[len(t) // 2:] for k, t in enumerate(texts)]
    assert P.all_spans(tagger.parameters, texts) == P.all_spans(tagger.parameters, texts, everywhere=True)
    noisy = {k: v + rng.normal(0, 0.4, v.shape).astype(v.dtype) for k, v in tagger.parameters.items()}  # one that tags a lot
    assert P.all_spans(noisy, texts[:120]) == P.all_spans(noisy, texts[:120], everywhere=True)


def test_spans_cut_by_windows_are_joined():
    text = "a" * 10 + " (017) 555-7713 " + "b" * 10
    left, right = (11, 3, 19, 4.0, True), (15, 3, 25, 5.0, True)
    assert P.reconcile(text, [left, right]) == [(11, 3, 25)]
    assert P.reconcile(text, [left]) == []  # half a number fails its check
    assert P.reconcile(text, [left, (11, 3, 25, 7.0, False), right]) == [(11, 3, 25)]


def test_choice_over_overlaps():
    assert P.choose([(0, 0, 10, 5.0), (0, 1, 4, 3.0), (5, 1, 9, 3.0), (12, 2, 15, 1.0)]) == [(0, 1, 4), (5, 1, 9), (12, 2, 15)]
    assert P.choose([]) == []


def test_query_against_plain_patterns(spark):
    from foliant.llm.queries import op12_pii

    got = {r["doc_id"]: r for r in op12_pii(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans, r = plain(d["text"] or ""), got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        said = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(","))


def test_awkward_rows_and_masks(spark, tagger):
    docs = awkward(spark)
    got = P.find(docs, tagger, ["doc_id", "_row", "kept"])
    assert got.count() == docs.count() and got.columns == ["doc_id", "_row", "kept", "spans"]
    assert all(not r["spans"] for r in got.collect())
    assert P.find(docs.limit(0), P.train(P.draw_sample(docs.limit(0))), ["doc_id"]).count() == 0
    two = documents(spark, ["mail a@b.de or +1 (171) 555-2028 \U0001F600 now", None])
    shown = P.find(two, P.Tagger(None), ["doc_id", "text"]).select(P.masked("text", "spans").alias("m")).collect()
    assert [r["m"] for r in shown] == ["mail [EMAIL] or [PHONE] \U0001F600 now", None]
