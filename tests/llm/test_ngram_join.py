import random

import numpy as np

import foliant.llm.ngram_join as J
from tests.llm.cases import awkward, documents, lower_words


def sets_of(texts):
    out = []
    for t in texts:
        w = lower_words(t)
        out.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(texts, ids):
    sets = sets_of(texts)
    n = len(texts)
    near = [[j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in near[i]:
                label[i] = label[j] = min(label[i], label[j])
    return [(ids[i], min(ids[k] for k in range(n) if label[k] == label[i]), len(near[i]),
             len({sets[j] for j in near[i]} - {sets[i]}), 1 + sum(sets[j] == sets[i] for j in near[i])) for i in range(n)]


def corpus(seed, groups, size):
    """Groups of near copies at all distances, a common passage, and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            texts += [" ".join(own)] * rng.choice([1, 1, 1, 2])
        texts.append(passage + " " + " ".join(base))
    return texts


def check(spark, texts):
    ids = list(range(len(texts)))
    got = J.link(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"], r["n_copies"]) for r in got] == brute(texts, ids)


def test_against_brute_force(spark):
    check(spark, [*corpus(1, 30, 8), "one", "one", "ONE.", "two words", "a b c d e", "a b c d e f"])


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "LIMIT", 16)
    monkeypatch.setattr(J, "BLOCK", 8)
    check(spark, corpus(2, 3, 60))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r["doc_id"], r["hash"]): r for r in J.link(docs).collect()}
    assert len(J.link(docs).collect()) == docs.count()
    for (i, _), r in got.items():
        if i in (0, 1, 2, 3):
            assert (r["class_id"], r["n_links"]) == (i, 0)
        if i in (7, None):
            assert (r["class_id"], r["n_links"], r["n_copies"]) == (7, 2, 3)
    kept = J.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_empty_table_and_no_links(spark):
    assert J.link(documents(spark, ["a"]).limit(0)).count() == 0
    assert J.link(documents(spark, ["a b c", "d e f"])).where("n_links > 0").count() == 0


def test_spanning_connects_what_is_near():
    near = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        near[a, b] = near[b, a] = True
    edges = J.spanning(near)
    assert len(edges) == 3 and all(near[a, b] for a, b in edges)


def test_runs_follow_the_recall():
    assert J.runs_for(0.9) < J.runs_for(0.999) < J.runs_for(0.999999)


def near_group(seed, size, words, edits):
    """Near copies of one text."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def compared(spark, monkeypatch, texts):
    """Rows that are dealt out to be compared by sketch."""
    rows = []
    streamed = J._streamed

    def counting(frame, keys, *rest):
        if keys[0] == "node":
            rows.append(frame.count())
        return streamed(frame, keys, *rest)

    with monkeypatch.context() as m:
        m.setattr(J, "_streamed", counting)
        J.link(documents(spark, texts)).count()
    return sum(rows)


def test_a_group_that_is_joined_takes_few_rows_in_later_runs(spark, monkeypatch):
    monkeypatch.setattr(J, "LIMIT", 32)
    texts = near_group(5, 320, 400, 2)
    assert compared(spark, monkeypatch, texts) < 16 * len(texts)  # 28 buckets a record, in up to 10 blocks, without


def test_links_beyond_a_joined_group_are_found(spark, monkeypatch):
    """Texts that only some records of a large group are near to, and chains of such texts."""
    monkeypatch.setattr(J, "LIMIT", 16)
    monkeypatch.setattr(J, "BLOCK", 8)
    group = near_group(7, 90, 120, 2)
    rng = random.Random(8)
    far = []
    for i in range(12):
        own = group[7 * i].split()
        for _ in range(3):
            own[rng.randrange(len(own))] = f"y{rng.randrange(10**6)}"
        far.append(" ".join(own))
        own = own[:10] + own[14:]
        far.append(" ".join(own))
    check(spark, [*group, *far, *corpus(9, 4, 20)])


def passage_group(seed, size):
    """Texts of a common passage and as many words of their own: in the same buckets, but not near."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(100)]
    return [" ".join(passage + [word() for _ in range(60)]) for _ in range(size)]


def test_records_of_a_bucket_that_is_split_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(J, "LIMIT", 16)
    monkeypatch.setattr(J, "BLOCK", 8)
    texts = passage_group(11, 150)
    rows = {"leaves": 0, "joined": 0}
    shared, join = J._shared, type(spark.range(1)).join

    def counting_leaves(leaves, *rest, **more):
        rows["leaves"] += leaves.count()
        return shared(leaves, *rest, **more)

    def counting_join(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and on == "node" and how is None and "record" in self.columns:
            rows["joined"] += out.count()
        return out

    with monkeypatch.context() as m:
        m.setattr(J, "_shared", counting_leaves)
        m.setattr(type(spark.range(1)), "join", counting_join)
        J.link(documents(spark, texts)).count()
    assert 0 < rows["joined"] <= rows["leaves"]  # each depth of the large buckets was joined three times
    check(spark, [*texts[:40], *corpus(12, 3, 8)])


def test_stars_connect_what_is_near():
    rng = np.random.default_rng(4)
    near = rng.random((40, 40)) < 0.03
    near |= near.T
    np.fill_diagonal(near, False)
    part = list(range(40))
    for _ in range(40):
        for i, j in zip(*np.nonzero(near)):
            part[i] = part[j] = min(part[i], part[j])
    assert sorted(J.stars(near)) == sorted((p, i) for i, p in enumerate(part) if p != i)
