"""Language and toxicity models: learned behaviour, plain recomputation, awkward rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid, toxicity
from foliant.llm.bytetext import words
from tests.llm.cases import awkward, documents, lower_words

RNG = random.Random(11)
LANGS = {"xx": ["ba", "bo", "bi"], "yy": ["zu", "ze", "zi"], "zz": ["qué", "ñu", "tó"]}


def text(lang, n):
    return " ".join("".join(RNG.choice(LANGS[lang]) for _ in range(RNG.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def language_model(spark):
    names = [RNG.choice(["xx", "xx", "xx", "yy", "zz"]) for _ in range(400)]
    docs = documents(spark, [text(g, RNG.randint(3, 60)) for g in names] + [None, "no label"], langs=[*names, "xx", None])
    return langid.train(langid.draw_sample(docs, "doc_id", "text", "lang", 150))


def test_language_of_new_texts(spark, language_model):
    names = ["xx", "yy", "zz"] * 40
    docs = documents(spark, [text(g, RNG.randint(3, 40)) for g in names], langs=names)
    got = langid.predict(docs, language_model, ["doc_id", "lang"])
    assert got.where("lang = lang_pred AND NOT rejected").count() >= 118
    assert got.where("score < 0 OR score > 1").count() == 0


def test_unknown_texts_are_rejected(spark, language_model):
    got = langid.predict(documents(spark, ["日本語の文章です", "ыва фыва", "123 456", None, ""]), language_model, ["doc_id"]).orderBy("doc_id").collect()
    assert all(r["rejected"] for r in got)
    assert [r["lang_pred"] == "und" for r in got] == [False, False, True, True, True]
    assert [r["score"] == 0 for r in got] == [False, False, True, True, True]


@pytest.mark.parametrize("names", [["xx"], ["xx", "yy"], ["xx", "yy", "zz"]])
def test_few_languages_have_a_threshold_too(spark, names):
    learn = [names[k % len(names)] for k in range(90 * len(names))]
    docs = documents(spark, [text(g, RNG.randint(3, 60)) for g in learn], langs=learn)
    model = langid.train(langid.draw_sample(docs, "doc_id", "text", "lang", 150))
    assert model.threshold > 0
    strange = ["ba zu " + " ".join("".join(RNG.choices("cdfghjklmnprstvwxq", k=7)) for _ in range(30)) for _ in range(50)]
    got = langid.predict(documents(spark, strange), model, ["doc_id"])
    assert got.where("rejected").count() >= 40  # they hold two known words each
    got = langid.predict(documents(spark, [text(g, RNG.randint(3, 60)) for g in names * 60]), model, ["doc_id"])
    assert got.where("NOT rejected").count() >= 58 * len(names)


def test_language_of_awkward_rows(spark, language_model):
    docs = awkward(spark)
    got = langid.predict(docs, language_model, [F.struct("*").alias("row")])
    assert got.count() == docs.count() and got.where("lang_pred = 'und'").count() == 4
    assert langid.predict(docs.limit(0), language_model, ["doc_id"]).count() == 0


def test_no_labels_means_unknown(spark):
    docs = documents(spark, ["a b"], langs=[None])
    assert langid.train(langid.draw_sample(docs, "doc_id", "text", "lang", 10)) is None
    assert langid.predict(docs, None, ["doc_id"]).first()["lang_pred"] == "und"


def test_sample_is_bounded(spark):
    docs = documents(spark, ["same text"] * 500, [1] * 500, ["xx"] * 500)
    assert len(langid.draw_sample(docs, "doc_id", "text", "lang", 10)) <= 20


def grams(word):
    s = [1, *word.encode(), 2]
    return [tuple(s[max(0, i - 5):i + 1]) for i in range(1, len(s))]


def plain_ratios(rows):
    """Ratio of every counted n-gram and context by the formulas, in plain Python."""
    count = {c: Counter() for c in (True, False)}
    for t, label in rows:
        for w in lower_words(t):
            count[label].update(grams(w))
    events = set(count[True]) | set(count[False])
    kinds = {k: {g[-k:] for g in events if len(g) >= k} for k in range(1, 7)}
    n = {k: Counter(g[1:] for g in kinds[k + 1]) for k in range(1, 6)}

    def shared(g):
        if not g:
            return 1 / 256
        own = {x: v for x, v in n[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        return (max(own[g] - 0.75, 0) + 0.75 * len(own) * shared(g[1:])) / total

    total, types = {}, {}
    for c in count:
        total[c], types[c] = defaultdict(int), defaultdict(int)
        for g, v in count[c].items():
            total[c][g[:-1]] += v
            types[c][g[:-1]] += 1

    def weight(c, h):
        return 0.75 * types[c][h] / total[c][h] if total[c][h] else 1.0

    def p(c, g):
        h = g[:-1]
        return (max(count[c][g] - 0.75, 0) / total[c][h] if total[c][h] else 0) + weight(c, h) * shared(g[1:])

    out = {g: math.log(p(True, g) / p(False, g)) for g in events}
    contexts = {h: math.log(weight(True, h) / weight(False, h)) for h in {g[:-1] for g in events}}
    return out, contexts


def test_toxicity_features_follow_the_formulas(spark):
    rows = [(text("xx", 8) + (" badword" if k % 3 == 0 else ""), k % 3 == 0) for k in range(40)]
    model = toxicity.fit(spark.createDataFrame([*rows, (None, True), ("x", None)], "text string, label boolean"))
    ratio, context = plain_ratios(rows)
    texts = ["", None, "badword", "ba bo", rows[0][0], "unseen words QQ"]
    got = toxicity.features(documents(spark, texts), model, ["doc_id"]).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        per = [[ratio.get(g, context.get(g[:-1], 0.0)) for g in grams(w)] for w in lower_words(t)]
        n = sum(map(len, per))
        assert r["mean_ratio"] == pytest.approx(sum(map(sum, per)) / n if n else 0, abs=1e-4)
        assert r["peak_ratio"] == pytest.approx(max((sum(x) / len(x) for x in per), default=0), abs=1e-4)


def test_every_counted_ngram_keeps_its_ratio(spark):
    odd = ["".join(chr(97 + (k * p) % 26) for p in (1, 3, 7, 11, 17)) + f"{k:x}" for k in range(60_000)]
    rows = [(" ".join(odd[k:k + 100]), k % 300 == 0) for k in range(0, 60_000, 100)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label boolean"))
    found = {g for t, _ in rows for w in t.split() for g in grams(w)}
    assert model.grams.select("key").distinct().count() == model.grams.count() == len(found) + len({g[:-1] for g in found})


def test_word_features_follow_the_formulas(spark):
    rows = [(text("xx", 8) + (" badword more badword" if k % 3 == 0 else " fine"), k % 3 == 0) for k in range(40)]
    model = toxicity.fit(spark.createDataFrame([*rows, (None, True), ("x", None), ("", False)], "text string, label boolean"))
    held = {c: defaultdict(int) for c in (True, False)}
    before = defaultdict(set)
    for t, label in rows:
        w = lower_words(t)
        for x in set(w):
            held[label][x] += 1
        for a, b in zip([None, *w], w):
            before[b].add(a)
    kinds = sum(map(len, before.values()))

    def p(c, w):
        total, lost = sum(held[c].values()), sum(min(v, 3) for v in held[c].values())
        return max(held[c][w] - 3, 0) / total + lost / total * len(before[w]) / kinds

    ratio = {w: math.log(p(True, w) / p(False, w)) for w in before}
    texts = ["", None, "badword", "unseen fine badword badword", rows[0][0], "unseen words QQ"]
    for t, r in zip(texts, toxicity.features(documents(spark, texts), model, ["doc_id"]).orderBy("doc_id").collect()):
        per = [ratio.get(w) for w in lower_words(t)]
        met = [x for x in per if x is not None]
        assert r["word_mean"] == pytest.approx(sum(met) / len(per) if per else 0, abs=1e-4)
        assert r["word_peak"] == pytest.approx(max(met, default=0), abs=1e-4)


def test_words_alone_find_toxic_texts_of_every_label_table(spark):
    """Held-out rows of the given labels, with the symbols' peak set aside."""
    from foliant.llm.queries import op9_toxicity
    from foliant.session import table

    sf = "/root/testdata/sf0.1"
    told = op9_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("toxic IS NOT NULL").cache()
    both = [r for r in told.select("held_out", "toxic", "predicted", "word_mean", "word_peak").collect()]
    held = [r for r in both if r["held_out"]]
    hits = sum(r["toxic"] and r["predicted"] for r in held)
    assert hits >= 0.85 * sum(r["toxic"] for r in held) and hits >= 0.85 * sum(r["predicted"] for r in held)
    weights = toxicity.calibrate(told.where("NOT held_out").select(
        "word_mean", "word_peak", F.lit(0.0).alias("peak_ratio"), (F.col("toxic") == 1).alias("label")))
    alone = told.where("held_out").withColumn("peak_ratio", F.lit(0.0)).withColumn("s", toxicity.score(weights))
    assert alone.where("toxic = 1 AND s >= 0.3").count() >= 0.8 * sum(r["toxic"] for r in held)
    told.unpersist()


@pytest.mark.parametrize("hot", [0, 6, 1000])
def test_a_model_too_large_to_send_gives_the_same_features(spark, hot):
    rows = [(text("yy", 8) + (" badword" if k % 3 == 0 else ""), k % 3 == 0) for k in range(40)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label boolean"))
    docs = awkward(spark).unionByName(documents(spark, ["badword BADWORD zuzeqq", rows[0][0], "new words " * 5], [20, None, 20])).coalesce(3)
    keep = ["doc_id", "text"]
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    plain = order(toxicity.features(docs, model, keep))
    joined = order(toxicity.features(docs, model, keep, sent=0, hot=hot))
    assert [r[:2] for r in joined] == [r[:2] for r in plain]
    assert np.allclose([r[2:] for r in joined], [r[2:] for r in plain], atol=1e-5)


def test_toxic_texts_are_found(spark):
    def make(k):
        toxic = k % 4 == 0
        w = text("xx", RNG.randint(5, 80)).split()
        if toxic:
            w.insert(RNG.randrange(len(w)), RNG.choice(["vilething", "viledog", "vilecat"]))
        return k, " ".join(w), toxic

    docs = spark.createDataFrame([make(k) for k in range(900)], "doc_id long, text string, label boolean")
    model = toxicity.fit(docs.where("doc_id < 500"))
    weights = toxicity.calibrate(toxicity.features(docs.where("doc_id BETWEEN 500 AND 699"), model, ["doc_id", "label"]))
    got = toxicity.features(docs.where("doc_id >= 700"), model, ["doc_id", "label"]).withColumn("score", toxicity.score(weights))
    assert got.where("label = (score >= 0.3)").count() >= 198
    assert got.where("score < 0 OR score > 1").count() == 0


def test_toxicity_without_a_class(spark):
    rows = spark.createDataFrame([("a b", False)], "text string, label boolean")
    for own in (rows, rows.limit(0)):
        model = toxicity.fit(own)
        features = toxicity.features(awkward(spark), model, ["doc_id"])
        weights = toxicity.calibrate(features.withColumn("label", F.lit(False)).limit(own.count()))
        assert features.withColumn("score", toxicity.score(weights)).agg(F.max("score")).first()[0] == 0.0


def test_every_ngram_key_is_exact():
    found = words(pa.array(["ab é"]))
    key, owner, symbols = toxicity._grams(found, np.arange(2))
    want = [sum(b << (8 * k) for k, b in enumerate(reversed(g))) for w in ("ab", "é") for g in grams(w)]
    assert key.tolist() == want and symbols.tolist() == [3, 3] and owner.tolist() == [0] * 3 + [1] * 3
