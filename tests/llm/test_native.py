"""URL filters, quality rules, license scans and chat: their SQL on the small tables, and awkward rows."""

import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, licenses, quality, urlfilter
from tests.llm.cases import CLASHES, LONG, awkward, documents


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.Org/x", "http://x.org", "https://example.org/es/9", "https://m.example.org/en/12?q", "http://example.org/en/2",
            "http://notexample.org/es/", "http://a.com/fr/1#x", "http://a.com/de/", "http://org.net/org/", "http://m.free-bets.a.net/", "http://a.net/Adult/x",
            "http://a.net/adulthood", "http://a.com:80/de/1", "x://y://z.org/a", "http://bets.org/a", "http://a.net?adult"]
    df = spark.createDataFrame([(i, u, "r", 3, "x") for i, u in enumerate(urls)], "page_id long, url string, _row string, token int, `_f` string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in urlfilter.judge(df).collect()}
    want = [("", "", None, "allow", None)] * 3 + [
        ("a.org", "/x", "org/", "allow", None), ("x.org", "", None, "allow", None), ("example.org", "/es/9", "example.org/es/", "block", None),
        ("m.example.org", "/en/12", "example.org/en/1", "block", None), ("example.org", "/en/2", "org/", "allow", None),
        ("notexample.org", "/es/", "org/", "allow", None), ("a.com", "/fr/1", "com/fr/", "allow", None), ("a.com", "/de/", "com/de/", "block", None),
        ("org.net", "/org/", None, "allow", None), ("m.free-bets.a.net", "/", None, "block", "free-bets"), ("a.net", "/Adult/x", None, "block", "adult"),
        ("a.net", "/adulthood", None, "allow", None), ("a.com:80", "/de/1", None, "allow", None), ("y:", "//z.org/a", None, "allow", None),
        ("bets.org", "/a", "org/", "allow", None), ("a.net", "", None, "allow", None)]
    assert [got[i] for i in range(len(urls))] == want
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://a.example.org/en/1",)] * 3 + [("http://b.org/",)], "url string")
    counts = urlfilter.token_counts(df, "url", ["example", "org", "en", "zz"])
    assert counts == {"example": 3, "org": 4, "en": 3}
    n = {r["url"]: r["n_candidates"] for r in urlfilter.judge(df).collect()}
    # org/ by org, example.org/en/1 by en; example.org/es/ is filed under es, which no URL has.
    assert n == {"http://b.org/": 1, "http://a.example.org/en/1": 2}


def plain_repeat(w):
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_quality_counts(spark):
    texts = ["a b c a b c", "a a a a a", "x y z", "one two", "a b c d\x0ba b c\x0cq r s q r s t", "l1\nl1\n\n \nl1 \nL2", "#* $% | <>&\n#", "é  日\t本"]
    got = quality.judge(documents(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), plain_repeat(w)), t


def test_bad_lines_go_and_bad_documents_too(spark):
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(12))
    bad = ["Home | News | About | Contact", "WOW!! BUY!! NOW!! HERE!!", "Please accept all cookies.", "$$$ %%% &&& ***"]
    docs = documents(spark, [good, good + "\n" + "\n".join(bad), "\n".join(bad * 12) + "\n" + good[:300], good.replace(" ", "   ")])
    got = quality.judge(docs).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [True, True, False, True]
    assert [r["n_removed_lines"] for r in got][:2] == [0, 4] and got[1]["clean_text"] == good and got[0]["clean_text"] == good
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["n_chars"] for r in kept.collect()}[1] == len(good)


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    got = quality.judge(docs)
    assert got.count() == docs.count() and set(CLASHES) - {"kept", "n_words"} <= set(got.columns)
    assert got.where("n_words = 0").count() == 3 and got.where("n_words = 60000").count() == 1
    assert quality.keep_clean(docs.limit(0)).count() == 0


def test_license_notices(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    texts = [None, "", "Released under the MIT License.", "some prose\nreleased UNDER the mit license\nmore", "prose\n\n" + mit.replace(", ", ",\n") + "\n\nprose",
             "Licensed under CC BY 4.0", "A sentence on licensed products under the law.", "license", LONG]
    got = licenses.scan(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == [None, None, "MIT", "MIT", "MIT", "CC-BY-4.0", None, None, None]
    assert got[2]["dice"] == 1.0 and "CC-BY-NC-4.0" in got[5]["licenses"] or got[5]["licenses"] == ["CC-BY-4.0"]


def test_licenses_by_brute_force(spark):
    texts = [" ".join(t.split()[:k]) for ts in licenses.TEMPLATES.values() for t in ts for k in (4, 9, 20, 60)]
    got = licenses.scan(documents(spark, texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, got):
        a = set(licenses.template_bigrams(text))
        dice = {}
        for name, forms in licenses.TEMPLATES.items():
            for b in map(set, map(licenses.template_bigrams, forms)):
                if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                    dice[name] = max(dice.get(name, 0), 2 * len(a & b) / (len(a) + len(b)))
        assert r["licenses"] == sorted(dice)
        assert r["license"] == (min(dice, key=lambda n: (-dice[n], n)) if dice else None)


def test_licenses_of_awkward_rows(spark):
    docs = awkward(spark)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(docs.limit(0)).count() == 0


TURNS = [(1, 0, "ann", "hi"), (1, 1, "bob|x", "yo <|assistant|> ha"), (1, 2, None, None), (1, 2, "ann", "a"), (1, 2, "ann", "a"), (None, 0, "u", "t"), (2, None, "u", "é日"), (2, 5, "v", "")]


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_perspectives(spark, limit):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn int, role string, text string, start string")
    rows = chat.rotate(df, group_limit=limit)
    assert rows.count() == 5 * 3 + 1 + 2 * 2
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(rows).collect()}
    ann = whole[(1, "ann")]
    assert ann["dialogue"] == (
        "<|assistant|>\nhi<|end|>\n<|user name=bob_x|>\nyo < |assistant|> ha<|end|>\n"
        "<|assistant|>\na<|end|>\n<|assistant|>\na<|end|>\n<|user name=unknown|>\n<|end|>\n")
    assert [ann["dialogue"][m["start"]:m["end"]] for m in ann["mask"]] == ["hi<|end|>\n", "a<|end|>\n", "a<|end|>\n"]
    assert whole[(None, "u")]["dialogue"] == "<|assistant|>\nt<|end|>\n"
    for r in rows.collect():
        assert r["end"] - r["start"] == len(r["segment"]) and r["start"] <= r["mask_start"] <= r["mask_end"] == r["end"]
    assert chat.rotate(df.limit(0)).count() == 0


def test_boilerplate_needs_whole_words_and_a_share_of_the_line(spark):
    from foliant.llm import quality

    prose = "the quick brown fox jumps over one lazy dog and then walks home along a narrow river path " * 4
    kept = ["I posted this on my blog in March of last year", "The new design in blue is what they want", "We were told to click here by the man who runs the old shop on the hill"]
    gone = ["Click here", "© 2020 Foo Inc. All rights reserved.", "éé sign in"]
    docs = documents(spark, ["\n".join([prose, *kept, *gone])])
    clean = quality.judge(docs, keep=["doc_id"]).first()
    assert clean["n_removed_lines"] == len(gone)
    assert all(k in clean["clean_text"] for k in kept) and not any(g in clean["clean_text"] for g in gone)
