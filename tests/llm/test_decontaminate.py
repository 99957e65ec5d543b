import hashlib

from foliant.llm.decontaminate import find_contamination, remove_contaminated
from tests.llm.cases import CLASHES, awkward, documents, lower_words, rows_of


def brute(texts, items, window=10):
    windows = {}
    for item, text in items:
        w = lower_words(text)
        for at in range(max(1, len(w) - window + 1)):
            if w:
                windows.setdefault(tuple(w[at:at + window]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, names = lower_words(text), set(), set()
        for m in {len(k) for k in windows}:
            for at in range(len(w) - m + 1):
                own = windows.get(tuple(w[at:at + m]))
                if own:
                    hit |= set(range(at, at + m))
                    names |= own
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "B c d e F g h i j k"), (3, "short one"), (4, None), (5, "..."), (2, "again here"), (None, "nameless"),
         (10, "x x x x x x x x x x x x"), (11, "é日 ü")]


def check(spark, texts, **kw):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, texts)
    got = find_contamination(docs, bench, keep=["doc_id"], **kw).orderBy("doc_id").collect()
    assert [tuple(r[1:5]) + (r[6],) for r in got] == brute(texts, ITEMS)


TEXTS = [None, "", "a b c d e f g h i j", "A-B-C-D-E-F-G-H-I-J-K-L-M", "a b c d e f g h i", "short, one", "x " * 40, "x " * 9, "again. HERE nameless",
         "É日 ü", "é日 ü", "pre b c d e f g h i j k post a b c d e f g h i j", "word " * 3000 + "short one " + "word " * 700]


def test_against_brute_force(spark):
    check(spark, TEXTS)


def test_patterns_in_several_blocks(spark):
    check(spark, TEXTS, block_bytes=600)


def test_awkward_rows_and_columns(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = awkward(spark)
    clean = remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    kept = find_contamination(docs, bench)
    assert set(CLASHES) - {"n_words"} <= set(kept.columns) and kept.count() == docs.count()
    assert remove_contaminated(documents(spark, TEXTS), bench).count() == sum(not r[4] for r in brute(TEXTS, ITEMS))


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_contamination(documents(spark, ["a"]).limit(0), bench).count() == 0
    assert rows_of(find_contamination(documents(spark, ["a b"]), bench.limit(0)), "n_words", "n_hit", "contaminated") == [(2, 0, False)]
