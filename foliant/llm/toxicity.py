"""Toxicity by two class-conditional Kneser-Ney models over the symbols of expressions.

An expression is a word (A-Z lower-cased; every ASCII character but letters and digits
separates) between a start and an end mark. Its symbols are UTF-8 bytes. Each class, toxic
and ordinary, has its own absolutely discounted counts of n-grams of up to six symbols,
and both back off to one shared Kneser-Ney model: the numbers of distinct left neighbours
of the shorter n-grams, counted over both classes. An n-gram that is rare in both classes
therefore gets nearly the same probability from both, and says nothing.

Above the symbols stand whole words, whose events the symbols can not tell where their
syllables are common: each class has discounted counts of the documents that hold a word, and
both back off to one shared probability, the number of different words before it over both
classes. The discount of ``WORD_DISCOUNT`` documents keeps a word of one text and its copies
from saying anything.

Features of a text: the log-likelihood ratio of its words divided by their number, the highest
ratio of one of its words, and, from the symbols, the highest ratio of one of its expressions
divided by that expression's number of symbols. A logistic curve fitted on labelled rows outside
the counts turns them into a score from 0 to 1; the ratio of all symbols by their number is
there as a column.

Counts cover every labelled row. They are summed in the tasks, then by key, and the model is
worked out by joins and windows whose groups hold at most 256 symbols. Scoring uses every
counted n-gram: a model of up to ``SENT`` rows is broadcast under its exact keys. Of a larger
one, the n-grams of the distinct words of all texts are joined with it by key. The ratios of
the most frequent words are then broadcast, up to ``HOT`` words, and those of the others are
joined with the distinct words that each text has of them.

Cases: null and empty texts have both features 0; rows without a label or with a null text
are not counted; a document with several labels counts as toxic if one is; repeated rows
count each; without any toxic or without any ordinary row the score is the rate of toxic
rows (0 without labels). Only named columns are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from foliant.llm.bytetext import ALNUM, Words, mix, slices, spread_sums, words
from foliant.session import cut_lineage

#: Symbols of an n-gram; six of eight bits each fit a positive long.
ORDER = 6
DISCOUNT = 0.75
#: Documents of a class that a word must be in beyond this to count.
WORD_DISCOUNT = 3.0
#: Rows of a model that are broadcast whole, and words whose ratios are broadcast beyond it.
SENT = 1 << 22
HOT = 1 << 21
_START, _END = 1, 2
_CONTEXT = np.uint64(1 << 56)


def _grams(found: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram keys of the words ``pick``, the place of each in ``pick``, and symbols of each word.

    A key holds the last symbol in its lowest byte and the earlier ones above it.
    """
    start, long = found.start[pick], found.end[pick] - found.start[pick] + 2
    owner = np.repeat(np.arange(len(pick)), long)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(long) - long, long)
    symbol = np.full(len(owner), _START, np.uint64)
    symbol[place == long[owner] - 1] = _END
    inner = (place > 0) & (place < long[owner] - 1)
    symbol[inner] = ALNUM[found.data[start[owner[inner]] + place[inner] - 1]]
    key = symbol.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(symbol)
        earlier[back:] = symbol[:-back]
        key |= np.where(place >= back, earlier << np.uint64(8 * back), np.uint64(0))
    said = place > 0
    return key[said], owner[said], long - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the n-grams of a task by key; parts go out when they hold a million keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        keys, sums = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        keys, place = np.unique(keys, return_inverse=True)
        both = np.stack([np.bincount(place, sums[:, j], len(keys)) for j in (0, 1)], 1)
        return keys, both

    def out(keys, both):
        for lo in range(0, len(keys), 1 << 16):
            part = both[lo:lo + (1 << 16)].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[lo:lo + (1 << 16)].astype(np.int64)), pa.array(part[:, 1]), pa.array(part[:, 0])],
                names=["key", "toxic", "ordinary"])

    for whole in batches:
        for batch in slices(whole, "text"):
            found = words(batch.column("text"))
            if not len(found.hash):
                continue
            _, first, place = np.unique(found.hash, return_index=True, return_inverse=True)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(bool)[found.row]
            per_word = np.stack([np.bincount(place, label == c, len(first)) for c in (False, True)], 1)
            key, owner, _ = _grams(found, first)
            keys, at = np.unique(key, return_inverse=True)
            held.append((keys, np.stack([np.bincount(at, per_word[owner, j], len(keys)) for j in (0, 1)], 1)))
            if sum(len(k) for k, _ in held) > 1 << 20:
                held = [merged()]
                if len(held[0][0]) > 1 << 20:
                    yield from out(*held.pop())
    if held:
        yield from out(*merged())


def _length(key: Column) -> Column:
    out = F.lit(1)
    for k in range(1, ORDER):
        out = out + (key >= F.lit(1 << (8 * k))).cast("int")
    return out


def _last(key: Column, symbols: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def _shared(events: DataFrame) -> DataFrame:
    """(gram, p): the shared Kneser-Ney probability of each shorter n-gram's last symbol.

    The number of symbols is told by the key itself: no symbol is 0.
    """
    orders = F.explode(F.sequence(F.lit(1), F.least(_length(F.col("key")) - 1, F.lit(ORDER - 1))))
    types = events.where(_length(F.col("key")) > 1).select("key", orders.alias("o"))
    wide = F.expr("key & (shiftleft(1L, 8 * (o + 1)) - 1L)")
    narrow = F.expr("wide & (shiftleft(1L, 8 * o) - 1L)")
    left = types.select("o", wide.alias("wide")).distinct().groupBy("o", narrow.alias("gram")).agg(F.count("*").alias("n"))
    context = W.partitionBy("o", F.shiftright("gram", 8))
    left = cut_lineage(left.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.count("*").over(context)))
    below = None
    for o in range(1, ORDER):
        own = left.where(F.col("o") == o)
        if below is None:
            own = own.withColumn("low", F.lit(1 / 256))
        else:
            own = own.withColumn("gram_low", _last(F.col("gram"), o - 1)).join(
                below.where(F.col("o") == o - 1).select(F.col("gram").alias("gram_low"), F.col("p").alias("low")), "gram_low")
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("low")) / F.col("total")
        judged = cut_lineage(own.select("o", "gram", p.alias("p")))  # one short plan an order instead of nested ones
        below = judged if below is None else below.unionByName(judged)
    return below.select("gram", "p")


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: documents of either class that hold a word (before is null), and the different words before it."""
    for whole in batches:
        for batch in slices(whole, "text"):
            found = words(batch.column("text"))
            if not len(found.hash):
                continue
            code, place = np.unique(found.hash, return_inverse=True)
            n = len(code)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(bool)
            once = np.unique(found.row * n + place)
            toxic = label[once // n]
            both = [np.bincount(once % n, weights, n).astype(np.int64) for weights in (toxic, ~toxic)]
            before = np.concatenate([[0], found.hash[:-1]]).astype(np.uint64)
            before[found.bounds[:-1][np.diff(found.bounds) > 0]] = 0  # the start of a text
            pairs = np.unique(np.stack([found.hash, before], 1), axis=0).view(np.int64)
            none = np.zeros(len(pairs), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([code.view(np.int64), pairs[:, 0]])), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[:, 1])]),
                 *[pa.array(np.concatenate([b, none])) for b in both]], names=["word", "before", "toxic", "ordinary"])


def _vocabulary(rows: DataFrame) -> DataFrame:
    """(word, ratio): log-likelihood ratio of each word of the labelled texts; words go by their hash."""
    seen = rows.mapInArrow(_spoken, "word long, before long, toxic long, ordinary long").groupBy("word", "before").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    counted = cut_lineage(seen.groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("before").alias("kinds")))
    t = counted.agg(
        F.sum("kinds").alias("kinds"), *[f(c).alias(f"{name}_{c}") for c in ("toxic", "ordinary") for name, f in (
            ("sum", F.sum), ("lost", lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(WORD_DISCOUNT)))))]).first()

    def probability(c: str) -> Column:
        total = t[f"sum_{c}"]
        if not total:
            return F.col("kinds") / t["kinds"]
        kept = F.greatest(F.col(c) - WORD_DISCOUNT, F.lit(0.0)) / total
        return kept + F.lit(t[f"lost_{c}"] / total) * F.col("kinds") / t["kinds"]

    if not t["kinds"]:
        return counted.select("word", F.lit(0.0).cast("float").alias("ratio"))
    return cut_lineage(counted.select("word", F.log(probability("toxic") / probability("ordinary")).cast("float").alias("ratio")))


@dataclass(frozen=True)
class Model:
    """Ratios of n-grams and contexts (key, ratio), and of whole words (word, ratio)."""

    grams: DataFrame
    words: DataFrame


def fit(labelled: DataFrame) -> Model:
    """Log-likelihood ratios of all n-grams, contexts and words, from rows of ``text`` and boolean ``label``."""
    told = labelled.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("text", "label")
    return Model(_fit_grams(told), _vocabulary(told))


def _fit_grams(labelled: DataFrame) -> DataFrame:
    rows = labelled.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("text", "label")
    events = cut_lineage(
        rows.mapInArrow(_count, "key long, toxic long, ordinary long").groupBy("key")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    context = W.partitionBy(F.shiftright("key", 8))
    own = events
    for c in ("toxic", "ordinary"):
        own = own.withColumn(f"{c}_total", F.sum(c).over(context)).withColumn(
            f"{c}_kinds", F.sum((F.col(c) > 0).cast("int")).over(context))

    def weight(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0)

    def probability(c: str) -> Column:
        kept = F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(0.0)
        return kept + weight(c) * F.col("p")

    short = F.least(_length(F.col("key")) - 1, F.lit(ORDER - 1))
    own = cut_lineage(own.withColumn("gram", F.col("key").bitwiseAND(_mask(short))))
    judged = own.join(_shared(events), "gram")
    ratios = judged.select("key", F.log(probability("toxic") / probability("ordinary")).alias("ratio"))
    contexts = own.groupBy(F.shiftright("key", 8).alias("context")).agg(F.first(F.log(weight("toxic") / weight("ordinary"))).alias("ratio"))
    both = ratios.unionByName(contexts.select((F.col("context") + F.lit(int(_CONTEXT))).alias("key"), "ratio"))
    return cut_lineage(both.select("key", F.col("ratio").cast("float").alias("ratio")))


def _mask(symbols: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(1, ORDER):
        out = F.when(symbols == k, F.lit((1 << (8 * k)) - 1)).otherwise(out)
    return out


def _sent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Spread keys in their order, and the ratios; the first column of ``rows`` is the key."""
    table = rows.toArrow()  # callers check the number of rows
    code = mix(table.column(0).to_numpy().view(np.uint64))  # one to one
    order = np.argsort(code)
    return code[order], table.column(1).to_numpy()[order]


class _Table:
    def __init__(self, code: np.ndarray, ratio: np.ndarray):
        bits = max(1, len(code).bit_length())
        self.code, self.ratio, self.shift = code, ratio, np.uint64(64 - bits)
        self.bounds = np.searchsorted(code >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the table, and their ratios (0 for the others)."""
        code = mix(key)
        cell = (code >> self.shift).astype(np.int64)
        at, end = self.bounds[cell], self.bounds[cell + 1]
        hit, ratio = np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.code[at[left]] == code[left]
            found = left[same]
            hit[found], ratio[found] = True, self.ratio[at[found]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return hit, ratio

    def expressions(self, found: Words, pick: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word in ``pick``."""
        key, owner, _ = _grams(found, pick)
        hit, ratio = self.find(key)
        miss = np.flatnonzero(~hit)
        _, ratio[miss] = self.find((key[miss] >> np.uint64(8)) | _CONTEXT)
        return np.bincount(owner, ratio, len(pick))


_LAST: dict[str, tuple[_Table, _Table]] = {}


def _score(shared, by_word: bool):
    """Sums, symbols and peaks of the texts; ``rest`` are the words of a text that the table of words lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, model, spoken = shared.value
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = _Table(*model), _Table(*spoken)
        table, vocabulary = _LAST[name]
        for whole in batches:
            for batch in slices(whole, "_text"):
                found = words(batch.column("_text"))
                n = batch.num_rows
                total, symbols, peak = np.zeros(n), np.zeros(n, np.int64), np.full(n, -np.inf)
                said, spoken_total, spoken_peak = np.diff(found.bounds), np.zeros(n), np.full(n, -np.inf)
                rest = [np.zeros(0, np.int64)] * 4
                if len(found.hash):
                    _, first, place = np.unique(found.hash, return_index=True, return_inverse=True)
                    long = found.end[first] - found.start[first] + 1
                    if by_word:
                        known, ratio = table.find(found.hash[first])
                        late, times = np.unique((found.row * len(first) + place)[~known[place]], return_counts=True)
                        rest = [late // len(first), found.hash[first].view(np.int64)[late % len(first)], times, long[late % len(first)]]
                    else:
                        known, ratio = np.ones(len(first), bool), table.expressions(found, first)
                    some = said > 0
                    met, spoken_ratio = vocabulary.find(found.hash[first])
                    spoken_total = spread_sums(spoken_ratio.astype(float)[place], found.bounds)
                    spoken_peak[some] = np.maximum.reduceat(np.where(met, spoken_ratio, -np.inf)[place], found.bounds[:-1][some])
                    total = spread_sums(ratio.astype(float)[place], found.bounds)
                    symbols = spread_sums(long[place], found.bounds)
                    peak[some] = np.maximum.reduceat(np.where(known, ratio / long, -np.inf)[place], found.bounds[:-1][some])
                row, *fields = rest
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in fields], ["word", "times", "long"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), batch.column("_id"), pa.array(total), pa.array(symbols), pa.array(peak), pa.array(said.astype(np.int64)),
                     pa.array(spoken_total), pa.array(spoken_peak), lists],
                    names=["_row", "_id", "total", "symbols", "peak", "said", "spoken_total", "spoken_peak", "rest"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each slice of texts."""
    for whole in batches:
        for batch in slices(whole, "_text"):
            found = words(batch.column("_text"))
            code, first, times = np.unique(found.hash, return_index=True, return_counts=True)
            for lo in range(0, len(first), 1 << 16):
                pick = first[lo:lo + (1 << 16)]
                said = [ALNUM[found.data[a:b]].tobytes().decode() for a, b in zip(found.start[pick], found.end[pick])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[lo:lo + (1 << 16)].view(np.int64)), pa.array(said, pa.string()), pa.array(times[lo:lo + (1 << 16)])],
                    names=["word", "said", "times"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of listed words, with their contexts."""
    for whole in batches:
        for batch in slices(whole, "said", 1 << 20):
            found = words(batch.column("said"))
            key, owner, _ = _grams(found, np.arange(len(found.hash)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(owner)) for c in ("word", "times")] +
                [pa.array(key.view(np.int64)), pa.array(((key >> np.uint64(8)) | _CONTEXT).view(np.int64))],
                names=["word", "times", "key", "context"])


def _word_ratios(texts: DataFrame, fitted: Model) -> DataFrame:
    """(word, ratio, spoken, times) of every distinct word of the texts; words go by their hash, spoken is null for new ones."""
    model = fitted.grams
    listed = texts.mapInArrow(_listed, "word long, said string, times long").groupBy("word", "said").agg(F.sum("times").alias("times"))
    grams = listed.mapInArrow(_split, "word long, times long, key long, context long").join(model, "key", "left")
    # An n-gram that was found needs no context: it gets a key of its own that no context has.
    back = F.when(F.col("ratio").isNull(), F.col("context")).otherwise(-1 - F.shiftrightunsigned("word", 1))
    weights = model.select(F.col("key").alias("back"), F.col("ratio").alias("weight"))
    grams = grams.select("word", "times", "ratio", back.alias("back")).join(weights, "back", "left")
    summed = grams.groupBy("word", "times").agg(F.sum(F.coalesce("ratio", "weight", F.lit(0.0)).cast("double")).cast("float").alias("ratio"))
    return cut_lineage(summed.join(fitted.words.select("word", F.col("ratio").alias("spoken")), "word", "left"))


def _hot(ratios: DataFrame, most: int) -> Column:
    """The words said often enough that at most ``most`` words are as frequent."""
    grade = F.floor(F.log2("times") * 4)
    total, least = 0, 1 << 10
    for r in sorted(ratios.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):  # a few hundred rows
        total += r["count"]
        if total > most:
            break
        least = r["grade"]
    return grade >= least


def features(
    documents: DataFrame, model: Model, keep: list[str], text_col: str = "text", sent: int = SENT, hot: int = HOT,
) -> DataFrame:
    """The ``keep`` columns with ``mean_ratio``, ``peak_ratio``, ``word_mean`` and ``word_peak`` of every text.

    One narrow pass where the model has up to ``sent`` rows.
    """
    rows = documents.select(F.struct(*keep).alias("_row"), F.monotonically_increasing_id().alias("_id"), F.col(text_col).alias("_text"))
    late = None
    grams, spoken = model.grams, model.words
    by_word = grams.count() > sent or spoken.count() > sent
    if by_word:
        ratios = _word_ratios(rows.select("_text"), model)
        often = _hot(ratios, hot)
        late = ratios.where(~often).select("word", "ratio", "spoken")
        grams = ratios.where(often).select("word", "ratio")
        spoken = ratios.where(often & F.col("spoken").isNotNull()).select("word", "spoken")
    shared = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, _sent(grams), _sent(spoken)))
    kind = T.StructType([*rows.drop("_text").schema.fields, *T.StructType.fromDDL(
        "total double, symbols long, peak double, said long, spoken_total double, spoken_peak double, "
        "rest array<struct<word: long, times: long, long: long>>").fields])
    found = rows.mapInArrow(_score(shared, by_word), kind)
    if late is not None and late.limit(1).count():
        found = cut_lineage(found)  # the ids must stay
        times = F.col("times")
        joined = found.select("_id", F.explode("rest").alias("r")).select("_id", "r.*").join(late, "word").groupBy("_id").agg(
            F.sum(F.col("ratio").cast("double") * times).alias("more"), F.max(F.col("ratio") / F.col("long")).alias("higher"),
            F.sum(F.col("spoken").cast("double") * times).alias("more_said"), F.max(F.col("spoken").cast("double")).alias("higher_said"))
        found = found.drop("rest").join(joined, "_id", "left").withColumns({
            "total": F.col("total") + F.coalesce("more", F.lit(0.0)), "peak": F.greatest("peak", "higher"),
            "spoken_total": F.col("spoken_total") + F.coalesce("more_said", F.lit(0.0)), "spoken_peak": F.greatest("spoken_peak", "higher_said")})
    some = F.col("symbols") > 0
    return found.select(
        *[F.col("_row").getField(f.name).alias(f.name) for f in rows.schema["_row"].dataType],
        F.when(some, F.col("total") / F.col("symbols")).otherwise(0.0).alias("mean_ratio"),
        F.when(some, F.col("peak")).otherwise(0.0).alias("peak_ratio"),
        F.when(some, F.col("spoken_total") / F.col("said")).otherwise(0.0).alias("word_mean"),
        F.when(some & (F.col("spoken_peak") > F.lit(-math.inf)), F.col("spoken_peak")).otherwise(0.0).alias("word_peak"))


#: Grid of the features that the curve is fitted on: steps to one, least and largest step.
GRID = {"word_mean": (32, -64, 63), "word_peak": (4, -16, 47), "peak_ratio": (8, -32, 31)}


def calibrate(judged: DataFrame, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic weights (bias, then those of GRID) from rows of features and boolean ``label``.

    The rows are counted on a fixed grid of the features, at most 2^19 cells a label, so what reaches
    the driver does not grow with their number.
    """
    steps = [F.least(F.greatest(F.floor(F.col(c) * n), F.lit(lo)), F.lit(hi)).alias(c) for c, (n, lo, hi) in GRID.items()]
    grid = judged.where(F.col("label").isNotNull()).groupBy(*steps, "label").count().collect()
    nothing = (0.0,) * len(GRID)
    if not grid:
        return -math.inf, *nothing
    grid.sort(key=lambda r: (*[r[c] for c in GRID], r["label"]))
    x = np.array([[1.0, *[(r[c] + 0.5) / n for c, (n, _, _) in GRID.items()]] for r in grid])
    y = np.array([float(r["label"]) for r in grid])
    n = np.array([float(r["count"]) for r in grid])
    rate = float((n * y).sum() / n.sum())
    if rate in (0.0, 1.0):
        return (math.inf if rate else -math.inf), *nothing
    use = list(range(len(GRID) + 1))
    while True:
        w = np.zeros(len(use))
        keep = np.diag([0.0] + [ridge] * (len(use) - 1))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w, -30, 30)))
            slope = x[:, use].T @ (n * (p - y)) + keep @ w
            bend = (x[:, use] * (n * p * (1 - p) + 1e-9)[:, None]).T @ x[:, use] + keep
            move = np.linalg.solve(bend, slope)
            w = w - np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-8:
                break
        down = [(v, i) for i, v in zip(use, w) if i and v < 0]
        if not down:
            break
        use = [i for i in use if i != min(down)[1]]
    full = np.zeros(len(GRID) + 1)
    full[use] = w
    return tuple(float(v) for v in full)


def score(weights: tuple[float, ...]) -> Column:
    """The score from 0 to 1 of rows with features."""
    bias, *slopes = weights
    if math.isinf(bias):
        return F.lit(1.0 if bias > 0 else 0.0)
    return 1 / (1 + F.exp(-sum((F.lit(w) * F.col(c) for w, c in zip(slopes, GRID)), F.lit(bias))))
