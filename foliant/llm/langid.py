"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is read whole. Its words (A-Z lower-cased; every ASCII character but letters
separates) stand between marks and are cut into n-grams of three to five UTF-8 bytes, each
hashed to one of ``2 ** BUCKET_BITS`` embeddings. The mean embedding of a text goes through
a linear layer and a softmax. Embeddings and layer are trained together by stochastic
gradient descent in numpy, on at most ``2 * per_language`` rows for each language: rows are
drawn by the hash of id and text at a rate worked out from the counts of the languages.
What reaches the driver is the sample's bucket counts, of at most ``2 ** BUCKET_BITS`` pairs
a row.

A quarter of the sample takes no part in training. On it a temperature is fitted that makes
the score a probability, together with a discount n / (n + half) of the evidence of few
n-grams; for this each row is judged whole and by draws of a few of its n-grams. Then a
threshold is chosen so that at most ``false_rejects`` of the rightly labelled whole rows
fall below it; where too few rows are judged to tell, the tail of their scores is carried on
to that share. The threshold is never above what nearly all texts of an unknown language
stay below, which are n-grams drawn at random. A text is rejected if its score lies below the
threshold, or if the model knows none of its n-grams. With one language a softmax says
nothing, and the score is the share of a text's n-grams that the model knows.

As both layers are linear, they are multiplied out after training, and prediction sums one
row of ``2 ** BUCKET_BITS`` x languages for each n-gram of each distinct word of a slice.

Cases: null texts and texts without a letter get ``und`` with score 0 and are rejected; so
do all texts if there is no labelled row. Texts without a known n-gram get the most frequent
language with its low score. Rows with a null label or text are not learned from. Repeated
rows are predicted row by row. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.bytetext import Words, byte_table, mix, slices, spread_sums, words

BUCKET_BITS = 16
DIMENSIONS = 16
SIZES = (3, 4, 5)
LETTERS = byte_table(bytes(b for b in range(128) if not chr(b).isalpha()))
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # bucket x language, both layers multiplied out
    bias: np.ndarray
    known: np.ndarray  # buckets met in training
    temperature: float
    half: float  # n-grams at which the evidence counts half
    threshold: float


def _buckets(found: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram buckets of the words ``pick``, and the place of each in ``pick``."""
    start, long = found.start[pick], found.end[pick] - found.start[pick] + 2
    owner = np.repeat(np.arange(len(pick)), long)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(long) - long, long)
    symbol = np.full(len(owner), 1, np.uint64)
    inner = (place > 0) & (place < long[owner] - 1)
    symbol[inner] = LETTERS[found.data[start[owner[inner]] + place[inner] - 1]]
    key, out, owners = symbol.copy(), [], []
    for back in range(1, max(SIZES)):
        earlier = np.zeros_like(symbol)
        earlier[back:] = symbol[:-back]
        key = key | (earlier << np.uint64(8 * back))
        if back + 1 in SIZES:
            full = place >= back
            out.append(key[full])
            owners.append(owner[full])
    code = mix(np.concatenate(out)) >> np.uint64(64 - BUCKET_BITS)
    return code.astype(np.int64), np.concatenate(owners)


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each text."""
    for whole in batches:
        for batch in slices(whole, "_text"):
            found = words(batch.column("_text"), LETTERS)
            ids, counts = [], []
            for lo, hi in zip(found.bounds[:-1], found.bounds[1:]):
                code, _ = _buckets(found, np.arange(lo, hi)) if hi > lo else (np.zeros(0, np.int64), None)
                bucket, n = np.unique(code, return_counts=True)
                ids.append(bucket.astype(np.uint16 if BUCKET_BITS <= 16 else np.uint32).tobytes())
                counts.append(n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lang"), batch.column("_draw"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                names=["lang", "draw", "ids", "counts"])


def draw_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list:
    """Bucket counts of a sample of about ``per_language`` rows of each language, at most twice as many in all."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_draw"))
    sizes = {r["_lang"]: r["count"] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("_lang")).count().collect()}
    if not sizes:
        return []
    grain = 1 << 24
    rate = F.lit(0)
    for name, n in sizes.items():
        rate = F.when(F.col("_lang") == name, F.lit(min(grain, grain * per_language // n + 1))).otherwise(rate)
    drawn = rows.where(F.pmod(F.col("_draw"), F.lit(grain)) < rate)
    bags = drawn.mapInArrow(_bag, "lang string, draw long, ids binary, counts binary").where(F.length("ids") > 0)
    return sorted(bags.orderBy("draw", "lang").limit(2 * per_language * len(sizes)).collect(), key=lambda r: (r["draw"], r["lang"]))


def train(sample: list, false_rejects: float = 0.002, sure: float = 0.4, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Model | None:
    """Fit on three quarters of the sample; temperature and threshold on the rest.

    The threshold is never above ``sure``, or the score that one in twenty texts of random
    n-grams exceeds if that is higher.
    """
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    at = {name: k for k, name in enumerate(languages)}
    bags = []
    for r in sample:
        counts = np.frombuffer(r["counts"], np.float32)
        bags.append((np.frombuffer(r["ids"], np.uint16), counts / counts.sum(), at[r["lang"]], float(counts.sum())))
    fold = np.array([(r["draw"] >> 24) % 4 == 0 for r in sample])
    learn = [b for b, f in zip(bags, fold) if not f] or bags
    judge = [b for b, f in zip(bags, fold) if f] or bags
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    layer = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    known = np.zeros(1 << BUCKET_BITS, bool)
    for ids, _, _, _ in learn:
        known[ids] = True
    share = np.bincount([y for _, _, y, _ in learn], minlength=len(languages)) + 1.0
    cost = share.sum() / (len(languages) * share)  # rare languages weigh as much as frequent ones
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learn)):
            ids, part, y, _ = learn[k]
            step = rate * (1 - done / steps)
            done += 1
            rows = embed[ids]
            mean = part @ rows
            p = _softmax(mean @ layer + bias)
            p[y] -= 1
            p *= min(cost[y], 10.0)
            back = layer @ p
            layer -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            embed[ids] = rows - (step * part)[:, None] * back
    embed[~known] = 0
    weight = embed @ layer
    whole = [(ids, part, y, size) for ids, part, y, size in judge]
    drawn = [
        (ids, np.bincount(rng.choice(len(ids), few, p=part.astype(np.float64) / part.sum(dtype=np.float64)), minlength=len(ids)) / few, y, few)
        for ids, part, y, _ in judge for few in (4, 16, 64)]
    logits = np.array([part @ weight[ids] for ids, part, _, _ in whole + drawn])
    truth, size = np.array([b[2] for b in whole + drawn]), np.array([float(b[3]) for b in whole + drawn])
    best = None
    for half in (0.0, 2.0, 8.0, 32.0, 128.0):
        evidence = logits * (size / (size + half))[:, None]
        for t in np.geomspace(0.02, 20, 91):
            p = _softmax(evidence / t + bias)[np.arange(len(truth)), truth]
            loss = -np.log(np.maximum(p, 1e-12)).mean()
            if best is None or loss < best[0]:
                best = loss, half, float(t)
    _, half, temperature = best
    strange = []
    for _, _, _, size_of in judge:
        ids = rng.integers(0, 1 << BUCKET_BITS, min(int(size_of), 4096))
        strange.append((ids, np.full(len(ids), 1 / len(ids)), -1, float(len(ids))))

    def judged(rows: list) -> tuple[np.ndarray, np.ndarray]:
        if len(languages) == 1:
            return np.zeros(len(rows), int), np.array([float(part @ known[ids]) for ids, part, _, _ in rows])
        evidence = np.array([(part @ weight[ids]) * (n / (n + half)) for ids, part, _, n in rows])
        p = _softmax(evidence / temperature + bias)
        return p.argmax(1), p.max(1)

    said, scores = judged(whole)
    right = np.sort(scores[said == truth[:len(whole)]])
    sure = max(sure, float(np.quantile(judged(strange)[1], 0.95)))
    threshold = min(_lowest(right, false_rejects), sure) if len(right) else sure
    return Model(languages, weight.astype(np.float32), bias.astype(np.float32), known, temperature, half, threshold)


def _lowest(right: np.ndarray, share: float) -> float:
    """The score that at most ``share`` of the sorted scores ``right`` fall below.

    Of fewer than 1 / share scores it is worked out from the lowest quarter: their log-odds are
    carried on below the lowest as an exponential tail of at least the scale 1.
    """
    allowed = int(share * (len(right) + 1))
    if allowed:
        return float(right[allowed])
    held = np.clip(right, 1e-9, 1 - 1e-9)
    odds = np.log(held / (1 - held))
    edge = np.quantile(odds, 0.25)
    scale = max(1.0, float((edge - odds[odds <= edge]).mean()))
    return float(1 / (1 + np.exp(-(odds[0] + scale * np.log(share * (len(right) + 1))))))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = np.concatenate([model.weight, model.known[:, None]], 1).astype(np.float32)
        names = pa.array(model.languages)
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 21):
                found = words(batch.column("_text"), LETTERS)
                n = batch.num_rows
                sums = np.zeros((n, len(model.languages) + 1))
                total = np.zeros(n)
                if len(found.hash):
                    _, first, place = np.unique(found.hash, return_index=True, return_inverse=True)
                    code, owner = _buckets(found, first)
                    size = np.bincount(owner, minlength=len(first))
                    total = spread_sums(size[place], found.bounds).astype(float)
                    for j in range(table.shape[1]):
                        sums[:, j] = spread_sums(np.bincount(owner, table[code, j], len(first))[place], found.bounds)
                mean = sums[:, :-1] / np.maximum(total, 1)[:, None]
                evidence = mean * (total / (total + model.half + 1e-9))[:, None]
                p = _softmax(evidence / model.temperature + model.bias)
                best = p.argmax(1)
                score = p.max(1) if len(model.languages) > 1 else sums[:, -1] / np.maximum(total, 1)
                letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
                lang = pc.if_else(pa.array(letter), names.take(pa.array(best)), UNKNOWN)
                kept = [(c, batch.column(c)) for c in batch.schema.names if c not in ("_text", "_letter")]
                yield pa.RecordBatch.from_arrays(
                    [*[a for _, a in kept], lang, pa.array(np.where(letter, score, 0.0)),
                     pa.array(~letter | (score < model.threshold) | (sums[:, -1] <= 0))],
                    names=[*[c for c, _ in kept], "lang_pred", "score", "rejected"])

    return run


def predict(documents: DataFrame, model: Model | None, keep: list, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``rejected``, in one narrow pass."""
    text = F.col(text_col)
    rows = documents.select(*keep, text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    kept = rows.drop("_text", "_letter")
    if model is None:
        return kept.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return rows.mapInArrow(_predict(shared), T.StructType(fields))
