"""Groups of spelling variants by an index of variable-length grams.

Words are counted over all texts. Words of at least ``min_length`` code points and ``min_count``
occurrences are compared: two are *near* if they differ by exactly one inserted, deleted or
replaced code point.

1. *Gram dictionary.* All grams of ``QMIN`` to ``QMAX`` code points of the padded words are
   counted by a 64-bit hash. A gram is extended to longer ones only while more than a bound of
   words hold it, so the dictionary is the tree of frequent grams and their children. The bound
   is a share of the table, which keeps the frequent grams that are sent to the tasks below
   ``DICTIONARY`` whatever the input.
2. *Decomposition.* A word is cut into the longest dictionary gram that starts at each place,
   less those that lie within an earlier one. This needs nothing but the word and the frequent
   grams.
3. *Bounds.* One edit can change only grams whose end lies within ``QMAX`` places after it: they
   hold the place, or a new gram there may cover them. The largest number of such ends is the
   word's bound of affected grams. All other grams of the word are grams of the near word, at
   the same place or one further on, in the same order.
4. *List merging.* Grams are ordered by rarity. Two near words agree in a gram among the
   bound + 1 rarest of each, so only these lists are merged: words of equal length at equal
   places, words longer by one at the same or the next place.
5. *Verification.* Pairs that meet in a list must differ in at most two letters by count parity
   and in one edit exactly; only these pairs leave the join.

Words none of whose grams is safe from an edit are joined with each other by their halves, one
of which an edit leaves alone. So no pair is lost, and the dictionary decides only the cost.

A word's *form* is its near word of the largest count (ties: the first in code-point order) if
that is at least ``ratio`` times the word's own; its *root* is where the forms lead.

Cases: null and empty texts and texts without letters have no word; a null id counts as an
empty one; repeated rows count again; extra columns are not read; an empty table has no word.
Very long words are compared like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.bytetext import mix
from foliant.session import cut_lineage, spread

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QMIN = 2
QMAX = 5
#: Padding marks on each side of a word, so that its ends lie in as many grams as its middle.
PAD = 2
#: Most frequent grams sent to the tasks, 16 bytes each.
DICTIONARY = 1 << 20
#: Words that may hold a gram before it is extended, for small tables.
FEW = 64
#: Code points up to which a pair is verified inside the join.
LONG = 256
_SALT = np.uint64(0xD6E8FEB86659FD93)


def damaged(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run; without one code point where the CRC-32 of "<doc_id>:<run>" is divisible by ``every``."""
    code = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (code % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(code % every == 0, less).otherwise(run)


def count_words(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, every: int = 199,
) -> DataFrame:
    """(word, n) of the frequent long words of all texts."""
    runs = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(
        "id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(damaged(F.col("run"), F.col("id"), every).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class _Padded:
    """Code points of padded words in one array, with ``QMAX`` filling places between them."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        size = self.length + 2 * PAD
        self.start = np.cumsum(size + QMAX) - (size + QMAX)
        self.end = self.start + size
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.code = np.zeros(int((size + QMAX).sum()), np.uint64)
        owner = np.repeat(np.arange(len(words)), self.length)
        self.code[np.arange(len(flat)) + (self.start + PAD - (np.cumsum(self.length) - self.length))[owner]] = flat
        self.code[(self.start[:, None] + np.arange(PAD)).ravel()] = 1
        self.code[(self.end[:, None] - 1 - np.arange(PAD)).ravel()] = 2
        self.word = np.repeat(np.arange(len(words)), size + QMAX)
        self.room = self.end[self.word] - np.arange(len(self.code)) if len(words) else np.zeros(0, np.int64)

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, hash of the gram at each place, and whether it lies in its word."""
        code = np.zeros(len(self.code), np.uint64)
        for q in range(1, QMAX + 1):
            ahead = np.zeros_like(self.code)
            ahead[:len(self.code) - q + 1] = self.code[q - 1:]
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + ahead + _SALT)
            if q >= QMIN:
                yield q, code, self.room >= q


def _sliced(batches: Iterator[pa.RecordBatch], letters: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of at most that many letters, or of one word."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        ends = np.cumsum([len(w) + 2 * PAD + QMAX for w in words])
        lo = 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + letters, "right")))
            yield batch.slice(lo, hi - lo), words[lo:hi]
            lo = hi


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words in _sliced(batches):
        found = [code[there] for _, code, there in _Padded(words).grams()]
        value, times = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(times)], names=["gram", "n"])


def frequent_grams(words: DataFrame, few: int = FEW, most: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the grams that are extended: fewer than ``most``, as each takes its share of all."""
    counted = cut_lineage(words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("n") > max(few, total // most)).toArrow()
    code, n = often.column("gram").to_numpy().astype(np.uint64), often.column("n").to_numpy()
    order = np.argsort(code)
    return code[order], n[order]


def decompose(padded: _Padded, frequent: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Grams of all words in order: word, place, length, hash, and how often the gram is known to be held."""
    known, times = frequent
    size = len(padded.code)
    length, chosen, rate = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.int64)
    going = padded.room >= QMIN
    for q, code, there in padded.grams():
        going = going & there
        length[going], chosen[going] = q, code[going]
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        often = (known[at] == code) if len(known) else np.zeros(size, bool)
        rate[going] = np.where(often, times[at], 0)[going] if len(known) else 0
        going = going & often
    place = np.flatnonzero(length)
    end = place + length[place]
    before = np.maximum.accumulate(np.concatenate([[0], end]))[:-1]
    place = place[end > before]  # the others lie within an earlier gram
    return {"word": padded.word[place], "place": place, "length": length[place], "hash": chosen[place], "rate": rate[place]}


def affected_bounds(padded: _Padded, grams: dict[str, np.ndarray]) -> np.ndarray:
    """For each word the most grams that one edit can change: ends in a window of QMAX places behind a letter."""
    ends = np.zeros(len(padded.code) + QMAX + 2, np.int64)
    ends[grams["place"] + grams["length"]] = 1
    upto = np.cumsum(ends)
    at = np.arange(len(padded.code))
    inside = (at >= padded.start[padded.word] + PAD) & (at < padded.end[padded.word] - PAD)
    window = np.where(inside, upto[at + QMAX] - upto[at], 0)
    out = np.zeros(len(padded.length), np.int64)
    np.maximum.at(out, padded.word, window)
    return out


def _parity(padded: _Padded) -> np.ndarray:
    """Parity of the number of each letter, by code point modulo 61."""
    out = np.zeros(len(padded.length), np.uint64)
    inside = padded.code > 2
    np.bitwise_xor.at(out, padded.word[inside], np.uint64(1) << (padded.code[inside] % np.uint64(61)))
    return out


def _key(code: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix(code + length.astype(np.uint64) * _SALT) ^ (place.astype(np.uint64) + np.uint64(1)) * _SALT)


def _text_code(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


def _listed(frequent):
    """(word) to (key, asks, word, size, mask): the lists a word stands in, and those it looks into for words as long or longer by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _sliced(batches):
            padded = _Padded(words)
            grams = decompose(padded, frequent.value)
            bound, mask = affected_bounds(padded, grams), _parity(padded)
            order = np.lexsort((grams["place"], grams["hash"], -grams["length"], grams["rate"], grams["word"]))
            owner = grams["word"][order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            order = order[rank <= bound[owner]]  # the rarest, one more than an edit can change
            owner = grams["word"][order]
            place, size = grams["place"][order] - padded.start[owner], padded.length[owner]
            code = grams["hash"][order] + grams["length"][order].astype(np.uint64)
            own = _key(code, size, place)
            parts = [(own, False, owner), (own, True, owner), (_key(code, size + 1, place), True, owner), (_key(code, size + 1, place + 1), True, owner)]
            n_grams = np.bincount(grams["word"], minlength=len(words))
            for i in np.flatnonzero(n_grams <= bound).tolist():  # no gram is safe: by halves
                for short in (len(words[i]), len(words[i]) - 1):
                    halves = (words[i][:short // 2], words[i][len(words[i]) - (short - short // 2):])
                    code = np.array([_text_code(f"{side} {short} {half}") for side, half in zip("<>", halves)], np.uint64)
                    who = np.array([i, i])
                    parts.append((code, False, who))
                    if short == len(words[i]):
                        parts.append((code, True, who))
            key = np.concatenate([k for k, _, _ in parts]).astype(np.int64)
            asks = np.concatenate([np.full(len(k), a) for k, a, _ in parts])
            who = np.concatenate([w for _, _, w in parts])
            step = max(1, (1 << 24) // max(1, int(padded.length.max()) if len(words) else 1))
            text = batch.column("word")
            for lo in range(0, len(key), step):
                at = who[lo:lo + step]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[lo:lo + step]), pa.array(asks[lo:lo + step]), text.take(pa.array(at)), pa.array(padded.length[at]),
                     pa.array(mask[at].astype(np.int64))], names=["key", "asks", "word", "size", "mask"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) one edit apart, b as long as a or longer by one, in linear time."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            lo, hi = 0, len(a)
            while lo < hi:  # length of the common beginning
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
            keep.append(a != b and a[lo + (len(a) == len(b)):] == b[lo + 1:])
        yield batch.filter(pa.array(keep, pa.bool_()))


def near_pairs(words: DataFrame, few: int = FEW, most: int = DICTIONARY) -> DataFrame:
    """(a, b): all pairs of different words one edit apart, each once."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, few, most))
    lists = cut_lineage(words.select("word").mapInArrow(_listed(frequent), "key long, asks boolean, word string, size long, mask long"))
    stands = lists.where("NOT asks").select("key", F.col("word").alias("b"), F.col("size").alias("bs"), F.col("mask").alias("bm"))
    looks = lists.where("asks").select("key", F.col("word").alias("a"), F.col("size").alias("as"), F.col("mask").alias("am"))
    fits = (F.bit_count(F.col("am").bitwiseXOR(F.col("bm"))) <= 2) & (
        (F.col("bs") == F.col("as") + 1) | ((F.col("bs") == F.col("as")) & (F.col("a") < F.col("b"))))
    half = (F.col("as") / 2).cast("int")
    same_half = (F.left("a", half) == F.left("b", half)) | (F.right("a", F.col("as") - half) == F.right("b", F.col("as") - half))

    def met(asking: DataFrame, verified: Column) -> DataFrame:
        return asking.join(stands, (asking["key"] == stands["key"]) & fits & verified).select("a", "b").distinct()

    # The built-in distance takes quadratic time, which is too much for words as long as texts.
    brief = met(looks.where(F.col("as") <= LONG), F.levenshtein("a", "b", 1) == 1)
    return brief.unionByName(met(looks.where(F.col("as") > LONG), same_half).mapInArrow(_verified, "a string, b string"))


def follow(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): where the forms lead, by doubling the steps of all words at once.

    Counts grow along a chain, so it ends; a chain of n steps takes log2(n) rounds.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        if moved.where("on").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")
    raise RuntimeError("forms do not end")


def variants(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5,
    few: int = FEW, most: int = DICTIONARY, every: int = 199,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = cut_lineage(count_words(documents, id_col, text_col, min_length, min_count, every))
    return grouped(words, cut_lineage(near_pairs(words, few, most)), ratio)


def grouped(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """Counts, forms and roots of (word, n) from its near pairs (a, b)."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    told = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = told.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    judged = words.join(best, "word", "left").withColumn("m", -F.col("best.m"))
    led = F.col("m") >= F.col("n") * ratio
    judged = cut_lineage(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(led, F.col("best.other")).alias("form"), F.when(led, F.col("m")).alias("form_n")))
    roots = follow(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
