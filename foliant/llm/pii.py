"""Personal data: base patterns, and a character tagger for the forms that patterns miss.

*Base.* Four kinds (email, ip, card, phone) by fixed patterns with their checks, leftmost and
non-overlapping per kind. They are found in time linear in the text, however long a run of
digits or letters is.

*Tagger.* A bidirectional LSTM over characters with CRF transitions (``bilstm``), trained in
numpy on windows of a bounded sample of the texts. Labelled spans are those of the base
patterns, and identifiers in written-out and broken-up forms (``jane (at) example (dot) com``,
``97[.]51[.]17[.]173``, cards with dots, national telephone numbers) that are put between words
of the sampled windows; look-alikes (numbers that fail the check digit, dates, prices, versions,
keys) are put there too and carry no label. Windows with digits of the sample itself are
learned as they come, so the number shapes of the corpus are seen as what they are.

*Whole texts.* Every text is cut into overlapping windows. No check can hold on a span without
a digit, an @ or a written-out one that a domain follows, so windows further than the longest
span from all of these add nothing and are passed over (``everywhere`` decodes them too, with the
same result). Spans that
touch an inner border of a window are joined to what the neighbour window found there; the
others are accepted if their kind's check holds on the normalised text (parts up to 255, check
digit, 9 to 15 digits, an address in full). Of what overlaps, a weighted interval choice over the
whole text keeps the set of the highest total score. A base span is always kept, and nothing
that overlaps one is added.

Cases: a null text is empty and has no span; so has an empty one. Repeated rows are judged each;
all rows come back, with the columns named by ``keep`` only. With no text to learn from (an empty
table) only the base patterns speak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import bilstm
from foliant.session import spread

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from the start of one to that of the next.
WINDOW = 160
STRIDE = 120
#: Windows of a training text, and the sampled texts.
LEARN_WINDOW = 96
SAMPLE = 700
EPOCHS = 7
BATCH = 32

# ---------------------------------------------------------------- base patterns

_AT = re.compile("@")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts_fit(parts: list[str]) -> bool:
    kept = [p.lstrip("0") for p in parts]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in kept)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; kind by its place in KINDS."""
    out = []
    free, seen = 0, 0
    for m in _AT.finditer(text):  # a local part never holds an @, so it is what stands before one
        at, lo = m.start(), max(free, seen)
        seen = at + 1
        domain = _DOMAIN.match(text, at + 1)
        if domain is None or lo >= at:
            continue
        back = _LOCAL_BACK.match(text[lo:at][::-1])
        if back:
            out.append((at - back.end(), 0, domain.end()))
            free = domain.end()
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts), 4):
            own = parts[k:k + 4]
            size = sum(map(len, own)) + 3
            if len(own) == 4 and _parts_fit(own):
                out.append((at, 1, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- characters and tags

#: Symbols: ASCII as it is, then padding, other letters, other digits, other characters.
PADDING, LETTER, DIGIT, OTHER = 128, 129, 130, 131
SYMBOLS = 132
TAGS = 1 + 2 * len(KINDS)


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = code.astype(np.uint8 if code.size == 0 else np.int64)
    far = np.flatnonzero(code >= 128)
    if len(far):
        kinds = {}
        for c in np.unique(code[far]).tolist():
            kinds[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else OTHER
        out[far] = [kinds[c] for c in code[far].tolist()]
    return out.astype(np.uint8)


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.uint8)
    for start, kind, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


# ---------------------------------------------------------------- checks of what the tagger finds

_SAID_AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE)
_SAID_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s*\.\s*", re.IGNORECASE)
#: Without one of these in it no span passes its check.
_TELLING = re.compile(rf"[0-9@]|(?:{_SAID_AT.pattern})[A-Za-z0-9-]+(?:{_SAID_DOT.pattern})[A-Za-z0-9-]", re.IGNORECASE)
#: Longest span that is accepted.
LONGEST = 200
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD_TEXT = re.compile(r"[0-9](?:[\s._/–-]{0,3}[0-9])+")
_PHONE_TEXT = re.compile(r"[+(]{0,2}[0-9](?:[\s()./–-]{0,3}[0-9])+")


def holds(kind: int, text: str) -> bool:
    """Does a tagged text pass the check of its kind once it is written plainly?"""
    if len(text) > LONGEST:
        return False
    if kind == 0:
        return _ADDRESS.fullmatch(_SAID_DOT.sub(".", _SAID_AT.sub("@", text))) is not None
    if kind == 1:
        parts = _SAID_DOT.sub(".", text).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _parts_fit(parts)
    digits = _digits(text)
    if kind == 2:
        return _CARD_TEXT.fullmatch(text) is not None and 12 <= len(digits) <= 19 and luhn(digits)
    grouped = re.search(r"[\s()./–-]", text) is not None or text.startswith(("+", "00"))
    return _PHONE_TEXT.fullmatch(text) is not None and grouped and 9 <= len(digits) <= 15


def choose(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (start, kind, end, score) the non-overlapping set of the highest total score, in order."""
    spans = sorted(spans, key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # score, place to go on from, taken
    for k, (start, _, _, score) in enumerate(spans):
        before = int(np.searchsorted(ends[:k], start, "right"))
        taken = best[before][0] + score
        best.append((taken, before, True) if taken > best[k][0] else (best[k][0], k, False))
    out, k = [], len(spans)
    while k:
        _, back, taken = best[k]
        if taken:
            out.append(spans[k - 1][:3])
        k = back
    return out[::-1]


# ---------------------------------------------------------------- training

_NAMES = ("jane", "john.doe", "m.rossi", "info", "anna_k", "sales", "p-meyer", "office", "lee", "contact")
_HOSTS = ("example", "mail3.example", "firm", "uni-bonn", "post", "shop.web", "acme")
_ENDS = ("com", "org", "de", "net", "fr", "co.uk", "io")


def _with_check_digit(rng: np.random.Generator, n: int) -> str:
    head = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _pick(rng: np.random.Generator, options: tuple) -> str:
    return options[int(rng.integers(len(options)))]


def personal(rng: np.random.Generator) -> tuple[int, str]:
    """A kind and an identifier of it, in a plain or in a broken-up form."""
    kind = int(rng.choice(4, p=(0.4, 0.15, 0.2, 0.25)))  # addresses have the most forms
    if kind == 0:
        at = _pick(rng, ("@", " [at] ", "(at)", " at ", " (at) ", "[at]", " @ ", "{at}", "[@]"))
        dot = _pick(rng, (" [dot] ", "(dot)", " dot ", "[.]", " (dot) ", "[dot]")) if at not in ("@", " @ ") or rng.random() < 0.3 else "."
        name = _pick(rng, _NAMES) if rng.random() < 0.5 else "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9)))) + _number(rng, int(rng.integers(0, 3)))
        return 0, name + at + dot.join([*_pick(rng, _HOSTS).split("."), *_pick(rng, _ENDS).split(".")])
    if kind == 1:
        dot = _pick(rng, (".", "[.]", "(.)", " . ", "[dot]", " dot ", ". "))
        return 1, dot.join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        digits = _with_check_digit(rng, 16 if rng.random() < 0.8 else int(rng.integers(13, 20)))
        gap = _pick(rng, (" ", "-", ".", "/", "_", "  ", " - ", "–"))
        return 2, gap.join(digits[k:k + 4] for k in range(0, len(digits), 4)) if len(digits) == 16 else gap.join((digits[:4], digits[4:10], digits[10:]))
    shape = _pick(rng, ("+1 (###) ###-####", "(###) ###-####", "###-###-####", "###.###.####", "0049 ## #######", "+44 ## #### ####", "0## / #######", "(0##) ### ## ##",
                        "00## ### ######", "0### ### ###", "+49/##/#######", "(##) #### ####"))
    return 3, "".join(str(int(rng.integers(10))) if c == "#" else c for c in shape)


def look_alike(rng: np.random.Generator) -> str:
    """A number, key or phrase that is no personal data."""
    shape = _pick(rng, ("################", "####-##-##", "##/##/####", "##:##:##", "#,###,###", "$ ###.##", "#.#.#", "v##.#.###", "### ###", "####", "#########",
                        "####-####", "ISBN ###-#-##-######-#", "hex", "hash", "look at the end . com", "at home dot the i", "####-##-## ##:##", "###,## ###,##", "#.##.###.####.#", "##########"))
    if shape in ("hex", "hash"):
        return "".join("0123456789abcdef"[int(c)] for c in rng.integers(0, 16, 40 if shape == "hash" else 16))
    while True:
        text = "".join(str(int(rng.integers(10))) if c == "#" else c for c in shape)
        if not base_spans(text) and not holds(2, text):
            return text


def windows_to_learn(pieces: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (N, LEARN_WINDOW): each piece as it is, and twice with things put between its words."""
    x, y = [], []
    for piece in pieces:
        for turn in range(3):
            text, spans = piece, base_spans(piece)
            if turn:
                words = re.split(r"(\s+)", piece[:int(rng.integers(20, 80))])
                put: dict[int, tuple[int | None, str]] = {}
                for _ in range(int(rng.integers(1, 3))):
                    kind, said = personal(rng) if rng.random() < 0.65 else (None, look_alike(rng))
                    put[int(rng.integers(0, len(words) + 1))] = (kind, said)
                text, spans = "", []
                for k in range(len(words) + 1):
                    if k in put:
                        kind, said = put[k]
                        text += "" if not text or text[-1].isspace() else " "
                        if kind is not None:
                            spans.append((len(text), kind, len(text) + len(said)))
                        text += said + _pick(rng, (" ", ", ", ". ", "\n", " "))
                    if k < len(words):
                        text += words[k]
                own = set(spans)
                spans = sorted(own | {s for s in base_spans(text) if not any(s[0] < e and b < s[2] for b, _, e in own)})
                shift = int(rng.integers(0, max(1, len(text) - LEARN_WINDOW + 1)))
                text, spans = text[shift:], [(s - shift, k, e - shift) for s, k, e in spans if s >= shift]
            codes = np.full(LEARN_WINDOW, PADDING, np.uint8)
            own_codes = symbols(text)[:LEARN_WINDOW]
            codes[:len(own_codes)] = own_codes
            x.append(codes)
            y.append(_tags(max(LEARN_WINDOW, len(text)), spans)[:LEARN_WINDOW])
    return np.array(x, np.uint8).reshape(-1, LEARN_WINDOW), np.array(y, np.uint8).reshape(-1, LEARN_WINDOW)


def draw_sample(documents: DataFrame, text_col: str = "text", size: int = SAMPLE) -> list[str]:
    """A window of each of ``size`` texts, the least by hash: half anywhere, half around the first digit or @."""
    text, draw = F.col(text_col), F.xxhash64(F.lit(3), F.col(text_col))
    length = F.length(text)
    anywhere = F.pmod(draw, F.greatest(length - LEARN_WINDOW, F.lit(1))).cast("int")
    first = F.regexp_instr(text, F.lit("[0-9@]")) - 1 - F.pmod(draw, F.lit(40)).cast("int")
    start = F.when((F.pmod(draw, F.lit(2)) == 0) & (first > 0), first).otherwise(anywhere)
    rows = documents.where(text.isNotNull() & (length > 0)).select(draw.alias("draw"), F.substring(text, start + 1, F.lit(LEARN_WINDOW)).alias("piece"))
    # A draw below the share that holds several times the sample: no task sends more than it must.
    grain = 1 << 30
    rows = rows.where(F.pmod(F.shiftright("draw", 8), F.lit(grain)) < min(grain, 8 * size * grain // max(1, documents.count()) + 1))
    found = rows.orderBy("draw", "piece").limit(4 * size).collect()  # copies of a text have one draw
    return sorted({r["piece"] for r in found}, key=lambda p: (hash_of(p), p))[:size]


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


@dataclass
class Tagger:
    """Parameters of the network; None where there was nothing to learn from."""

    parameters: dict[str, np.ndarray] | None


def train(pieces: list[str], epochs: int = EPOCHS, batch: int = BATCH, seed: int = 11) -> Tagger:
    if not pieces:
        return Tagger(None)
    x, y = windows_to_learn(pieces, np.random.default_rng(seed))
    return Tagger(bilstm.train(x, y, SYMBOLS, TAGS, epochs, min(batch, len(x)), seed))


# ---------------------------------------------------------------- decoding of whole texts


def cut(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and start of the windows that cover texts of the given lengths."""
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(lengths)), n)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def telling(text: str, start: np.ndarray) -> np.ndarray:
    """Which windows lie near enough to a telling character to hold a part of an acceptable span."""
    at = np.array([m.start() for m in _TELLING.finditer(text)], np.int64)
    return np.searchsorted(at, start + WINDOW + LONGEST) > np.searchsorted(at, start - LONGEST)


def tagged(p: dict[str, np.ndarray], texts: list[str], everywhere: bool = False, chunk: int = 512) -> list[list[tuple[int, int, int, float, bool]]]:
    """For each text the spans of its windows: (start, kind, end, score, touches an inner border)."""
    codes = [symbols(t) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([*codes, np.full(WINDOW, PADDING, np.uint8)])
    first = np.cumsum(lengths) - lengths
    owner, start = cut(lengths)
    if not everywhere:
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        near = [telling(t, start[lo:hi]) for t, lo, hi in zip(texts, bounds[:-1], bounds[1:])]
        near = np.concatenate(near) if near else np.zeros(0, bool)
        owner, start = owner[near], start[near]
    out: list[list[tuple[int, int, int, float, bool]]] = [[] for _ in texts]
    for lo in range(0, len(owner), chunk):
        who, at = owner[lo:lo + chunk], start[lo:lo + chunk]
        place = at[:, None] + np.arange(WINDOW)
        x = np.where(place < lengths[who][:, None], flat[np.minimum(first[who][:, None] + place, len(flat) - 1)], PADDING)
        tags, lead = bilstm.decode(p, np.ascontiguousarray(x.T).astype(np.intp))
        tags, lead = tags.T, lead.T
        for w in np.flatnonzero(tags.any(1)).tolist():
            row, text, offset = tags[w], int(who[w]), int(at[w])
            size = min(WINDOW, int(lengths[text]) - offset)
            kind = (row[:size].astype(np.int64) - 1) // 2  # -1 outside
            begins = (row[:size] % 2 == 1) | (np.concatenate([[-1], kind[:-1]]) != kind)
            edges = np.append(np.flatnonzero(begins), size)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if kind[a] >= 0:
                    inner = (a == 0 and offset > 0) or (b == size and offset + size < lengths[text])
                    out[text].append((offset + a, int(kind[a]), offset + b, float(lead[w, a:b].sum()), inner))
    return out


def reconcile(text: str, found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """One set of spans for the whole text from those of its windows."""
    whole = {}
    for start, kind, end, score, inner in found:
        if not inner:
            whole[start, kind, end] = max(score, whole.get((start, kind, end), score))
    cut_ones = sorted((s for s in found if s[4]), key=lambda s: (s[1], s[0], s[2]))
    joined: list[list] = []
    for start, kind, end, score, _ in cut_ones:  # what two windows cut apart
        if joined and joined[-1][1] == kind and start <= joined[-1][2]:
            joined[-1][2], joined[-1][3] = max(joined[-1][2], end), joined[-1][3] + score
        else:
            joined.append([start, kind, end, score])
    for start, kind, end, score in joined:
        whole.setdefault((start, kind, end), score)
    fit = []
    for (start, kind, end), score in whole.items():
        while start < end and (text[start].isspace() or text[start] in ",;:"):
            start += 1
        while start < end and (text[end - 1].isspace() or text[end - 1] in ".,;:"):
            end -= 1
        if score > 0 and not _goes_on(text, start, end) and holds(kind, text[start:end]):
            fit.append((start, kind, end, score))
    return choose(fit)


def _goes_on(text: str, start: int, end: int) -> bool:
    """Does a letter or digit follow or precede without a break?"""
    return (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def all_spans(p: dict[str, np.ndarray] | None, texts: list[str], everywhere: bool = False) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, by pattern) of each text, sorted."""
    extra = tagged(p, texts, everywhere) if p is not None else [[] for _ in texts]
    out = []
    for text, found in zip(texts, extra):
        base = base_spans(text)
        spans = [(*s, True) for s in base]
        if found:
            taken = np.array(sorted((s, e) for s, _, e in base), np.int64).reshape(-1, 2)
            reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
            for s in reconcile(text, found):
                before = int(np.searchsorted(taken[:, 0], s[2], "left"))  # base spans that begin before this one ends
                if not before or reach[before - 1] <= s[0]:
                    spans.append((*s, False))
        out.append(sorted(spans))
    return out


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.parameters
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            lo = 0
            while lo < len(texts):  # a bounded number of characters at a time, or one text
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 20):
                    size += len(texts[hi])
                    hi += 1
                made = all_spans(p, texts[lo:hi])
                spans = pa.array(
                    [[{"kind": KINDS[k], "start": s, "end": e, "base": base} for s, k, e, base in row] for row in made], _SPANS)
                kept = batch.slice(lo, hi - lo).column("_keep")
                yield pa.RecordBatch.from_arrays([kept, spans], names=["_keep", "spans"])
                lo = hi

    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(documents: DataFrame, tagger: Tagger, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """``keep`` and ``spans``: an array of (kind, start, end, base), in code points, end exclusive, for every row."""
    rows = spread(documents.select(F.struct(*keep).alias("_keep"), F.col(text_col).alias("_text")))
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    schema = f"_keep {rows.schema['_keep'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return rows.mapInArrow(_find(shared), schema).select("_keep.*", "spans")


def masked(text: Column | str, spans: Column | str) -> Column:
    """The text with ``[KIND]`` in place of each span; of overlapping spans the first to start counts."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    start = F.struct(F.lit("").alias("said"), F.lit(0).cast("long").alias("at"))

    def step(held: Column, s: Column) -> Column:
        done = s["start"] < held["at"]
        said = F.concat(held["said"], F.substring(text, held["at"].cast("int") + 1, (s["start"] - held["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(done, held["said"]).otherwise(said).alias("said"), F.when(done, held["at"]).otherwise(s["end"]).alias("at"))

    folded = F.aggregate(spans, start, step)
    return F.concat(folded["said"], F.substring(text, folded["at"].cast("int") + 1, F.length(text)))
