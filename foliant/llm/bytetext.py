"""Words of UTF-8 texts as numpy arrays, for use inside tasks.

Texts come as Arrow string arrays. Their bytes are read in place, cut into blocks at
word ends, and each word gets a 64-bit hash. Memory beside the texts themselves is
bounded by the block size and by 28 bytes for each word of one slice of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def byte_table(separators: bytes, fold_case: bool = True) -> np.ndarray:
    """Maps each byte to itself (A-Z to a-z if ``fold_case``), and separators to 0."""
    table = np.arange(256, dtype=np.uint8)
    if fold_case:
        table[65:91] += 32
    table[list(separators)] = 0
    table[0] = 0
    return table


#: A-Z become a-z; every ASCII character but letters and digits separates words.
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Only ASCII white space separates words.
SPACED = byte_table(b" \t\n\v\f\r")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = np.full(BLOCK + 1, _BASE, np.uint64)
    back = np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


@dataclass
class Words:
    """Words of some rows: row number in the slice, byte range in ``data``, hash."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 row offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _hash_block(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, back = _powers()
    if len(block) <= BLOCK:
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * power[:len(block)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * back[starts])
    # A single word longer than a block: fold its pieces one by one.
    total = np.zeros(1, np.uint64)
    for lo in range(0, len(block), BLOCK):
        piece = block[lo:lo + BLOCK]
        total = total * np.uint64(_BASE) + np.sum(piece * power[:len(piece)], dtype=np.uint64)
    return mix(total)


def words(texts: pa.Array, table: np.ndarray = ALNUM) -> Words:
    """All words of ``texts``, in order."""
    data, offsets = text_bytes(texts)
    starts, ends, hashes = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK)
        while hi < n:  # cut after a separator or at a row border, else take a longer block
            zeros = np.flatnonzero(table[data[lo:hi]] == 0)
            border = offsets[np.searchsorted(offsets, hi, "right") - 1]
            cut = max(lo + zeros[-1] + 1 if len(zeros) else lo, border)
            if cut > lo:
                hi = int(cut)
                break
            rest = np.flatnonzero(table[data[hi:hi + BLOCK]] == 0)
            border = int(offsets[np.searchsorted(offsets, hi, "right")])
            hi = min(border, hi + int(rest[0]) if len(rest) else hi + BLOCK)
            if len(rest) or hi == border:
                break
        block = table[data[lo:hi]]
        full = np.zeros(len(block) + 2, bool)
        full[1:-1] = block != 0
        border = np.zeros(len(block) + 1, bool)
        inside = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, "right")] - lo
        border[inside] = True
        first = full[1:] & (~full[:-1] | border)
        last = full[:-1] & (~full[1:] | border)
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            starts.append(s + lo)
            ends.append(e + lo)
            if len(block) > BLOCK and len(s) > 1:  # a long word after short ones
                hashes.append(np.concatenate([_hash_block(block[a:b], np.array([0]), np.array([b - a])) for a, b in zip(s, e)]))
            else:
                hashes.append(_hash_block(block[s[0]:e[-1]] if len(block) > BLOCK else block, s, e))
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    code = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, row, start, end, code, np.searchsorted(row, np.arange(len(offsets))))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` text bytes, or of one row."""
    _, offsets = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def spread_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range bounds[i]:bounds[i + 1]; 0 for empty ranges."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
