"""Words as arrays against a regular expression."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import foliant.llm.bytetext as B
from tests.llm.cases import lower_words


def check(texts):
    found = B.words(pa.array(texts, pa.string()))
    codes = {}
    for i, text in enumerate(texts):
        lo, hi = found.bounds[i], found.bounds[i + 1]
        own = [bytes(B.ALNUM[found.data[found.start[k]:found.end[k]]]).decode() for k in range(lo, hi)]
        assert own == lower_words(text)
        for word, code in zip(own, found.hash[lo:hi].tolist()):
            assert codes.setdefault(word, code) == code
    assert len(set(codes.values())) == len(codes)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.none(), st.text("ab1 É.\n日\U0001F600", max_size=40)), max_size=8), st.sampled_from([7, 16, 1 << 20]))
def test_words_in_blocks_of_any_size(texts, block):
    old = B.BLOCK
    try:
        B.BLOCK = block
        B._powers.cache_clear()
        check(texts)
    finally:
        B.BLOCK = old
        B._powers.cache_clear()


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 100, 3, 3, 0)])], names=["t"])
    parts = list(B.slices(batch, "t", 10))
    assert [t for p in parts for t in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert all(len("".join(p.column("t").to_pylist())) <= 10 or p.num_rows == 1 for p in parts)


def test_sums():
    assert B.spread_sums(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]
