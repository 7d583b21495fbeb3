import re

import numpy as np
import pyarrow as pa
import pytest

from gatehouse.llm import tokens
from gatehouse.llm.textvec import FEW_BYTES, text_blocks, words_of

from .conftest import prose


def held_mb() -> float:
    with open("/proc/self/status") as f:
        return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024


def test_memory_goes_back_after_a_batch():
    try:
        before = held_mb()
    except (OSError, TypeError):
        pytest.skip("no /proc here")
    once = pa.array([prose(k, 2000) for k in range(40)])
    for _ in text_blocks(once, FEW_BYTES):
        pass
    before = held_mb()
    scraps = []  # small arrays between the large ones keep the heap's top in place
    for _, _, texts in text_blocks(pa.array(once.to_pylist() * 40), FEW_BYTES):
        words = words_of(texts)
        large = [np.ones(1 << 16) for _ in range(400)]
        scraps.append(np.ones(4000))
        del large, words
    assert held_mb() - before < 60


def test_a_table_of_pieces_grows_with_them():
    pieces = tokens.Pieces()
    assert pieces.low.nbytes + pieces.high.nbytes + pieces.value.nbytes < 4 << 20
    rng = np.random.default_rng(5)
    low = np.unique(rng.integers(1, 1 << 62, 150_000).astype(np.uint64))
    high = (low % np.uint64(7)) + np.uint64(1)
    for at in np.array_split(np.arange(len(low)), 9):
        pieces.insert(low[at], high[at], at)
        assert 2 * pieces.count <= len(pieces.value)
        assert (pieces.find(low[at], high[at]) == at).all()
    assert (pieces.find(low, high) == np.arange(len(low))).all()
    assert (pieces.find(low, high + np.uint64(9)) == -1).all()
    assert pieces.count == len(low)
