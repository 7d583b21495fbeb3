import hashlib
import random
import time

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gatehouse.llm import bytebpe
from tests.llm.conftest import odd_rows, prose, texts_in

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.RankEncoder(PATH, public.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.merges.rank, special_tokens={})


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_every_code_point_as_the_library(encoder, library):
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}'ll {c}1" for c in marks[i : i + 500]) for i in range(0, len(marks), 500)]
    assert encoder.encode(texts) == [as_bytes(library.encode_ordinary(t)) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"aeinstTH'sdl 1\n\t\r\x1c\x85\u3000éß日本.,!<|>", "<|endoftext|>", "  ", "n't", "'ll", "\U000323b0"]), max_size=60).map("".join))
def test_texts_as_the_library(encoder, library, text):
    assert encoder.encode([text, "x " + text]) == [as_bytes(library.encode_ordinary(t)) for t in (text, "x " + text)]


def test_pre_tokens_of_any_bytes_as_merging_by_rank(encoder, library):
    rng, m = random.Random(7), encoder.merges
    parts = [b"a", b"e", b" ", b"th", b"in", b"ing", b"\xc3", b"\xe3\x81", b"11"]
    for k in range(20_000):
        own = b"".join(rng.choice(parts) if k % 2 else rng.choice(m.token) for _ in range(rng.randint(1, 6)))
        assert m.encode(own) == library._core_bpe.encode_single_piece(own), own


def test_unreachable_tokens_and_equal_ranks():
    # "abc" is never reached: bc has no token, ab + c none of rank between; "aaa" from aa + a alone
    ranks = {bytes([c]): i for i, c in enumerate(b"abcx")} | {b"aa": 4, b"xab": 5, b"aaa": 6, b"bcx": 7}
    m = bytebpe.Merges(ranks)
    ref = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks | {bytes([c]): 8 + c for c in range(256) if c not in b"abcx"}, special_tokens={})
    rng = random.Random(2)
    for _ in range(3000):
        own = bytes(rng.choice(b"aaabcx") for _ in range(rng.randint(1, 9)))
        assert m.encode(own) == ref._core_bpe.encode_single_piece(own), own
    assert m.encode(b"xab") == [5] and m.encode(b"xaba") == [3, 0, 1, 0]


def test_time_is_linear(encoder):
    def seconds(n):
        rng = random.Random(3)
        own = bytes(rng.choice(b"abcdefgh") for _ in range(n))
        began = time.perf_counter()
        encoder.merges.encode(own)
        return time.perf_counter() - began

    seconds(50_000)
    assert seconds(400_000) < 10 * seconds(100_000)


def test_query_on_whole_texts(spark, tiny, library):
    from gatehouse.llm.queries import QUERIES

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_byte_bpe"](spark, tiny).collect()}
    want = {}
    for i, t in texts_in(tiny):
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = bytebpe.decode(bytebpe.encode(odd_docs, PATH, public.PATTERN), PATH, public.PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, as_bytes(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in odd_rows()]
    assert sorted(((r[0], bytes(r[1]), bytes(r[2])) for r in rows), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, bytebpe.round_trip(odd_docs, PATH, public.PATTERN).collect()), key=key) == sorted(map(tuple, rows), key=key)
    assert bytebpe.digest(bytebpe.decode(bytebpe.encode(no_docs, PATH, public.PATTERN), PATH, public.PATTERN)).count() == 0


def test_one_word_longer_than_a_block(encoder, library):
    text = prose(5, 60_000).replace(" ", "")
    assert encoder.encode([text])[0] == as_bytes(library.encode_ordinary(text))


def test_memos_start_anew(encoder, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MAX_PAIRS", 50)
    monkeypatch.setattr(bytebpe, "MAX_PRE_TOKENS", 20)
    text = prose(6, 3000) + " \x1c " + prose(7, 500)
    assert bytebpe.RankEncoder(PATH, public.PATTERN).encode([text])[0] == as_bytes(library.encode_ordinary(text))
