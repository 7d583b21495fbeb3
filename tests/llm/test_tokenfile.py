import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gatehouse.llm import queries, tokenfile

from .conftest import odd_rows, texts_in

VOCAB = queries.vocabulary(queries.BYTE_VOCAB)


def expected(docs):
    lib, at, out = Tokenizer.from_file(VOCAB), 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode())):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query_round_trip(spark, small):
    assert rows_of(queries.op2_token_file(spark, small)) == expected(texts_in(small))


def test_small_shards_and_odd_rows(spark, odd_docs, no_docs):
    assert rows_of(tokenfile.token_file_round_trip(odd_docs, VOCAB, queries.BYTE_VOCAB_SIZE, shard_tokens=100)) == expected(odd_rows())
    assert tokenfile.token_file_round_trip(no_docs, VOCAB, queries.BYTE_VOCAB_SIZE).count() == 0


def test_grammar_is_smaller_and_random_access_reads_only_a_range():
    rng = np.random.default_rng(5)
    phrases = [rng.integers(0, 1000, rng.integers(3, 12)) for _ in range(50)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 50, 40)]) for _ in range(100)]
    ids, counts = np.concatenate(docs).astype("<u4"), np.array([len(d) for d in docs])
    payload = tokenfile.compress(ids, counts, 1000, rounds=12)
    assert len(payload) < 0.3 * 4 * len(ids)
    shard = tokenfile.Shard(payload)
    assert (shard.read() == ids).all()
    for a, b in rng.integers(0, len(ids), (200, 2)).tolist():
        assert shard.read(a, b).tolist() == ids[a:b].tolist()
    assert shard.read(len(ids), len(ids) + 9).tolist() == []


def test_rules_do_not_cross_documents():
    ids, counts = np.array([1, 2] * 200), np.array([1] + [2] * 199 + [1])
    shard = tokenfile.Shard(tokenfile.compress(ids, counts, 10))
    # every document's border is also a symbol's border
    assert set(np.cumsum(counts).tolist()) <= set(shard.border.tolist())
    assert shard.read().tolist() == ids.tolist()


def test_wrong_input_is_refused():
    with pytest.raises(ValueError, match="16 bits"):
        tokenfile.compress(np.array([1]), np.array([1]), 70_000)
    with pytest.raises(ValueError, match="token shard"):
        tokenfile.Shard(b"none" + bytes(20))
