import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gatehouse.llm import packing, queries
from gatehouse.llm.tokens import Encoder

from .conftest import docs_of, odd_rows, texts_in

VOCAB = queries.vocabulary(queries.WORD_VOCAB)


@pytest.mark.parametrize("name", [queries.WORD_VOCAB, queries.BYTE_VOCAB])
def test_encoder_equals_the_library(name, small):
    path = queries.vocabulary(name)
    lib, own = Tokenizer.from_file(path), Encoder(path)
    texts = [t for _, t in texts_in(small)] + [t or "" for _, t in odd_rows()] + ["a  b", " lead", "trail ", "\n\nx\n", "don't we'll", "don' t", "x y", "　z", "a b", "İstanbul", "ﬁne ½", "tab\tsep", "1,234.5", "éa", "#tag!!??", "a</w>b", "Ġword", "mixed123abc", "…", "'s", "\r\n", "x" * 5000, "a\r\nb", "a\n\n\nb c", "a\n b", "a \nb", "a\tb c\t d", "a\u00a0b\u3000 c", "end\n", "\nstart", " ", "one\ntwo three\nfour", "foo…*** bar’s, it's.", "12, 3.5% of", "naïve— word", "a\x00b c", "x\u200b y.", "don't, won't!!"]
    rng = random.Random(5)
    texts += ["".join(rng.choice(["a", "b1", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "\u3000", "…", "!"]) for _ in range(30)) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        got = own.encode(texts)
        for text, raw in zip(texts, got, strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text[:80]


def test_encoder_forgets_and_stays_right(monkeypatch, tiny):
    monkeypatch.setattr("gatehouse.llm.tokens.MAX_PIECES", 50)
    lib, own = Tokenizer.from_file(VOCAB), Encoder(VOCAB)
    texts = [t for _, t in texts_in(tiny)]
    assert [np.frombuffer(r, "<u4").tolist() for r in own.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def least_bins(lengths, capacity):
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= lengths[i]}):
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_least_number_of_bins():
    rng = np.random.default_rng(1)
    tight = 0
    for _ in range(300):
        lengths = rng.integers(1, 21, rng.integers(1, 8))
        least, bound = least_bins(sorted(lengths.tolist(), reverse=True), 20), packing.lower_bound(lengths, 20)
        assert bound <= least
        tight += bound == least
    assert tight > 250
    assert packing.lower_bound(np.zeros(0, np.int64), 20) == 0


def test_best_fit_decreasing_places_everything_without_overlap():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 3000)
    bins, offsets, n = packing.best_fit_decreasing(lengths, 2048)
    assert set(bins.tolist()) == set(range(n))
    at = np.lexsort((offsets, bins))
    new = np.append(True, bins[at][1:] != bins[at][:-1])
    assert (offsets[at] == np.where(new, 0, np.append(0, (offsets + lengths)[at][:-1]))).all()
    assert (offsets + lengths <= 2048).all()


def check_packed(rows, docs, capacity=2048):
    lib = Tokenizer.from_file(VOCAB)
    want = []
    for doc_id, text in docs:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    order = lambda x: (x[0] is not None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), packing.lower_bound(np.array([w[3] for w in want]), capacity)


def test_query_packs_all_documents_nearly_as_tight_as_the_bound(spark, small):
    n, bound = check_packed(queries.op1_best_fit_packing(spark, small).collect(), texts_in(small))
    assert n <= bound + 1


def test_many_partitions_exchange_their_gaps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n, bound = check_packed(packing.pack(docs, VOCAB, per_partition=60).collect(), texts_in(small))
    assert n <= bound * 1.02 + 1


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs):
    check_packed(packing.pack(odd_docs, VOCAB).collect(), odd_rows())
    assert packing.pack(no_docs, VOCAB).count() == 0


def test_large_ids_beside_a_null_stay_exact(spark):
    docs = [(9007199254740993, "one two"), (9007199254740995, "three four five"), (None, "six"), (-9223372036854775807, "seven")]
    rows = packing.pack(docs_of(spark, docs), queries.vocabulary(queries.WORD_VOCAB), capacity=8, per_partition=2).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i, _ in docs if i is not None)
    assert sum(r.doc_id is None for r in rows) == 1
    check_packed(rows, docs, capacity=8)
