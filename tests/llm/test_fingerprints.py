import hashlib
import re

import numpy as np

from gatehouse.llm import fingerprints as fp
from gatehouse.llm import queries

from .conftest import odd_rows, prose, texts_in

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingle_set(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(rows) == len(docs)
    want = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted((str(w[0]), w[1], w[2]) for w in want)
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in rows}
    errors = []
    for i, n, sha, text, edited, after in want:
        r = by[i, n, sha]
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingle_set(text), shingle_set(other)
            if len(a | b) <= 128:
                assert abs(got - jaccard(a, b)) < 1e-9
            errors.append(abs(got - jaccard(a, b)))
    assert max(errors) < 0.2
    assert np.mean(errors) < 0.03
    same = {}
    for w in want:
        assert same.setdefault(w[3], by[w[0], w[1], w[2]].fingerprint) == by[w[0], w[1], w[2]].fingerprint


def test_query(spark, small):
    check(queries.op3_fingerprints(spark, small).collect(), texts_in(small))


def test_ranges_keep_each_document_with_the_next(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spread = fp.with_next(fp.documents_of(docs), per_range=37)
    assert spread.select("range").distinct().count() > 10
    assert spread.where("not is_next").count() == docs.count()


def test_odd_rows_and_an_empty_table(odd_docs, no_docs):
    check(fp.fingerprint_edits(odd_docs).collect(), odd_rows())
    assert fp.fingerprint_edits(no_docs).count() == 0
    assert fp.fingerprint(no_docs).count() == 0


def test_sketches_merge_and_estimate():
    a, b = prose(1, 3000), prose(2, 3000)
    (sa,), (sb,) = fp.sketches([a]), fp.sketches([b])
    whole = fp.merge(sa, sb)
    assert fp.from_string(fp.to_string(whole))[0].tolist() == whole.tolist()
    assert abs(fp.distinct_count(whole) / 5992 - 1) < 0.35
    assert abs(fp.containment(sa, whole) - 1) < 0.2
    assert fp.containment(sa, sb) < 0.1
    assert fp.resemblance(sa, sa) == 1.0
    assert fp.resemblance(sa, np.zeros(0, np.uint64)) == 0.0
    assert fp.from_string(fp.to_string(np.zeros(0, np.uint64)))[0].tolist() == []
