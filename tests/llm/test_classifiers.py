import random
import zlib

import numpy as np

from gatehouse.llm import quality, queries, toxicity

from .conftest import docs_of, odd_rows, prose


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    order = np.argsort(np.argsort(s, kind="stable")) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def labels_in(sf_dir, column):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    return dict(zip(t["doc_id"], t[column], strict=True))


def held_out(df, sf_dir, column, mod, rest):
    rows, known = df.collect(), labels_in(sf_dir, column)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        assert 0 <= r.score <= 1
    own = [r for r in rows if r.held_out and known.get(r.doc_id) is not None]
    return rows, [r.score for r in own], [r.predicted for r in own], [known[r.doc_id] for r in own]


def test_toxicity_held_out(spark):
    rows, scores, predicted, y = held_out(queries.op4_toxicity(spark, "/root/testdata/sf0.1"), "/root/testdata/sf0.1", "toxic", 3, 1)
    assert len(rows) == 10_000
    assert auc(scores, y) > 0.95
    assert np.mean(np.array(predicted)[np.array(y) == 1]) > 0.8
    assert np.mean(np.array(predicted)[np.array(y) == 0]) < 0.02


def test_quality_held_out(spark):
    rows, scores, predicted, y = held_out(queries.op9_quality(spark, "/root/testdata/sf0.1"), "/root/testdata/sf0.1", "quality", 5, 0)
    assert len(rows) == 10_000
    assert auc(scores, y) > 0.95
    assert np.mean(np.array(predicted)[np.array(y) == 1]) > 0.8
    assert np.mean(np.array(predicted)[np.array(y) == 0]) < 0.4


def test_noisy_or():
    assert np.allclose(toxicity.noisy_or(np.array([0.5, 0.5, 0.2]), np.array([0, 0, 2]), 3), [0.75, 0, 0.2])


def test_offending_sentences_are_found(spark, labels_of):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(400):
        parts = [prose(k * 10 + j, 8) for j in range(5)]
        if k % 2:
            parts[rng.randrange(5)] += " grumblefoot"
        docs.append((k, ". ".join(parts) + "."))
        labels.append((k, 1, k % 2))
    rows = toxicity.score_toxicity(docs_of(spark, docs), labels_of(labels)).collect()
    text = dict(docs)
    for r in rows:
        assert r.predicted == r.doc_id % 2
        assert all("grumblefoot" in text[r.doc_id][s.start : s.end] for s in r.offending)
        assert bool(r.offending) == bool(r.doc_id % 2)


def test_toxicity_odd_rows(spark, odd_docs, no_docs, labels_of):
    labels = labels_of([(1, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (5, 1, 0)])
    rows = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.score == 0 for r in rows if r.doc_id in (1, 2, 6))
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert toxicity.score_toxicity(odd_docs, labels.limit(0)).count() == len(odd_rows())
    assert toxicity.keep_clean(odd_docs, labels.limit(0)).columns == odd_docs.columns
    assert toxicity.keep_clean(no_docs, labels).count() == 0


def test_quality_odd_rows(spark, odd_docs, no_docs, labels_of):
    labels = labels_of([(1, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (5, 1, 0)])
    rows = quality.score_quality(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_class_prior_is_estimated():
    rng = np.random.default_rng(4)
    pos = rng.normal(2, 1, 2000)
    unl = np.concatenate([rng.normal(2, 1, 1200), rng.normal(-2, 1, 2800)])
    assert abs(quality.estimate_prior(pos, unl) - 0.3) < 0.08


def test_risk_learns_from_positives_and_unlabelled_only():
    rng = np.random.default_rng(5)
    make = lambda n, shift: rng.normal(shift, 1, (n, quality.N_FEATURES))
    model = quality.train(make(800, 0.4), np.concatenate([make(600, 0.4), make(1400, -0.4)])[rng.permutation(2000)])
    assert abs(model.prior - 0.3) < 0.1
    assert auc(np.concatenate([model.scores(make(300, 0.4)), model.scores(make(300, -0.4))]), [1] * 300 + [0] * 300) > 0.95
