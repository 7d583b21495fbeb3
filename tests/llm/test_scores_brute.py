"""Scores of both classifiers computed once more, a text at a time, in plain Python from the fitted weights."""

import math
import re

import numpy as np

from gatehouse.llm import quality, textvec, toxicity
from gatehouse.llm.common import documents_of

from .conftest import docs_of, odd_rows, prose

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
MASK = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> shift
        x = x * factor & MASK
    return x ^ (x >> 31)


def word_hash(word):
    folded = word.lower()  # ASCII only, as bytes
    total = sum(mixed((c + 0x9E3779B97F4A7C15) & MASK) * pow(textvec._BASE, i, 1 << 64) for i, c in enumerate(folded))
    return mixed((total + len(folded) * 0xD6E8FEB86659FD93) & MASK)


def sentences(raw):
    """Words of each sentence that has any; a sentence ends at . ! ? or a line's end."""
    return [w for s in re.split(rb"[.!?\n]", raw) if (w := WORD.findall(s))]


def toxic_score(model, text):
    clean = 1.0
    for words in sentences(text.encode()):
        z = model.bias
        for w in words:
            z += model.weights[word_hash(w) >> 44] + sum(model.weights[mixed((word_hash(w[:n]) + n) & MASK) >> 44] for n in toxicity.PREFIX_BYTES)
        clean *= 1 - 1 / (1 + math.exp(-max(-40, min(40, z))))
    return 1 - clean


def style(text):
    raw = text.encode()
    words = [w.lower() for w in WORD.findall(raw)]
    share = np.zeros(quality.N_CLASSES)
    for c in raw:
        share[quality._CLASS[c]] += 1
    upper, lower, lines = share[quality._UPPER], share[quality._LOWER], share[quality._CLASS[10]]
    n, size = max(len(words), 1), max(len(raw), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n

    def distinct(k):
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        return len(set(grams)) / max(len(grams), 1)

    extra = [math.log1p(len(raw)), mean, math.sqrt(max(sum(x * x for x in lengths) / n - mean**2, 0)), distinct(1), distinct(3), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, upper / max(upper + lower, 1), lines / n]
    return np.array([*(share / size), *extra])


def quality_score(model, text):
    z = model.bias
    for j, (cuts, x) in enumerate(zip(model.cuts, style(text), strict=True)):
        z += model.weights[j][sum(c < x for c in cuts)]
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def planted(spark, labels_of):
    docs = [(k, prose(k, 60 + k % 9) + (" grumblefoot." if k % 2 else "!") * (1 + k % 3)) for k in range(300)]
    docs += [(1000 + i, t) for i, t in odd_rows() if i and i > 4]
    return docs_of(spark, docs), labels_of([(k, k % 2, k % 2) for k in range(300)])


def test_toxicity_scores(spark, labels_of):
    docs, labels = planted(spark, labels_of)
    model = toxicity.fit(documents_of(docs), labels)
    assert np.count_nonzero(model.weights)
    scored = toxicity.score(documents_of(docs), model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len({round(r.score, 6) for r in scored}) > 10
    for r in scored:
        assert math.isclose(r.score, toxic_score(model, r.text or ""), abs_tol=1e-5)


def test_quality_scores(spark, labels_of):
    docs, labels = planted(spark, labels_of)
    features = quality.features_of(documents_of(docs))
    model = quality.fit(features, labels)
    scored = quality.score(features, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len({round(r.score, 6) for r in scored}) > 10
    for r in scored:
        assert math.isclose(r.score, quality_score(model, r.text or ""), abs_tol=1e-6)


def test_fits_count_an_id_once(spark, labels_of):
    docs, labels = planted(spark, labels_of)
    once = [toxicity.fit(documents_of(docs), labels), quality.fit(quality.features_of(documents_of(docs)), labels)]
    labels = labels.union(labels).union(labels.where("doc_id < 40"))
    docs = docs.union(docs.where("doc_id < 50")).union(docs.where("doc_id = 7"))
    again = [toxicity.fit(documents_of(docs), labels), quality.fit(quality.features_of(documents_of(docs.dropDuplicates(["doc_id"]))), labels)]
    assert np.allclose(once[0].weights, again[0].weights) and math.isclose(once[0].bias, again[0].bias)
    assert np.allclose(once[1].weights, again[1].weights)
