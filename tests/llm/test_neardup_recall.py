"""Recall of links against brute force, over real texts and copies of them edited by a few words."""

import random
from collections import defaultdict

from gatehouse.llm import neardup

from .conftest import docs_of, texts_in
from .test_neardup import bag, likeness


def edited(rng, text, share):
    words = text.split(" ")
    for k in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = f"other{k}"
    return " ".join(words)


def test_links_of_likeness_08_or_more_are_found(spark, small):
    rng = random.Random(9)
    docs = texts_in(small)
    docs += [(100_000 + 10 * i + k, edited(rng, t, share)) for i, t in docs[::5] for k, share in enumerate((0.004, 0.01, 0.02, 0.03))]
    bags = {i: bag(t) for i, t in docs}
    holders = defaultdict(set)
    for i, b in bags.items():
        for s in b:
            holders[s].add(i)
    asked = [i for i, _ in docs if i % 50 == 0 or i >= 100_000]
    text = dict(docs)
    links = {(i, j) for i in asked for j in {j for s in bags[i] for j in holders[s] if j != i} if text[i] != text[j] and likeness(bags[i], bags[j]) >= 0.8}
    of = {r.doc_id: r.class_id for r in neardup.classify(docs_of(spark, docs)).collect()}
    found = sum(of[i] == of[j] for i, j in links)
    assert len(links) > 400
    assert found >= 0.97 * len(links), (found, len(links))
    by_text = defaultdict(set)
    for i, t in docs:
        by_text[t].add(of[i])
    assert all(len(classes) == 1 for classes in by_text.values())  # no copy is missed
