from collections import Counter, defaultdict

import numpy as np

from gatehouse.llm import neardup, queries

from .conftest import docs_of, odd_rows, prose, texts_in
from .test_decontam import words_of


def bag(text, n=5):
    w = words_of(text)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def likeness(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def classes(docs, threshold=0.8):
    """Least id of each row's class, by comparing all pairs that share a shingle."""
    texts = sorted({t or "" for _, t in docs})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for k, b in enumerate(bags):
        for s in b:
            by[s].append(k)
    for k, b in enumerate(bags):
        for other in {o for s in b for o in by[s] if o > k}:
            if likeness(b, bags[other]) >= threshold:
                parent[root(other)] = root(k)
    at = {t: root(k) for k, t in enumerate(texts)}
    least = {}
    for i, t in docs:
        if i is not None:
            least[at[t or ""]] = min(i, least.get(at[t or ""], i))
    return [(i, least.get(at[t or ""])) for i, t in docs]


def order(r):
    return tuple((x is not None, x or 0) for x in r)


def check(df, docs):
    rows = df.collect()
    assert sorted(((r.doc_id, r.class_id) for r in rows), key=order) == sorted(classes(docs), key=order)
    kept = Counter(r.class_id for r in rows if r.kept)
    assert set(kept) == {r.class_id for r in rows}
    return rows


def test_query(spark, small):
    rows = check(queries.op10_near_duplicates(spark, small), texts_in(small))
    assert 0 < sum(not r.kept for r in rows) < len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_signature_estimates_weighted_likeness():
    a = Counter({i: 1 + i % 7 for i in range(300)})
    b = Counter({i: 1 + (i * i) % 5 for i in range(60, 360)})
    doc = np.repeat([0, 1], [len(a), len(b)])
    element = neardup.mix(np.array([*a, *b]).astype(np.uint64) + np.uint64(77))
    sig = neardup.bag_min_hash(doc, element, np.array([*a.values(), *b.values()]), 2, 20_000)
    assert abs((sig[0] == sig[1]).mean() - likeness(a, b)) < 0.015


def test_chains_copies_and_repeats_in_multisets(spark):
    base = prose(1, 200).split()
    docs = [(k, " ".join(base[: 200 - 4 * k] + prose(50 + k, 4 * k).split())) for k in range(12)]  # a chain: neighbours are alike
    docs += [(100 + k, prose(2, 80)) for k in range(30)]  # copies
    docs += [(200, "a b c d e " * 40), (201, "a b c d e " * 38), (202, "a b c d e " * 10)]  # one set, other multisets
    docs += [(300 + k, prose(300 + k, 60)) for k in range(20)]
    rows = check(neardup.classify(docs_of(spark, docs)), docs)
    of = {r.doc_id: r.class_id for r in rows}
    assert of[201] == 200
    assert of[202] == 202
    assert {of[k] for k in range(100, 130)} == {100}


def test_large_group_of_near_copies_stays_small_and_whole(spark):
    base = prose(6, 120).split()
    docs = [(k, " ".join([*base[:60], f"x{k}", *base[61:]])) for k in range(400)]
    rows = neardup.classify(docs_of(spark, docs)).collect()
    assert {r.class_id for r in rows} == {0}
    assert sum(r.kept for r in rows) == 1


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs):
    check(neardup.classify(odd_docs), odd_rows())
    assert neardup.classify(no_docs).count() == 0
    kept = neardup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in odd_rows()})
    assert neardup.deduplicate(no_docs).count() == 0
