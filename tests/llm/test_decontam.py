import hashlib
import random
import re

from gatehouse.llm import decontam, queries

from .conftest import docs_of, odd_rows, prose, texts_in

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    found |= own
                    hit |= set(range(k, k + size))
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(r):
    return (r[0] is not None, r)


def check(df, docs, items):
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in df.collect()), key=key)
    assert got == sorted(brute(docs, items), key=key)
    return got


def items_in(sf_dir):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    return list(zip(t["item_id"], t["text"], strict=True))


def test_query(spark, small):
    want = {r[0]: r for r in brute(texts_in(small), items_in(small))}
    rows = queries.op8_decontamination(spark, small).collect()
    assert len(rows) == len(want)
    for r in rows:
        _, n, hit, found, bad = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bad)
    assert 0 < sum(r.contaminated for r in rows) < len(rows)


def test_every_long_shared_span_is_found(spark):
    rng = random.Random(8)
    items = [(i, prose(100 + i, rng.choice([3, 12, 13, 14, 40]))) for i in range(30)] + [(None, "lone Words"), (31, None), (32, ""), (33, "same same same same same same same same same same same same same same")]
    docs = []
    for d in range(60):
        parts = [prose(1000 + d, rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[a : a + rng.randint(1, 20)]).upper(), prose(rng.randint(0, 10**6), rng.randint(0, 20))]
        docs.append((d, "; ".join(parts)))
    docs += [(100, "same " * 40), (101, "a lone, words b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = check(decontam.contamination(docs_of(spark, docs), bench), docs, items)
    assert sum(r[4] for r in got) > 4


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    items = [(1, prose(9, 200)), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    check(decontam.contamination(odd_docs, bench), odd_rows(), items)
    check(decontam.contamination(odd_docs, bench.limit(0)), odd_rows(), [])
    assert decontam.contamination(no_docs, bench).count() == 0
