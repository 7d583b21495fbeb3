import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from gatehouse.llm import filteraudit
from tests.llm.conftest import SCHEMA, odd_rows


def brute(rows, labels):
    """Every order walked document by document; rows are (doc_id, text, lang)."""
    good, toxic = ({i for i, q, t in labels if v(q, t) == 1 and i is not None} for v in (lambda q, t: q, lambda q, t: t))
    docs = []
    for i, t, lang in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": re.search("[#$%&*|]", text) is not None}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows)
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            all_ = left
            for k, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                out[part, "".join(order), k] = [len(left), len(gone), sum(x in d[1] for d in all_) - len(gone), sum(d[1] == {x} for d in all_), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, x] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def as_dict(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_planted_rows(spark, labels_of):
    long = " ".join(f"w{k}" for k in range(250))
    texts = [long, long + " $", long + " " + "ABCDEFGHIJ" * 5, "a " * 250, "a " * 250, "short", "short", "SHORT #", long, None, "", "\x1c\x85　a b\x0bc\x0ca"]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)] + [(0, long, "de"), (None, "short", ""), (None, long, "en"), (20, "100 words " * 100, "en")]
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (5, 1, None), (6, None, 1), (8, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA)
    got = as_dict(filteraudit.audit(docs, labels_of(labels)))
    assert got == brute(rows, labels)
    assert len(got) == 3 * 600 and any(v[2] for v in got.values())


def test_odd_rows(spark, odd_docs, no_docs, labels_of):
    labels = [(i, i % 2, 1 - i % 2) for i in range(9)]
    got = as_dict(filteraudit.audit(odd_docs.withColumns({"mask": F.lit("x"), "part": F.lit("y"), "n": F.lit(0)}), labels_of(labels)))
    assert got == brute([(i, t, None) for i, t in odd_rows()], labels)
    assert filteraudit.audit(no_docs, labels_of(labels)).count() == 0
    assert all(v[4] == v[5] == 0 for v in as_dict(filteraudit.audit(odd_docs, labels_of([]))).values())
