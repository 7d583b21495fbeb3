import hashlib
import random
import re

from gatehouse.llm import pii, queries

from .conftest import docs_of, odd_rows, prose, texts_in

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in PATTERNS.items()}


def check(found, docs):
    rows = pii.digest(found).collect()
    assert len(rows) == len(docs)
    want = sorted((str(i), *[len(s) for s in spans.values()], joined(spans)) for i, t in docs for spans in [base(t or "")])
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, ",".join(x for x in r.spans.split(",") if x.split(":")[0] in PATTERNS)) for r in rows)
    assert got == want
    listed = {(w[0], hashlib.sha256(w[-1].encode()).hexdigest()) for w in want}
    assert {(str(r.doc_id), r.base_sha256) for r in rows} == listed


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)


def test_query(spark, small):
    docs = texts_in(small)
    rows = {r.doc_id: r for r in queries.op6_pii(spark, small).collect()}
    for i, t in docs:
        spans = base(t)
        assert rows[i].base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert rows[i].spans.startswith(joined(spans))
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [len(s) for s in spans.values()]


def test_base_patterns_on_random_strings(spark):
    rng = random.Random(4)
    docs = [(k, "".join(rng.choice("0123456789.@-+ ()a_%é\n") for _ in range(rng.randint(0, 60)))) for k in range(1500)]
    docs += [(5000 + k, "".join(rng.choice(["@", ".", "a", "a.b", "1", "-", " ", "😀"]) for _ in range(40))) for k in range(500)]
    docs += [(7000 + k, "".join(rng.choice(["4111 1111 1111 1111", "4", "0", " ", "-", "1.2.3.4", ".", "999", "+1 (555) 010-9999", "x@y.zz"]) for _ in range(8))) for k in range(800)]
    check(pii.find(docs_of(spark, docs)), docs)


def test_bootstrap_finds_identifiers_in_the_context_of_seeds(spark):
    docs = [(k, f"{prose(k, 30)} write to contact person{k}@mail.example and so on") for k in range(40)]
    docs += [(100 + k, f"{prose(100 + k, 30)} write to contact ZX-99{k}-41{k} and so on") for k in range(10)]
    docs += [(200 + k, f"{prose(200 + k, 30)} room number 20{k}0{k}1 of the house") for k in range(10)]
    rows = {r.doc_id: r for r in pii.find(docs_of(spark, docs)).collect()}
    for k in range(10):
        assert [s.value for s in rows[100 + k].id] == [f"ZX-99{k}-41{k}"]
        assert rows[200 + k].id == []
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(spark, docs)).collect()}
    assert clean[3].endswith("contact <EMAIL> and so on")
    assert clean[103].endswith("contact <ID> and so on")
    assert clean[203] == docs[53][1]


def test_odd_rows_and_an_empty_table(odd_docs, no_docs):
    check(pii.find(odd_docs), odd_rows())
    assert pii.find(no_docs).count() == 0
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str(r) for r in odd_rows())
    assert pii.redact(no_docs).count() == 0


def test_long_runs_are_matched_in_linear_time(spark):
    make = lambda n: [(1, "1" * n), (2, "1." * n), (3, "a@" * n), (4, "a." * n + "@"), (5, "+1" + " " * n), (6, "1 " * n)]
    check(pii.find(docs_of(spark, make(500))), make(500))
    assert pii.find(docs_of(spark, make(20_000))).count() == 6


def test_sure_patterns_discover_tokens_of_any_shape_in_their_place_alone(spark):
    long = "k" * 80 + "9"
    docs = [(k, f"{prose(k, 30)} please write to contact person{k}@mail.example and so on") for k in range(60)]
    docs += [(100 + k, f"{prose(100 + k, 30)} please write to contact {w} and so on") for k, w in enumerate(("jane_doe", "x77", long, "kate", "12"))]
    docs += [(200, f"{prose(200, 30)} the room jane_doe and x77 of the house"), (201, "_" * 5000 + " " + "a1" * 5000)]
    rows = {r.doc_id: [s.value for s in r.id] for r in pii.find(docs_of(spark, docs)).collect()}
    assert [rows[100 + k] for k in range(5)] == [["jane_doe"], ["x77"], [long], [], []]
    assert rows[200] == rows[201] == [] and all(not rows[k] for k in range(60))
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(spark, docs)).collect()}
    assert clean[100].endswith("to contact <ID> and so on") and clean[200] == docs[65][1]
