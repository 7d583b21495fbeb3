from gatehouse.llm import pii


def test_a_marker_in_the_text_is_no_letter(spark):
    mark = pii.MARK
    docs = spark.createDataFrame([(1, f"{mark}me@host.org"), (2, f"foo{mark}@bar.com"), (3, f"a@b{mark}c.org"), (4, f"1{mark}2 me@host.org")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.email] for r in pii.base_spans(docs).collect()}
    assert got == {1: [(1, 12, "me" + "@host" + pii.MARK + "org")], 2: [], 3: [], 4: [(4, 15, "me" + "@host" + pii.MARK + "org")]}
    kept = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert kept[1] == f"{mark}<EMAIL>"
    assert kept[2] == f"foo{mark}@bar.com"
