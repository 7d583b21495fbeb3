import corpus_pipeline
from gatehouse.llm import queries

from .conftest import docs_of, odd_rows, texts_in
from .test_classifiers import labels_in
from .test_decontam import brute, items_in
from .test_neardup import classes
from .test_packing import check_packed
from .test_pii import base


def test_stages_against_brute_force(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    clean = stage["toxicity"](spark, docs, small)
    assert clean.columns == docs.columns
    scored = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, small).collect()}
    assert sorted(pairs(clean)) == sorted((i, t) for i, t in texts_in(small) if not scored[i])
    toxic = {i for i, y in labels_in(small, "toxic").items() if y}
    assert len(toxic - {i for i, _ in pairs(clean)}) >= 0.7 * len(toxic)

    unique = stage["near duplicates"](spark, clean, small)
    assert sorted(i for i, _ in pairs(unique)) == sorted({c for _, c in classes(pairs(clean))})

    apart = stage["decontamination"](spark, unique, small)
    bad = {r[0] for r in brute(pairs(unique), items_in(small)) if r[4]}
    assert bad
    assert sorted(i for i, _ in pairs(apart)) == sorted(i for i, _ in pairs(unique) if i not in bad)

    redacted = stage["personal data"](spark, apart, small)
    assert redacted.columns == docs.columns
    assert dict(redacted.dtypes) == dict(docs.dtypes)
    assert redacted.count() == apart.count()
    assert all(not any(base(t).values()) for _, t in pairs(redacted))

    n, bound = check_packed(stage["packing"](spark, redacted, small).collect(), pairs(redacted))
    assert n <= bound + 1


def test_run_is_the_query(spark, tiny):
    rows = queries.pipeline(spark, tiny)
    assert rows.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < rows.select("doc_id").distinct().count() < 200


def test_stages_take_odd_rows_and_empty_tables(spark, tiny, odd_docs, no_docs):
    for docs in (odd_docs, no_docs, docs_of(spark, [(1, None)])):
        empty = docs is no_docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tiny)
            if empty:
                assert out.count() == 0
            elif stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns
                assert 0 < out.count() <= len(odd_rows())
            docs = out
