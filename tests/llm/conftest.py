import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that operators use inside; as further columns they must not matter.
CLASHING = ("text_key", "node", "class", "score", "fp", "n_words", "email", "token", "sequence_id", "rid", "slot", "draws", "band", "kind", "clean", "_id", "_th", "place", "toxic", "quality", "host")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = prose(3, 30_000)
    return [(None, "a text without an id"), (1, None), (2, ""), (3, long), (4, prose(4, 40)), (4, prose(4, 40)), (4, prose(5, 40)), (5, prose(4, 40)), (6, " \n\t"), (7, "one"), (8, "\x1c\x85 <|x|> \U0001f600"), (9, prose(9, 200))]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and further columns with clashing names."""
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in odd_rows()], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def texts_in(sf_dir):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return [(i, x or "") for i, x in zip(t["doc_id"], t["text"], strict=True)]
