"""Corpus pipeline: toxicity, near duplicates, benchmark contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) with documents' columns and returns them for the documents it keeps;
the last returns the packed pieces. In every stage a null text counts as empty, a null id is an id of its own, rows that repeat
an id are judged by their own texts, whole texts of any length are read, an empty table gives none, and
further columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import decontam, neardup, packing, pii, toxicity
from gatehouse.llm.common import Scratch, rows_with, table, text_of
from gatehouse.llm.queries import WORD_VOCAB, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 stay; a null or empty text has no sentence and stays.

    The score goes along with the row, so rows that repeat an id, and those without one, are judged apart, each by its whole text; ties with the threshold go. An empty
    table gives none; further columns, whatever their names, stay.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the least id, one without an id only where none has one; of rows equal in id and text one.

    Null and empty texts are copies of one another. Whole texts of any length are compared; an empty table gives none; further columns, whatever their names, stay.
    """
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go; null, empty and other texts without words stay.

    Rows of one id, or without one, are matched by text too, whole texts of any length; an empty table gives none, an empty benchmark removes none;
    further columns, whatever their names, stay.
    """
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash").distinct()
    rows = rows_with(docs, own_id=F.col("doc_id").cast("long"), own_hash=F.xxhash64(text_of()))
    return rows.join(found, F.expr("own_id <=> doc_id and own_hash = text_hash"), "left_anti").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. No row goes; null texts stay null, empty ones empty.

    Rows that repeat an id, or have none, are redacted by their own whole texts; an empty table gives none; further columns, whatever their names, stay.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is one piece, its end id.

    Every row has pieces of its own, one that repeats an id or has none too; a text of any length is cut into as many as it needs. An empty table gives none; further columns
    are not part of the pieces.
    """
    return packing.pack(docs, vocabulary(WORD_VOCAB))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Scores, classes and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next, after which its predecessor's table goes."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(f"stage-{k}", stage(spark, docs, sf_dir))
        scratch.drop(f"stage-{k - 1}")
    return docs
