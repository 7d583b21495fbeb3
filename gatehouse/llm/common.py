"""Shared helpers: staged tables in the cluster's checkpoint folder, and column selection."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Local Spark alone may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gatehouse-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one run in the shared folder.

    ``put`` writes a table as Parquet and reads it back: this cuts the lineage at a replicated table, so a lost
    executor costs only the current stage, and later joins are planned from the table's real size. ``drop``
    deletes tables that nothing reads any more; what the returned DataFrame reads must stay.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, new_path(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for good."""
    return Scratch(df.sparkSession, label).put("table", df)


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text string`` with null texts as empty; any other column is dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def rows_with(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside further columns, so that no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def id_remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; -1 for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(col.cast("string")), F.lit(modulus)), F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
