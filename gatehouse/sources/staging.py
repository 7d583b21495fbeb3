"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Local Spark alone may go without it: it gets one for its process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gatehouse-staging-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staging_folder(spark: SparkSession) -> str:
    """``staging_root`` as a path of the operating system, for programs that know no other file systems."""
    root = staging_root(spark)
    scheme, colon, rest = root.partition(":")
    if colon and "/" not in scheme:
        if scheme != "file":
            raise ValueError("spark.checkpoint.dir must be a mounted folder here")
        return "/" + rest.lstrip("/")
    return root


def staged(table: DataFrame, label: str) -> DataFrame:
    """``table`` written once and read back: branches that follow don't compute it again, and a lost executor costs no more than a read.

    What is returned reads the files, so they stay; for small tables that many branches read.
    """
    path = f"{staging_root(table.sparkSession)}/{label}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
