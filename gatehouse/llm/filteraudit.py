"""Interaction of document filters under every order of application.

A document's failures are a mask of bits, so a part's documents come down to counts of (part, mask) cells before anything is
compared. Cells are unpivoted against the steps of all orders; a running bit-or over a cell's steps gives the filters applied before,
which tell a removal from a redundant failure; conditional sums give each step's counts, and totals over a part's steps of one filter what
that filter removes over all orders.

A text equal to one of a smaller id fails too: the least id of each text is found by partial aggregation, and rows that hold it by a join on text
and id together, so a text that a third of all rows share is nobody's hot key.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch, text_of

WORD_GAP = r"[\x20\x09-\x0D]+"


def content_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by a document's own text: too few words, too few distinct ones, too many capitals, marks."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    size = lambda c: c.cast("long")
    return {
        "A": F.size(words) < 200,
        "B": 100 * size(F.size(F.array_distinct(words))) < 50 * size(F.size(words)),
        "C": 100 * size(F.regexp_count(text, F.lit("[A-Z]"))) > 3 * size(F.length(text)),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, filters: Mapping[str, Column], repeated: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask`` of every row: bit k for the k-th of ``filters`` (in name order with ``repeated``, the condition that a smaller id has the same text).

    ``filters`` are over a column ``text`` without nulls. A row without an id has no smaller one, nor is it smaller than any.
    """
    bit = {name: 1 << k for k, name in enumerate(sorted([*filters, repeated]))}
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    mask = sum((F.when(c, bit[k]).otherwise(0) for k, c in filters.items()), F.lit(0))
    rows = scratch.put("masks", own.select("doc_id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), mask.cast("int").alias("mask")))
    first = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), bit[repeated]).otherwise(0)
    return rows.join(first, ["key", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + late).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each cell, and those among them labelled quality 1 and toxic 1. An id with several labels has each that one of them gives."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return masks.join(judged, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def order_metrics(counted: DataFrame, names: str) -> DataFrame:
    """A row per part, order of ``names`` and step, of ``counted(part, mask, n, good, toxic)``; a part's cells are at most 2 to the number of filters."""
    steps = F.array(*[F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(k).alias("step"), F.lit(x).alias("filter"), F.lit(1 << names.index(x)).alias("bit")) for o in permutations(names) for k, x in enumerate(o, 1)])
    long = counted.select("part", "mask", "n", "good", "toxic", F.explode(steps).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("earlier", F.coalesce(F.expr("bit_or(mask & bit)").over(before), F.lit(0)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("earlier") != 0
    count = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0)).alias(c)
    per_step = seen.groupBy("part", "filter_order", "step", "filter").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return per_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for all orders of the filters A to E.

    A null text counts as empty and a null part as the part ''. A row without an id is no repetition and has no label; rows that repeat an id and a text
    don't repeat each other (no id is smaller), rows that repeat an id alone are judged by their own texts. Whole texts of any length are read. An empty
    table has no parts, hence no rows; further columns, whatever their names, are ignored.
    """
    filters = content_filters(F.col("text"))
    masks = failure_masks(docs, filters, "E", Scratch(docs.sparkSession, "audit"), id_col, text_col, part_col)
    return order_metrics(cells(masks, labels), "ABCDE")
