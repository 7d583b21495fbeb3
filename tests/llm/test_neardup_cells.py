"""Who meets whom within a band."""

from pyspark.sql import functions as F

from gatehouse.llm import neardup

from .conftest import docs_of, prose
from .test_neardup import check
from .test_neardup_recall import edited


def meetings(open_):
    """(a, b) of every pair of members that a cell brings together, as close_pairs has it, before any bound."""
    cells = neardup.block_cells(open_).withColumn("other", F.explode("others")).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    meets = "x.band = y.band and x.low = y.low and x.high = y.high and x.node < y.node and (x.block <> y.block or x.low = x.high)"
    return cells.alias("x").join(cells.alias("y"), F.expr(meets)).select("x.band", F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.class").alias("ca"), F.col("y.class").alias("cb"))


def test_classes_meet_each_other_once_and_large_ones_never_themselves(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    sizes = {1: 100, 2: 40, 3: 8, 4: 5, 5: 1, 6: 9}
    members = [(0, 1000 * c + k, c) for c, n in sizes.items() for k in range(n)] + [(1, k, 7 + k % 2) for k in range(30)] + [(2, k, k) for k in range(20)]
    open_ = spark.createDataFrame(members, "band long, node long, class long").repartition(4)
    met = meetings(open_).collect()
    pairs = [(r.band, r.a, r.b) for r in met if r.ca != r.cb]
    want = {(b, min(x, y), max(x, y)) for b, x, c in members for b2, y, d in members if b == b2 and c < d}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    idle = [r for r in met if r.ca == r.cb]
    assert {r.ca for r in idle} <= {3, 4} and len(idle) <= 28 + 10  # only small classes share blocks


def test_classes_are_the_same_whatever_the_blocks(spark, monkeypatch):
    import random

    rng = random.Random(8)
    docs = []
    for g in range(6):
        text = prose(g, 120)
        docs += [(100 * g + k, edited(rng, text, rng.choice((0.005, 0.01, 0.03)))) for k in range(25)] + [(100 * g + 50, text)]
    for block in (3, 1024):
        monkeypatch.setattr(neardup, "BLOCK", block)
        check(neardup.classify(docs_of(spark, docs)), docs)
