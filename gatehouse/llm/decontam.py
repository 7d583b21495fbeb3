"""Benchmark decontamination by winnowing.

A text's 7-word grams are hashed and of every seven consecutive ones the least hash is kept, so any
13 shared consecutive words share the fingerprint kept for them. Test fingerprints go into a bit
filter whose size follows their number, up to 16 MB; a training text gives, for each kept fingerprint that passes it, the 13-word windows it was
kept for, and Spark joins these with the test windows by fingerprint and by two further hashes of all 13 words.
Items of fewer words are one window each, whose own hash is its fingerprint, looked up
at every place of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch
from gatehouse.llm.textvec import FEW_BYTES, U64, Words, grams, mix, text_blocks, words_of

#: Bits of the filter for each test fingerprint, and the most bits that it has.
BITS_EACH, MOST_BITS = 32, 1 << 27
WINDOW_COLS = ("fp", "start", "len", "h1", "h2")
TEST_DDL = "item_id long, fp long, len int, h1 long, h2 long"
DOC_DDL = "doc_id long, th long, n_words long, fp array<long>, start array<int>, len array<int>, h1 array<long>, h2 array<long>"


def _window_hash(hashes: np.ndarray, at: np.ndarray, length: int, salt: int) -> np.ndarray:
    out = np.full(len(at), salt, U64)
    for j in range(length):
        out = mix(out * U64(0xA24BAED4963EE407) + hashes[at + j])
    return out


def winnowed_windows(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, fingerprint) of every window of ``window`` words inside one text: the least hash (the last
    of equals) of the window's ``gram``-word grams."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = grams(words.hash, gram)
    least = g[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, g[j : j + n], out=least)
    inside = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    return inside, least[inside]


def _windows(words: Words, gram: int, window: int, short: list[int], bits: np.ndarray | None) -> dict[str, np.ndarray]:
    """All windows whose fingerprint passes the bit filter (all, if there is none)."""
    found = []
    for length in [window, *short]:
        if length == window:
            at, fp = winnowed_windows(words, gram, window)
        else:
            every = grams(words.hash, length, salt=length)
            at = np.flatnonzero(words.doc[: len(every)] == words.doc[length - 1 :]) if len(every) else np.zeros(0, np.int64)
            if bits is None:  # a test item of so many words, not any part of a longer one
                at = at[np.diff(words.first)[words.doc[at]] == length]
            fp = every[at]
        if bits is not None:
            slot = fp & U64(64 * len(bits) - 1)
            hit = (bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1
            at, fp = at[hit], fp[hit]
        found.append((at, fp, np.full(len(at), length, np.int32), _window_hash(words.hash, at, length, 1), _window_hash(words.hash, at, length, 2)))
    at, fp, length, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = words.doc[at]
    order = np.lexsort((at, doc))
    return {"doc": doc[order], "fp": fp.view(np.int64)[order], "start": (at - words.first[doc]).astype(np.int32)[order], "len": length[order], "h1": h1.view(np.int64)[order], "h2": h2.view(np.int64)[order]}


def test_windows(benchmark: DataFrame, gram: int, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            for a, b, texts in text_blocks(batch.column(1)):
                w = _windows(words_of(texts), gram, window, list(range(1, window)), None)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][w["doc"]].tolist(), pa.int64()), *(pa.array(w[c]) for c in ("fp", "len", "h1", "h2"))], ["item_id", "fp", "len", "h1", "h2"])

    rows = benchmark.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, TEST_DDL).distinct()


def fingerprint_filter(tests: DataFrame) -> np.ndarray:
    """Bit filter of the fingerprints as unsigned 64-bit words, a power of two of them. Spark sets the bits; the driver gets the words that have any."""
    n = tests.select("fp").distinct().count()
    size = 1 << 16
    while size < min(BITS_EACH * n, MOST_BITS):
        size *= 2
    # 2**k divides 2**64, so the remainders of signed and of unsigned numbers agree
    words = tests.select(F.expr(f"pmod(fp, {size}L)").alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(U64)


def contamination(docs: DataFrame, benchmark: DataFrame, gram: int = 7, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of each document inside any occurrence of a benchmark window.

    Returns doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated. Null and empty texts have no
    words and no hits; rows that repeat an id are judged by their own texts; null ids and null item ids are kept as
    ids like others (a null item id shows as ``null``); an empty benchmark hits nothing; further columns are ignored.
    Whole texts of any length are read, a block at a time; an empty table of documents gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    tests = scratch.put("tests", test_windows(benchmark, gram, window, item_id_col, item_text_col))
    bits = fingerprint_filter(tests)
    short = sorted(r[0] for r in tests.where(F.col("len") < window).select("len").distinct().collect())
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(2), FEW_BYTES):
                words = words_of(texts)
                w = _windows(words, gram, window, short, shared.value)
                border = pa.array(np.searchsorted(w["doc"], np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(border, pa.array(w[c])) for c in WINDOW_COLS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(words.first)), *lists], ["doc_id", "th", "n_words", *WINDOW_COLS])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = scratch.put("documents", docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, DOC_DDL))
    found = seen.where(F.size("fp") > 0).select("doc_id", "th", F.explode(F.arrays_zip(*WINDOW_COLS)).alias("w")).select("doc_id", "th", "w.*")
    found = scratch.put("hits", found.join(tests.drop("item_id").distinct(), ["fp", "len", "h1", "h2"], "left_semi").distinct())
    # words in the union of the windows, in order of their starts
    covered = F.expr("aggregate(array_sort(collect_set(struct(start, start + len as stop))), struct(0L as n, 0 as upto), (a, w) -> struct(a.n + greatest(0, w.stop - greatest(w.start, a.upto)) as n, greatest(a.upto, w.stop) as upto), a -> a.n)")
    hits = found.groupBy("doc_id", "th").agg(covered.alias("n_hit"))
    items = found.select("doc_id", "th", "fp", "len", "h1", "h2").distinct().join(tests, ["fp", "len", "h1", "h2"]).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).alias("item_ids"))
    per_text = hits.alias("a").join(items.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.th = b.th")).select("a.doc_id", "a.th", "n_hit", "item_ids")
    out = seen.select("doc_id", "th", "n_words").alias("s").join(per_text.alias("p"), F.expr("s.doc_id <=> p.doc_id and s.th = p.th"), "left")
    return out.select(
        "s.doc_id", F.col("s.th").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
