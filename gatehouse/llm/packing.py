"""Bound-certified best-fit packing of token sequences.

Pieces of documents are dealt over partitions and packed there by best-fit decreasing. A lower bound
from dual feasible functions tells each partition whether its number of bins is provably least. A
partition whose count exceeds its bound (a gap) gives its loosest bins to the next round; a certified
one gives only the one bin that the sum of its lengths leaves open. The given bins are dealt over fewer
partitions, whose documents are packed anew; a result stands only where it needs fewer bins. Rounds
end when one partition held all that was given, or when a round gave nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch, documents_of
from gatehouse.llm.textvec import text_blocks
from gatehouse.llm.tokens import BLOCK, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", rid long, sequence_id long, offset long, given boolean"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(1), BLOCK):
                rows = []
                for doc_id, raw in zip(batch.column(0).slice(a, b - a).to_pylist(), encode(texts), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins that any packing needs, by two families of dual feasible functions (exact integers)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    total, n_from = count * size, np.append(np.cumsum(count[::-1])[::-1], 0)
    sum_to = np.append(0, np.cumsum(total))
    cut = np.arange(0, capacity // 2 + 1)
    # lengths above capacity - cut count as a whole bin, those below cut as nothing
    whole = n_from[capacity - cut + 1]
    between = sum_to[capacity - cut + 1] - sum_to[cut]
    best = int(np.max(whole + -(-between // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = int((count * np.where(exact, k * size, (scaled // capacity) * capacity)).sum())
        best = max(best, -(-value // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset in bin, number of bins); each length goes to the fullest bin that has room for it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, n_bins = 0, 0  # bit r of some: a bin with r free places is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some ^= 1 << free
        else:
            free, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - free
        free -= need
        if free:
            if not room[free]:
                some |= 1 << free
            room[free].append(b)
    return bins, offsets, n_bins


def _pack_partition(part: pa.Table, capacity: int, level: int, slots: int, slot: int, last: bool) -> pa.Table:
    """One partition's pieces packed anew, or as they are where that needs no fewer bins; only lengths and bins leave Arrow."""
    part = part.sort_by("rid")
    lengths = part["length"].to_numpy()
    bins, offsets, n_bins = best_fit_decreasing(lengths, capacity)
    if level:
        old, old_bins = np.unique(part["sequence_id"].to_numpy(), return_inverse=True)
    if not level or n_bins < len(old):
        sequence, offsets = pa.array((level << 56) + bins * slots + slot), pa.array(offsets)
    else:
        sequence, offsets = part["sequence_id"], part["offset"]
        bins, n_bins = old_bins, len(old)
    free = capacity - np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
    gap = n_bins - lower_bound(lengths, capacity)
    give = 0 if last else 1 if gap == 0 else max(8 * gap, n_bins // 8)
    loosest = np.argsort(-free, kind="stable")[:give]
    given = np.zeros(n_bins, bool)
    given[loosest[free[loosest] > 0]] = True
    facts = [part[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "rid")]
    return pa.table([*facts, sequence, offsets, pa.array(given[bins])], names=["doc_id", "piece", "start", "length", "ids_crc32", "rid", "sequence_id", "offset", "given"])


def _round(capacity: int, level: int, slots: int, last: bool) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        return _pack_partition(part, capacity, level, slots, key[0].as_py(), last)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, per_partition: int = 20_000, max_rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts hold the end id alone; a null id stays null; repeated rows are packed once
    each; an empty table gives no rows; further columns are ignored. The last round is the only one
    that one partition may hold alone, and it holds at most ``per_partition`` pieces unless ``max_rounds`` ended first.
    """
    pieces = tokenized_pieces(documents_of(docs, id_col, text_col), tokenizer_path, capacity, end_id)
    scratch = Scratch(docs.sparkSession, "packing")
    todo = scratch.put("pieces", pieces.withColumn("rid", F.monotonically_increasing_id()).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))
    done: list[DataFrame] = []
    rows = todo.count()
    for level in range(max_rounds):
        if not rows:
            break
        slots = max(1, math.ceil(rows / per_partition))
        last = level == max_rounds - 1 or slots == 1
        key = F.col("rid") if level == 0 else F.col("sequence_id")  # whole bins move, so that a partition can compare

        run = _round(capacity, level, slots, last)
        packed = scratch.put(f"round-{level}", todo.withColumn("slot", F.pmod(F.xxhash64(key, F.lit(level)), F.lit(slots)).cast("int")).groupBy("slot").applyInArrow(run, PACKED))
        done.append(packed.where("not given"))
        todo = packed.where("given").drop("given")
        rows = todo.count()
        if level == 0:
            scratch.drop("pieces")
    out = (done or [todo.limit(0)])[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
