"""Bottom-k sketches of word shingles.

A fingerprint holds the k least of a text's distinct 48-bit shingle hashes, ascending, as
``bk<k>:`` and base64 of six bytes each. Sketches of parts merge by the k least of both; two sketches
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import documents_of
from gatehouse.llm.textvec import U64, blocks, shingles, words_of

HASH_BITS = 48


def sketches(texts: Sequence[str], k: int = 128, words: int = 5) -> list[np.ndarray]:
    """Ascending least k distinct shingle hashes of each text; fewer than k are all there are."""
    out = []
    for a, b in blocks(texts):
        value, doc = shingles(words_of(texts[a:b]), words)
        value >>= U64(64 - HASH_BITS)
        border = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
        for i, j in zip(border, border[1:], strict=False):
            own = value[i:j]
            if j - i > 8 * k:  # at least k distinct values are almost surely below this one
                few = own[own < U64(int((1 << HASH_BITS) * (4 * k / (j - i))))]
                few = np.unique(few)
                own = few if len(few) >= k else np.unique(own)
            else:
                own = np.unique(own)
            out.append(own[:k])
    return out


def to_string(sketch: np.ndarray, k: int = 128) -> str:
    raw = sketch.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return f"bk{k}:" + base64.b64encode(raw).decode()


def from_string(text: str) -> tuple[np.ndarray, int]:
    head, _, body = text.partition(":")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :6] = raw
    return full.view("<u8").ravel(), int(head[2:])


def merge(a: np.ndarray, b: np.ndarray, k: int = 128) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(sketch: np.ndarray, k: int = 128) -> float:
    return float(len(sketch)) if len(sketch) < k else (k - 1) * float(1 << HASH_BITS) / (float(sketch[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = 128) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    shared = both[1:][twice]
    union = len(both) - len(shared)
    if union <= k:
        return len(shared) / union
    first = np.append(True, ~twice)
    border = both[first][k - 1]
    return int(np.count_nonzero(shared <= border)) / k


def containment(a: np.ndarray, b: np.ndarray, k: int = 128) -> float:
    """Estimated share of a's distinct shingles that b has."""
    j, n_a, n_b = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return 1.0 if not n_a else min(1.0, j / (1 + j) * (n_a + n_b) / n_a)


def fingerprint(docs: DataFrame, k: int = 128, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated) of every whole text; null and empty texts have an empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sketches(batch.column(1).to_pylist(), k, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_string(s, k) for s in own]), pa.array([distinct_count(s, k) for s in own])], ["doc_id", "fingerprint", "n_shingles"])

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def with_next(docs: DataFrame, per_range: int = 2000, max_ranges: int = 20_000) -> DataFrame:
    """Rows ``range, doc_id, text, is_next`` in partitions sorted so that each document is followed by the next one.

    Ids are cut into ranges at existing ids, and a range's first row also closes the range before it; the
    least id closes the last range. The driver holds one number per range.
    """
    n, least, no_id = docs.agg(F.count("*"), F.min("doc_id"), F.count_if(F.isnull("doc_id"))).first()
    ranges = min(max_ranges, max(1, n // per_range))
    cuts: list[int] = []
    if ranges > 1 and least is not None:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0]))
    bounds, least = np.array(cuts, np.int64), None if no_id else least

    def places(ids: list[int | None]) -> list[list[tuple[int, bool]]]:
        known = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
        out = []
        for i, r in zip(ids, np.searchsorted(bounds, known, "right").tolist(), strict=True):
            own = [(r, False)]
            if i is not None and r and bounds[r - 1] == i:
                own.append((r - 1, True))
            if i == least:
                own.append((len(bounds), True))
            out.append(own)
        return out

    @F.pandas_udf("array<struct<range:int,is_next:boolean>>")
    def place(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([[{"range": r, "is_next": s} for r, s in own] for own in places([None if pd.isna(i) else int(i) for i in ids.tolist()])])

    # as text, since a nullable long would pass through a float
    spread = docs.withColumn("place", F.explode(place(F.col("doc_id")) if not no_id else place(F.col("doc_id").cast("string")))).select("place.range", "doc_id", "text", "place.is_next")
    return spread.repartition("range").sortWithinPartitions("range", "is_next", "doc_id", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, k: int = 128, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    The edited text is the document's first ceil(n/2) code points and then as many of the next document's
    first ones as were cut off (or all). The next document is that of the next id (null ids come first,
    equal ids in order of their texts, the last is followed by the first); a lone document follows itself.
    Null and empty texts have empty sketches; an empty table gives no rows. Whole texts of any length are read, one text and its
    successor at a time; further columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row and its sketch, until the next row is seen
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            own = sketches([r[2] for r in rows], k, words)
            pairs, out = [], {n: [] for n in ("doc_id", "n_chars", "sha", "fp", "edited", "near_next")}
            before = held
            for row, sketch in zip(rows, own, strict=True):
                if before and not before[0][3] and before[0][0] == row[0]:
                    pairs.append((before, (row, sketch)))
                before = (row, sketch)
            held = before
            if not pairs:
                continue
            for ((_, doc_id, text, _), sketch), (after, next_sketch) in pairs:
                cut = len(text) // 2
                edited = text[: len(text) - cut] + after[2][:cut]
                for name, value in (("doc_id", doc_id), ("n_chars", len(text)), ("sha", hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()), ("fp", sketch), ("edited", edited), ("near_next", resemblance(sketch, next_sketch, k))):
                    out[name].append(value)
            edits = sketches(out["edited"], k, words)
            near = [resemblance(a, b, k) for a, b in zip(out["fp"], edits, strict=True)]
            columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_chars"], pa.int64()), pa.array(out["sha"]), pa.array([to_string(s, k) for s in out["fp"]]), pa.array([to_string(s, k) for s in edits]), pa.array(near, pa.float64()), pa.array(out["near_next"], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(documents_of(docs, id_col, text_col)).mapInArrow(run, EDITED)
