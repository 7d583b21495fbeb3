"""Token files compressed by a Re-Pair grammar per shard.

A file row is a shard: consecutive documents in ascending id order. Its payload is
``RPG1``, then as little-endian unsigned 32-bit numbers the base (ids below it are terminals), the
number of rules and of symbols, then the rules' left and right symbols (unsigned 16-bit), their expansion lengths
(unsigned 32-bit) and the symbols of all documents (unsigned 16-bit). Rules never cross a document's end. The
row also holds each document's id and token count, the writing partition and the tokens before it
there, so that a token range is found and decoded without the rest of the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm.common import documents_of, new_path
from gatehouse.llm.tokens import encoder

MAGIC = b"RPG1"
LIMIT = 1 << 16
FILE = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
FILE_DDL = "part int, before long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(12)


class _Symbols:
    """A shard's symbols while pairs are replaced.

    ``live`` marks where a pair begins that may still be frequent. A pair's count never grows once both of its symbols
    exist, so one counted below ``least`` is never looked at again, and a round costs what the last one changed.
    """

    def __init__(self, ids: np.ndarray, doc_tokens: np.ndarray) -> None:
        self.seq = ids.astype(np.uint16)
        self.last = np.zeros(len(ids), bool)
        self.last[np.cumsum(doc_tokens) - 1] = True
        self.live = ~self.last

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pairs seen ``least`` times as 32-bit codes, ascending; their counts; places of live pairs; the codes there)."""
        at = np.flatnonzero(self.live)
        code = (self.seq[at].astype(np.uint32) << np.uint32(16)) | self.seq[at + 1]
        ordered = np.sort(code)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(ordered)))
        pairs, count = ordered[first[count >= least]], count[count >= least]
        sieve = np.zeros(1 << 20, bool)  # all frequent pairs pass, and few others
        sieve[_slot(pairs)] = True
        maybe = sieve[_slot(code)]
        at, code = at[maybe], code[maybe]
        self.live[:] = False
        self.live[at] = True
        return pairs, count, at, code

    def replace(self, base: int, room: int, least: int) -> np.ndarray:
        """One Re-Pair step on at most ``room`` pairs, the most frequent; those that became rules. A rule replaces ``least`` pairs or is left out."""
        rules, count, pos, code = self.frequent(least)
        if not len(rules):
            return rules
        if len(rules) > room:
            chosen = np.sort(np.argsort(-count, kind="stable")[:room])
            rules, count = rules[chosen], count[chosen]
        number = np.full(1 << 20, -1, np.int32)
        number[_slot(rules)] = np.arange(len(rules), dtype=np.int32)
        alone = number[_slot(rules)] == np.arange(len(rules))  # of pairs that share a slot the last one; the others' turn comes in the next step
        rule = number[_slot(code)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[rules[rule[hit]] == code[hit]]
        pos, rule = pos[hit], (np.cumsum(alone) - 1)[rule[hit]]
        rules, count = rules[alone], count[alone]
        # of overlapping pairs the more frequent one goes first, and of what it leaves every second one
        weight = count[rule]
        beside = np.diff(pos) == 1
        wins = np.append(True, ~beside | (weight[1:] > weight[:-1])) & np.append(~beside | (weight[:-1] >= weight[1:]), True)
        blocked = wins | np.append(False, wins[:-1] & beside) | np.append(wins[1:] & beside, False)
        rest = np.flatnonzero(~blocked)
        begins = np.append(True, np.diff(pos[rest]) != 1)
        run_start = np.maximum.accumulate(np.where(begins, np.arange(len(rest)), 0)) if len(rest) else rest
        wins[rest[(np.arange(len(rest)) - run_start) % 2 == 0]] = True
        pos, rule = pos[wins], rule[wins]
        pays = np.bincount(rule, minlength=len(rules)) >= least  # pairs that overlap others are replaced less often than counted
        pos, rule, rules = pos[pays[rule]], (np.cumsum(pays) - 1)[rule[pays[rule]]], rules[pays]
        if not len(rules):
            return rules
        self.seq[pos] = base + rule
        self.last[pos] = self.last[pos + 1]
        keep = np.ones(len(self.seq), bool)
        keep[pos + 1] = False
        self.seq, self.last, self.live = self.seq[keep], self.last[keep], self.live[keep]
        own = pos - np.arange(len(pos))  # each pair before took one place
        self.live[own] = ~self.last[own]
        before = own[own > 0] - 1
        self.live[before] = ~self.last[before]
        return rules


def compress(ids: np.ndarray, doc_tokens: np.ndarray, base: int, rounds: int | None = None, batch: int = 2048, least: int = 5) -> bytes:
    """Payload of one shard. Ids must be below ``base``, and ``base`` at most 65536.

    Goes on (unless ``rounds`` are given) until the symbols are used up or no pair pays: a rule takes 8 bytes, a pair replaced saves 2.
    """
    if base > LIMIT:
        raise ValueError(f"{base} ids don't fit in 16 bits")
    symbols = _Symbols(ids, doc_tokens)
    left, right = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]
    length = np.ones(LIMIT, np.uint32)
    n = base
    done = 0
    while n < LIMIT and done != rounds:
        rules = symbols.replace(n, min(batch, LIMIT - n), least)
        if not len(rules):
            if batch == 1:
                break
            batch //= 2  # fewer pairs overlap each other less
            continue
        done += 1
        left.append((rules >> np.uint32(16)).astype(np.uint16))
        right.append((rules & np.uint32(0xFFFF)).astype(np.uint16))
        length[n : n + len(rules)] = length[left[-1]] + length[right[-1]]
        n += len(rules)
    lefts, rights = np.concatenate(left), np.concatenate(right)
    return MAGIC + np.array([base, n - base, len(symbols.seq)], "<u4").tobytes() + lefts.astype("<u2").tobytes() + rights.astype("<u2").tobytes() + length[base:n].astype("<u4").tobytes() + symbols.seq.astype("<u2").tobytes()


def _gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The expansions of ``seq`` end to end."""
    size = length[seq]
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(begin[seq] - (ends - size), size)]


class Shard:
    """A decoded payload's grammar; ``read(begin, end)`` expands only the symbols that cover the range."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.base, n, size = np.frombuffer(payload, "<u4", 3, 4).tolist()
        at = 16
        self.left = np.frombuffer(payload, "<u2", n, at)
        self.right = np.frombuffer(payload, "<u2", n, at + 2 * n)
        self.length = np.append(np.ones(self.base, np.int64), np.frombuffer(payload, "<u4", n, at + 4 * n))
        self.symbols = np.frombuffer(payload, "<u2", size, at + 8 * n)
        self.border = np.append(0, np.cumsum(self.length[self.symbols]))
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _texts(self) -> tuple[np.ndarray, np.ndarray]:
        """(all symbols' expansions end to end, where each begins), made level by level from the rules' parts."""
        if self._flat is None:
            begin = np.append(np.arange(self.base), self.base + np.cumsum(np.append(0, self.length[self.base :]))[:-1])
            flat = np.zeros(int(self.base + self.length[self.base :].sum()), np.uint32)
            flat[: self.base] = np.arange(self.base)
            ready, todo = self.base, len(self.left)
            while ready < self.base + todo:  # rules whose parts are all made before
                rest = slice(ready - self.base, None)
                late = np.flatnonzero(np.maximum(self.left[rest], self.right[rest]) >= ready)
                upto = ready + int(late[0]) if len(late) else self.base + todo
                own = np.arange(ready, upto)
                parts = np.column_stack([self.left[own - self.base], self.right[own - self.base]]).ravel()
                made = _gathered(flat, begin, self.length, parts)
                flat[begin[ready] : begin[ready] + len(made)] = made
                ready = upto
            self._flat = flat, begin
        return self._flat

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        if len(seq) > len(self.left):  # worth the whole table
            flat, begin = self._texts()
            return _gathered(flat, begin, self.length, seq)
        seq = seq.astype(np.uint32)
        while len(rule := np.flatnonzero(seq >= self.base)):
            width = np.ones(len(seq), np.int64)
            width[rule] = 2
            begin = np.cumsum(width) - width
            out = np.repeat(seq, width)
            out[begin[rule]] = self.left[seq[rule] - self.base]
            out[begin[rule] + 1] = self.right[seq[rule] - self.base]
            seq = out
        return seq

    def read(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Token ids begin..end-1 of the shard."""
        end = int(self.border[-1]) if end is None else min(end, int(self.border[-1]))
        if begin >= end:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.border, begin, "right")) - 1
        b = int(np.searchsorted(self.border, end, "left"))
        skip = begin - int(self.border[a])
        return self._expand(self.symbols[a:b])[skip : skip + end - begin]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, vocab_size: int, end_id: int = 0, shard_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document and write the token file at ``path``, shards in ascending document id order.

    Spark sorts by id over range partitions; a task streams its range and closes a shard at
    ``shard_tokens`` tokens, so no task holds more than a shard and one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], "<u4").tobytes()
        part, before, held, ids, counts = TaskContext.get().partitionId(), 0, 0, [], []
        raws: list[bytes] = []

        def shard() -> pa.RecordBatch:
            payload = compress(np.frombuffer(b"".join(raws), "<u4"), np.array(counts), vocab_size)
            return pa.RecordBatch.from_pylist([{"part": part, "before": before, "doc_ids": ids, "doc_tokens": counts, "payload": payload}], FILE)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin in range(0, len(texts), 256):
                for doc_id, raw in zip(doc_ids[begin : begin + 256], encode(texts[begin : begin + 256]), strict=True):
                    raws.append(raw + end)
                    ids.append(doc_id)
                    counts.append(len(raw) // 4 + 1)
                    held += counts[-1]
                    if held >= shard_tokens:
                        yield shard()
                        before, held, ids, counts, raws = before + held, 0, [], [], []
        if ids:
            yield shard()

    ordered = documents_of(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_DDL).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token file: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32.

    The starts of the writing partitions come from their totals, one number per partition of the writer.
    """
    shards = spark.read.schema(FILE_DDL).parquet(path)
    totals = shards.groupBy("part").agg(F.sum(F.expr("aggregate(doc_tokens, 0L, (a, x) -> a + x)")).alias("n")).orderBy("part").collect()
    base = dict(zip((r.part for r in totals), np.append(0, np.cumsum([r.n for r in totals])).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Shard(row["payload"]).read().astype("<u4")
                counts = np.array(row["doc_tokens"], np.int64)
                end = np.cumsum(counts)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((end - counts).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["part"]] + row["before"] + end - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, vocab_size: int, end_id: int = 0, path: str | None = None, shard_tokens: int = 1_000_000) -> DataFrame:
    """Write the documents' token file (in the shared folder unless a path is given) and read it back.

    Null and empty texts hold the end id alone; null ids come first; rows that share an id stay separate,
    ordered by text; an empty table gives no rows. A text of more than ``shard_tokens`` tokens stays whole, in a shard that is closed behind it;
    further columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, vocab_size, end_id, shard_tokens)
    return read_tokens(spark, path)
