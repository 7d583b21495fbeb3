"""Byte-level BPE by a rank file: ids of whole texts, and texts of ids.

Bytes stand as Latin-1 characters in an Aho-Corasick automaton of all tokens, which gives the longest token from every place
of a pre-token in one pass. A pre-token is walked from its left: the longest token that can follow the last one is taken, then
shorter ones that begin alike; where none can follow, the last token is taken back and the place is marked, so that no place is tried
twice from the same end. Whether a token can follow another is decided by their halves alone (merges that could have crossed their border
before either was whole) and memoised, so the walk is linear in the bytes, and its one result is what merging by rank gives.

A token that merges never reach is only given for a pre-token equal to it, as rank-based encoders do.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import documents_of
from gatehouse.llm.textvec import text_blocks
from gatehouse.llm.tokens import Encoder, Pieces

#: Pairs of neighbours that a worker remembers, and pre-tokens within one run of odd texts; beyond them it starts anew.
MAX_PAIRS, MAX_PRE_TOKENS = 400_000, 100_000

#: Letters and numbers that Unicode assigned after version 16 (fixed values): to rank-based encoders they are neither yet.
NEWER = regex.compile(
    "["
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
    "]"
)
_NEITHER = "\u2603"


class Merges:
    """A rank file's tokens: ``token[id]`` bytes, and for each token that merges reach its two halves."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank = ranks
        self.token: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            self.token[i] = raw
        n = len(self.token)
        self.left, self.right = [-1] * n, [-1] * n
        self.made: dict[int, int] = {}  # by left * 2**32 + right
        reached = [False] * n
        for i, raw in enumerate(self.token):
            if len(raw) == 1:
                reached[i] = True
        for i, raw in enumerate(self.token):
            for cut in range(len(raw) - 1, 0, -1):
                a, b = ranks.get(raw[:cut], n), ranks.get(raw[cut:], n)
                if a < n and b < n and self._before(a, i) and self._before(b, i) and reached[a] and reached[b] and self.neighbours(a, b):
                    self.left[i], self.right[i], self.made[a << 32 | b] = a, b, i
                    reached[i] = True
                    break
        self.shorter = [next((j for cut in range(len(raw) - 1, 0, -1) if (j := ranks.get(raw[:cut], -1)) >= 0 and reached[j]), -1) for raw in self.token]
        self.size = [len(raw) for raw in self.token]
        self.automaton = ahocorasick.Automaton()
        for i, raw in enumerate(self.token):
            if reached[i]:
                self.automaton.add_word(raw.decode("latin-1"), i)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, "rb") as f:
            return cls({base64.b64decode(raw): int(rank) for raw, rank in map(bytes.split, f)})

    def _before(self, i: int, j: int) -> bool:
        """Whether token i is there before merge j: single bytes always are."""
        return len(self.token[i]) == 1 or i < j

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, stay as they are under the merges known.

        From their border outwards both are taken apart, the later half first. Two parts that stood at the border at one time
        would have merged if their merge ranks below the merges that ended them; of equal ranks the left place goes first.
        """
        ends_a = ends_b = len(self.token)
        while True:
            crossing = self.made.get(a << 32 | b)
            if crossing is not None and crossing < ends_a and crossing <= ends_b:
                return False
            born_a, born_b = (a if self.left[a] >= 0 else -1), (b if self.left[b] >= 0 else -1)
            if born_a > born_b:
                ends_a, a = a, self.right[a]
            elif born_b >= 0:
                ends_b, b = b, self.left[b]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        fits = self.known.get(pair)
        if fits is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            fits = self.known[pair] = self.neighbours(a, b)
        return fits

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter = len(piece), self.size, self.shorter
        longest = [-1] * (n + 1)
        for last, token in self.automaton.iter(piece.decode("latin-1")):  # by end, so the longest from a place comes last
            longest[last + 1 - size[token]] = token
        out: list[int] = []
        at, dead = 0, bytearray(n + 1)
        token = longest[0]
        while at < n:
            while token >= 0 and (dead[at + size[token]] or (out and not self._fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


class RankEncoder(Encoder):
    """Texts in blocks, as the class above has it: a space-delimited piece is encoded when it is new, each of its pre-tokens by ``Merges``."""

    def __init__(self, path: str, pattern: str) -> None:
        self.merges, self.split = Merges.from_file(path), regex.compile(pattern).findall
        self.keeps_space, self.pieces = True, Pieces()

    def _ids(self, text: str, seen: dict[str, bytes]) -> bytes:
        out = []
        pieces = self.split(text)
        if not text.isascii() and NEWER.search(text):
            ends = np.cumsum([len(x) for x in self.split(NEWER.sub(_NEITHER, text))]).tolist()
            pieces = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for piece in pieces:
            ids = seen.get(piece)
            if ids is None:
                if len(seen) >= MAX_PRE_TOKENS:
                    seen.clear()
                ids = seen[piece] = np.array(self.merges.encode(piece.encode()), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def _by_library(self, texts: Sequence[str]) -> list[bytes]:
        seen: dict[str, bytes] = {}
        return [self._ids(t, seen) for t in texts]

    _learn = _by_library


_encoders: dict[tuple[str, str], RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """The worker's encoder for a rank file, built once."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = RankEncoder(path, pattern)
    return _encoders[path, pattern]


def _token_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    known = encoder(path, pattern)
    for batch in batches:
        for a, b, texts in text_blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(known.encode(texts), pa.binary())], ["doc_id", "ids"])


def _content_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    known = encoder(path, pattern).merges
    for batch in batches:
        out = [known.decode(np.frombuffer(raw.as_buffer(), "<u4").tolist()) if raw.is_valid else b"" for raw in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "content"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (unsigned 32-bit, little-endian) of every row's whole text; no special token is ever given.

    Null and empty texts have no ids; rows that repeat an id or a text, and a null id, are rows of their own. Texts of any length are read whole, block by
    block. An empty table gives none; further columns, whatever their names, are ignored.
    """
    return documents_of(docs, id_col, text_col).mapInArrow(lambda batches: _token_batches(batches, path, pattern), "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, content`` of ``tokens(doc_id, ids)``: the ids' bytes. No ids, or null, give empty bytes; an id that the file lacks is an error."""
    return tokens.select("doc_id", "ids").mapInArrow(lambda batches: _content_batches(batches, path, pattern), "doc_id long, ids binary, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` by one worker a task, which holds one table of tokens and hands ids on without leaving it."""
    run = lambda batches: _content_batches(_token_batches(batches, path, pattern), path, pattern)
    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, content binary")


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``decode``'s rows."""
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("content", 256).alias("decoded_sha256"))
