"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded.

White space always ends a pre-token in both vocabularies, so a text's ids are the ids of its
white-space-delimited pieces in order, and punctuation after a word of letters is a piece of its own. Pieces repeat far more than texts do: the
library encodes each new piece once. Pieces of at most 15 bytes are cut, looked up and put together by numpy, a block of
texts at a time: their own bytes and their length are the key of an open hash table, so a
look finds exactly that piece. Longer pieces and texts with rare white space go through a dictionary. New purely
alphabetic pieces go to the library many at a time as one spaced text, which costs less per piece.
Texts holding a special token's string, or a control character on which regular-expression
dialects disagree, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from gatehouse.llm.textvec import U64, mix

#: Slots that a worker's table begins with (it doubles before it is half full), and the pieces after which it starts anew.
SLOTS, MAX_PIECES = 1 << 16, 1_200_000
#: Bytes of pieces in the table; longer ones of at most so many are kept in a dictionary of bounded size, the rest not at all.
SHORT, MAX_LENGTH, MAX_LONG = 15, 40, 200_000
BLOCK = 1 << 19
_SPACE_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
_JOIN = 256
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_END = 255  # no byte of UTF-8
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_IS_SPACE, _IS_LETTER, _IS_TAIL, _MAY_BE_SPACE = (np.isin(np.arange(256), x) for x in ([32, 10], [*range(65, 91), *range(97, 123)], [ord(c) for c in _TAIL], [9, 11, 12, 13, 0xC2, 0xE1, 0xE2, 0xE3]))
_RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Pieces:
    """Ids of pieces: ``value`` (place in ``ids`` and count) by the 15 bytes and length of a piece, or by a longer piece itself."""

    def __init__(self) -> None:
        self.low, self.high, self.value = np.zeros(SLOTS, U64), np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int64)
        self.ids, self.fill, self.count = np.zeros(1 << 20, np.uint32), 0, 0
        self.long: dict[bytes, int] = {}

    def add(self, raws: Sequence[bytes]) -> np.ndarray:
        """Values of newly stored ids."""
        size = np.array([len(r) // 4 for r in raws], np.int64)
        total = int(size.sum())
        while self.fill + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.fill : self.fill + total] = np.frombuffer(b"".join(raws), "<u4")
        at = self.fill + np.cumsum(size) - size
        self.fill += total
        return at << 32 | size

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ (high * U64(0x9E3779B97F4A7C15))) & U64(len(self.value) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is new."""
        out, slot, todo = np.full(len(low), -1), self._slot(low, high), np.arange(len(low))
        while len(todo):
            at = slot[todo]
            there = self.high[at]
            hit = (there == high[todo]) & (self.low[at] == low[todo])
            out[todo[hit]] = self.value[at[hit]]
            todo = todo[~hit & (there != 0)]
            slot[todo] = (slot[todo] + 1) & (len(self.value) - 1)
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """New keys, each once."""
        self.count += len(low)
        if 2 * self.count > (slots := len(self.value)):
            while 2 * self.count > slots:
                slots *= 2
            there = np.flatnonzero(self.high)
            low, high, value = (np.concatenate([old[there], new]) for old, new in ((self.low, low), (self.high, high), (self.value, value)))
            self.low, self.high, self.value = np.zeros(slots, U64), np.zeros(slots, U64), np.zeros(slots, np.int64)
        slot, todo = self._slot(low, high), np.arange(len(low))
        while len(todo):
            free = todo[self.high[slot[todo]] == 0]
            first = free[np.unique(slot[free], return_index=True)[1]]  # of keys that want one slot the first
            at = slot[first]
            self.low[at], self.high[at], self.value[at] = low[first], high[first], value[first]
            taken = self.high[slot[todo]] != high[todo]
            todo = todo[taken | (self.low[slot[todo]] != low[todo])]
            slot[todo] = (slot[todo] + 1) & (len(self.value) - 1)


class Encoder:
    """``encode(texts)`` gives each text's ids as bytes (unsigned 32-bit, little-endian)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = self.tokenizer.normalizer is None
        self.pieces = Pieces()
        vocab = self.tokenizer.get_vocab()
        self.newline = vocab.get("Ċ", -1)
        # the token that begins a spaced word, or that ends a word
        self.border = np.zeros(max(vocab.values()) + 1, bool)
        self.border[[i for t, i in vocab.items() if (t.startswith("Ġ") if self.keeps_space else t.endswith("</w>"))]] = True

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], glue: str, into: dict[str, bytes]) -> None:
        """Learn alphabetic pieces from runs of them; a run that doesn't split into as many goes one by one."""
        runs = [words[i : i + _JOIN] for i in range(0, len(words), _JOIN)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([glue.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            if glue == "\n":  # its own id stands between two words
                at = np.flatnonzero(ids == self.newline)
                begin, end = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
            else:
                at = np.flatnonzero(self.border[ids])
                begin = at.tolist() if self.keeps_space else [0, *(at[:-1] + 1).tolist()]
                end = [*begin[1:], len(ids)]
            if len(begin) == len(run):
                raw = ids.tobytes()
                into.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(run, begin, end, strict=True))
            else:
                into.update(zip(run, self._by_library(run), strict=True))

    def _learn(self, pieces: Sequence[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        out: dict[str, bytes] = {}
        spaced, plain, alone, tailed = set(), set(), set(), []
        for p in pieces:
            base = p.rstrip(_TAIL)
            if not (base[1:] if base[:1] == " " else base).isalpha():
                alone.add(p)
                continue
            if base != p:
                tailed.append((p, base))
                alone.add(p[len(base) :])
            (spaced if base[0] == " " else plain).add(base)
        self._joined(list(spaced), "", out)
        self._joined(list(plain), "\n" if self.keeps_space else " ", out)
        alone = list(alone)
        out.update(zip(alone, self._by_library(alone), strict=True))
        for p, base in tailed:
            out[p] = out[base] + out[p[len(base) :]]
        return [out[p] for p in pieces]

    def _by_pieces(self, text: str) -> bytes:
        """A text with rare white space."""
        pieces = (_SPACE_PIECES.findall if self.keeps_space else str.split)(text)
        some = list(set(pieces))
        ids = dict(zip(some, self._learn(some), strict=True))
        return b"".join([ids[p] for p in pieces])

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin and end of every piece, pieces up to each text's end) of texts that each end with a byte of their own."""
        is_end = data == _END
        in_word = ~(_IS_SPACE[data] | is_end)
        start = np.flatnonzero((in_word & ~np.append(False, in_word[:-1])) | is_end)
        end = np.flatnonzero((in_word & ~np.append(in_word[1:], False)) | is_end) + 1
        closes = is_end[start]
        # punctuation after ASCII letters alone
        place = np.arange(len(data))
        base_end = np.maximum.accumulate(np.where(_IS_TAIL[data], -1, place))[end - 1] + 1
        letters = np.append(0, np.cumsum(_IS_LETTER[data]))
        base_end = np.where((base_end > start) & (letters[np.maximum(base_end, start)] - letters[start] == base_end - start), base_end, end)
        end, base_end = np.where(closes, start, end), np.where(closes, start, base_end)
        begins, ends = [start, base_end], [base_end, end]
        if self.keeps_space:
            before = data[start - 1]  # of the first text the last byte, which ends a text
            upto = np.append(0, (end + closes)[:-1])
            attached, apart = (before == 32) & ~closes, (before == 10) & ~closes
            blank = np.where(attached | apart, start - 1, start)
            begins = [upto, blank, np.where(attached, start - 1, start), base_end]
            ends = [blank, np.where(apart, start, blank), base_end, end]
        a, b = np.column_stack(begins).ravel(), np.column_stack(ends).ravel()
        some = b > a
        return a[some], b[some], np.cumsum(some)[np.flatnonzero(closes) * len(begins) + len(begins) - 1]

    def _block(self, raws: list[bytes]) -> list[bytes]:
        """Ids of texts without rare white space."""
        if self.pieces.count > MAX_PIECES or len(self.pieces.long) > MAX_LONG:
            self.pieces = Pieces()
        known, end = self.pieces, bytes([_END])
        whole = end.join([*raws, bytes(16)])
        data = np.frombuffer(whole, np.uint8)
        a, b, upto = self._cut(data[:-16])
        size = b - a
        eight = np.ndarray(len(data) - 7, "<u8", whole, 0, (1,))  # the eight bytes from each place on
        value = np.full(len(a), -1)
        short = np.flatnonzero(size <= SHORT)
        low = eight[a[short]] & _LOW_BYTES[np.minimum(size[short], 8)]
        high = eight[np.minimum(a[short] + 8, len(eight) - 1)] & _LOW_BYTES[np.clip(size[short] - 8, 0, 7)] | size[short].astype(U64) << U64(56)
        found = known.find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            own = order[first]
            values = known.add(self._learn([whole[i:j].decode() for i, j in zip(a[short[own]].tolist(), b[short[own]].tolist(), strict=True)]))
            known.insert(low[own], high[own], values)
            found[order] = values[np.cumsum(first) - 1]
        value[short] = found
        fill = known.fill
        rest = np.flatnonzero(size > SHORT).tolist()
        names = [whole[a[i] : b[i]] for i in rest]
        unseen = list({x for x in names if x not in known.long})
        own = dict(zip(unseen, known.add(self._learn([x.decode() for x in unseen])).tolist(), strict=True)) if unseen else {}
        value[rest] = [own[x] if x in own else known.long[x] for x in names]
        known.long.update((x, v) for x, v in own.items() if len(x) <= MAX_LENGTH)
        count, begin = value & 0xFFFFFFFF, value >> 32
        stop = np.append(0, np.cumsum(count))
        ids = known.ids[np.arange(stop[-1]) + np.repeat(begin - stop[:-1], count)].astype("<u4").tobytes()
        if not any(len(x) <= MAX_LENGTH for x in own):
            known.fill = fill  # nothing of these is kept
        border = (4 * stop[np.append(0, upto)]).tolist()
        return [ids[i:j] for i, j in zip(border, border[1:], strict=False)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if any(o in t for o in _ODD)]
        for i, ids in zip(whole, self._by_library([texts[i] for i in whole]) if whole else (), strict=True):
            out[i] = ids
        odd, held, raws, size = set(whole), [], [], 0
        for i, t in enumerate(texts):
            if i not in odd:
                raw = t.encode()
                if _MAY_BE_SPACE[np.frombuffer(raw, np.uint8)].any() and _RARE_SPACE.search(t):
                    out[i] = self._by_pieces(t)
                    continue
                held.append(i)
                raws.append(raw)
                size += len(raw)
            if size >= BLOCK or i == len(texts) - 1:
                for k, ids in zip(held, self._block(raws) if raws else (), strict=True):
                    out[k] = ids
                held, raws, size = [], [], 0
        if raws:
            for k, ids in zip(held, self._block(raws), strict=True):
                out[k] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]
