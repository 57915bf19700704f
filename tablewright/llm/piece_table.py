"""Ids of many pieces of :mod:`.bpe` at once, remembered in numpy arrays.

A dict of strings and bytes takes about 170 bytes a piece, so that a worker's memory holds too few of them, and
each look-up is a step of Python. Here a piece of up to 16 bytes is its own key (two 64-bit words,
compared in full), its ids lie in a pool, and all pieces of about a megabyte of text are looked up together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

from .bpe import PieceEncoder

#: Pieces that a table remembers (about 55 MB when full), their longest bytes, and the bytes of text looked up together.
TABLE_PIECES, KEY_BYTES, SEGMENT = 1_000_000, 16, 1 << 20
#: Pieces in the dicts beside it: first ones of texts, long ones, letters before marks.
SIDE_PIECES = 30_000
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


class PieceTable:
    """Open addressing; a first word of zero is a free slot, as no piece is empty or holds a zero byte.

    Beyond ``limit`` pieces, those that were used again since the last time stay, half of the limit at most.
    """

    def __init__(self, make: Callable[[bytes], bytes], kind: str, limit: int = TABLE_PIECES):
        self.make, self.kind, self.limit = make, kind, limit
        bits = max(4, (2 * limit - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros((1 << bits, 2), np.uint64)
        self.at, self.sizes, self.used = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, bool)
        self.pool, self.held, self.n = np.empty(1 << 12, kind), 0, 0

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _MIX[0] ^ (high + _MIX[2]) * _MIX[1]
        return ((h ^ h >> np.uint64(32)) * _MIX[2] >> self.shift).astype(np.intp)

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, or the free one where its search ends; whether it is there."""
        slot = self._home(low, high)
        held = self.keys.take(slot, axis=0)
        there = (held[:, 0] == low) & (held[:, 1] == high)
        todo = np.flatnonzero(~there & (held[:, 0] != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            held = self.keys.take(slot[todo], axis=0)
            same = (held[:, 0] == low[todo]) & (held[:, 1] == high[todo])
            there[todo] = same
            todo = todo[~same & (held[:, 0] != 0)]
        return slot, there

    def _insert(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        """Different keys, none of them held; two that want one slot are told apart by which was written."""
        todo, slot = np.arange(len(low)), self._home(low, high)
        while len(todo):
            free = todo[self.keys[slot[todo], 0] == 0]
            self.keys[slot[free], 0], self.keys[slot[free], 1] = low[free], high[free]
            put = free[(self.keys[slot[free], 0] == low[free]) & (self.keys[slot[free], 1] == high[free])]
            self.at[slot[put]], self.sizes[slot[put]] = at[put], sizes[put]
            waits = np.ones(len(low), bool)
            waits[put] = False
            todo = todo[waits[todo]]
            slot[todo] = (slot[todo] + 1) & self.last
        self.n += len(low)

    def _gather(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places of the pool, one after another, and their number up to each place's end."""
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _append(self, ids: np.ndarray) -> None:
        """Ids behind those held; they stay there only if the caller raises ``held``."""
        if (need := self.held + len(ids)) > len(self.pool):
            grown = np.empty(need + need // 4, self.kind)
            grown[: self.held] = self.pool[: self.held]
            self.pool = grown
        self.pool[self.held : need] = ids

    def _turn(self) -> None:
        live = np.flatnonzero(self.used)[: self.limit // 2]
        (low, high), sizes = self.keys[live].T.copy(), self.sizes[live].astype(np.int64)
        ids, ends = self._gather(self.at[live].astype(np.int64), sizes)
        self.keys.fill(0)
        self.used.fill(False)
        self.held = self.n = 0
        self._append(ids)
        self.held = len(ids)
        self._insert(low, high, ends - sizes, sizes)

    def ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``data``: pieces, each followed by a space. All their ids, and the number of ids up to each piece's end."""
        if self.n >= self.limit:
            self._turn()
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1] + 1])
        length = ends - starts
        words = np.ndarray(len(data) + KEY_BYTES - 7, "<u8", data + bytes(KEY_BYTES), strides=(1,))
        low, high = words[starts] & _KEPT[np.minimum(length, 8)], words[starts + 8] & _KEPT[np.clip(length - 8, 0, 8)]
        slot, there = self._find(low, high)
        there &= length <= KEY_BYTES
        self.used[slot[there]] = True
        at, sizes = self.at[slot].astype(np.int64), self.sizes[slot].astype(np.int64)
        missing = np.flatnonzero(~there)
        if len(missing):
            at[missing], sizes[missing] = self._learn(data, starts[missing], ends[missing], low[missing], high[missing])
        return self._gather(at, sizes)

    def _learn(self, data: bytes, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of pieces that aren't held; short ones are, from now on, while there is room."""
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = dict.fromkeys(pieces)
        kept = [p for p in new if len(p) <= KEY_BYTES][: max(0, (self.last + 1) * 3 // 4 - self.n)]
        number = {p: i for i, p in enumerate(dict.fromkeys([*kept, *new]))}
        found = [self.make(p) for p in number]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        at = self.held + np.cumsum(sizes) - sizes
        self._append(np.frombuffer(b"".join(found), "<u4").astype(self.kind))
        which, sample = np.array([number[p] for p in pieces]), np.empty(len(number), np.intp)
        sample[which] = np.arange(len(pieces))
        k = len(kept)
        self._insert(low[sample[:k]], high[sample[:k]], at[:k], sizes[:k])
        self.held += int(sizes[:k].sum())
        return at[which], sizes[which]


class BatchEncoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers, many at a time."""

    def __init__(self, tokenizer_path: str, limit: int = TABLE_PIECES, side: int = SIDE_PIECES):
        self.plain = PieceEncoder(tokenizer_path, side)
        top = max(self.plain.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.table = PieceTable(self._make, "<u2" if top < 1 << 16 else "<u4", limit)

    def _make(self, piece: bytes) -> bytes:
        text = piece.decode()
        return self.plain.spaced[text] if len(piece) > KEY_BYTES else self.plain._ids(text, " ")

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))

    def many(self, texts: Iterable[str], segment: int = SEGMENT) -> Iterator[bytes]:
        """The ids of each text, in order."""
        heads: list[bytes] = []
        counts: list[int] = []
        rests: list[bytes] = []
        size = 0
        for text in texts:
            if not self.plain.cuts_all(text) or "\0" in text:
                head, rest = self.plain.encode(text), b""
            else:
                first, space, after = text.partition(" ")
                head, rest = self.plain.first[first] if first else b"", after.encode() + b" " if space else b""
            if size and size + len(rest) > segment:
                yield from self._flush(heads, counts, rests)
                heads, counts, rests, size = [], [], [], 0
            if len(rest) > segment:
                yield from self._flush(heads, counts, rests)
                heads, counts, rests, size = [], [], [], 0
                yield head + b"".join(self.table.ids(part)[0].astype("<u4").tobytes() for part in parts(rest, segment))
                continue
            heads.append(head)
            counts.append(rest.count(b" "))
            rests.append(rest)
            size += len(rest)
        yield from self._flush(heads, counts, rests)

    def _flush(self, heads: list[bytes], counts: list[int], rests: list[bytes]) -> Iterator[bytes]:
        if not any(counts):
            yield from heads
            return
        ids, ends = self.table.ids(b"".join(rests))
        ids, borders = ids.astype("<u4"), np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        for head, a, b in zip(heads, borders, borders[1:], strict=False):
            yield head + ids[a:b].tobytes()


def parts(data: bytes, size: int) -> Iterator[bytes]:
    """Stretches of about ``size`` bytes that end with a space, as ``data`` does."""
    at = 0
    while at < len(data):
        end = data.find(b" ", min(at + size, len(data) - 1)) + 1
        yield data[at:end]
        at = end


@lru_cache(maxsize=1)
def batch_encoder(tokenizer_path: str) -> BatchEncoder:
    """The worker's encoder: loaded once, its table serves all tasks."""
    return BatchEncoder(tokenizer_path)
