"""Exact, memoised encoding with the ``tokenizers`` library's byte-level BPE.

A text is cut before each single space that a non-space character follows. The pre-tokenizer of a
byte-level BPE always has a boundary there, whatever stands around it, so the pieces' ids put
together are the ids of the whole text. Pieces repeat, and a worker remembers the ids of many. Texts
that hold an added special string are encoded whole, and so are all texts if the tokenizer's file says
that it isn't such a BPE (another pre-tokenizer, a normalizer, word ends, dropout).
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import islice

#: A worker forgets its older half of pieces beyond this many, which bounds its memory to about 60 MB: longer
#: pieces than MEMO_LETTERS aren't kept.
MEMO_PIECES, MEMO_LETTERS = 250_000, 64
_CUT = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
#: Letters whose class is the same in every Unicode version; others go through the full library path.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
_TWO_LINES = re.compile(r"(\S+)\n(\S+)")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level BPE: Latin-1's printable characters
    stand for themselves, and the other bytes take code points from 256 on in ascending order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Piece -> value; at the limit, the older half goes (a dict keeps insertion order)."""

    def __init__(self, make, limit: int = MEMO_PIECES):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_LETTERS:
            if len(self) >= self.limit:
                for k in list(islice(self, self.limit // 2)):
                    del self[k]
            self[key] = value
        return value


def cuts_at_spaces(tokenizer_path: str) -> bool:
    """Does the file describe a byte-level BPE whose ids are those of its pieces?"""
    with open(tokenizer_path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told.get("model") or {}, told.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    whole = not (told.get("normalizer") or told.get("truncation") or told.get("padding"))
    strips = any(t.get(k) for t in told.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return model.get("type") == "BPE" and plain and split and whole and not strips


@lru_cache(maxsize=1)
def encoder(tokenizer_path: str) -> PieceEncoder:
    """The worker's encoder: loaded once, its memo serves all tasks."""
    return PieceEncoder(tokenizer_path)


class PieceEncoder:
    """Encodes whole texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_path: str, limit: int = MEMO_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.cuts = cuts_at_spaces(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = byte_alphabet()
        self.space = self.letters[ord(" ")]
        self.first = Memo(lambda p: self._ids(p, ""), limit // 4)
        self.spaced = Memo(lambda p: self._ids(p, " "), limit)
        self.tail = Memo(lambda p: self._whole(p), 2000)

    @staticmethod
    def _pack(ids) -> bytes:
        return array("I", ids).tobytes()

    def _model(self, piece: str, lead: str):
        """Ids of ``lead`` and the letters of ``piece``: one pre-token, so the model alone does."""
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(self.space + mapped if lead else mapped)]

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _ids(self, piece: str, lead: str) -> bytes:
        held = self.spaced if lead else self.first
        if (piece.isascii() and piece.isalpha()) or _LETTERS.fullmatch(piece):
            return self._pack(self._model(piece, lead))
        if m := _LETTERS_MARKS.fullmatch(piece):
            return held[m[1]] + self.tail[m[2]]
        if m := _TWO_LINES.fullmatch(piece):  # a lone line feed between non-spaces is a pre-token of its own
            return held[m[1]] + self.tail["\n"] + self.first[m[2]]
        return self._whole(lead + piece)

    def cuts_all(self, text: str) -> bool:
        """Is ``text`` cut at every space that it holds?"""
        return self.cuts and not any(s in text for s in self.special) and not _ODD_SPACE.search(text)

    def pieces(self, text: str) -> list[str] | None:
        """The first piece, and the others without the space before them; None if the text is encoded whole."""
        if not self.cuts or any(s in text for s in self.special):
            return None
        return _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if (parts := self.pieces(text)) is None:
            return self._whole(text)
        spaced = self.spaced
        return self.first[parts[0]] + b"".join([spaced[p] for p in islice(parts, 1, None)])
