"""Exact token counts; huge documents are counted by overlap resynchronisation.

A long text is cut into chunks that overlap, and each chunk is encoded on its own with offsets. The
pre-tokenizer scans from left to right without looking back and looks one character ahead, so two
encodings that share one true boundary between pre-tokens agree from there on. A boundary of the
left chunk is true if it lies behind the place where that chunk was joined to the one before, and
far enough from the chunk's end that neither the look-ahead nor an added special string is cut off.
The first such boundary that the right chunk has too is where the two are spliced. Without one (a
word longer than the overlap), the left chunk is encoded again with twice the overlap, up to the end
of the text. A text that one chunk holds is that chunk.

Chunks are encoded by the pieces of :mod:`.bpe`, whose borders are boundaries of pre-tokens, or by the
library with its own offsets where a text or a tokenizer can't be cut so.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PieceEncoder
from .common import bound_batches, documents

#: Code points of a chunk without its overlap, and of an overlap at first.
CHUNK, OVERLAP = 32_768, 512
LIMIT = 1024


class Chunk:
    """An encoded stretch of a text: where its pre-tokens start, and the tokens before each start."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        found = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.n = len(found)
        words, offsets = found.word_ids, found.offsets
        first = [i for i in range(self.n) if i == 0 or words[i] != words[i - 1]]
        self.starts = [start + offsets[i][0] for i in first]
        self.before = first
        self.end = end

    def tokens_before(self, boundary: int) -> int:
        return self.before[bisect_left(self.starts, boundary)]


class PieceChunk(Chunk):
    """The same by remembered pieces: a boundary before each piece."""

    def __init__(self, pieces: PieceEncoder, text: str, start: int, end: int):
        if (parts := pieces.pieces(text[start:end])) is None:
            super().__init__(pieces.tokenizer, text, start, end)
            return
        sizes = [len(pieces.first[parts[0]]) // 4, *(len(pieces.spaced[p]) // 4 for p in parts[1:])]
        ends = list(accumulate(sizes))
        self.n = ends[-1]
        self.before = [0, *ends[:-1]]
        # Each piece but the first has a space before it.
        self.starts = [start, *(start + at for at in accumulate([len(parts[0]), *(len(p) + 1 for p in parts[1:-1])]))][: len(parts)]
        if self.n and not sizes[0]:
            self.starts, self.before = self.starts[1:], self.before[1:]
        self.end = end


def margin(tokenizer) -> int:
    """Code points before a chunk's end in which its boundaries are not yet proven."""
    return 2 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, equal to ``len(tokenizer.encode(text))`` without special tokens around it.

    ``tokenizer`` is a PieceEncoder or one of the library.
    """
    cut = PieceChunk if isinstance(tokenizer, PieceEncoder) else Chunk
    size, edge = len(text), margin(getattr(tokenizer, "tokenizer", tokenizer))
    total, joined = 0, 0  # tokens before ``joined``, a boundary of the whole text and of ``left``
    left = cut(tokenizer, text, 0, min(size, chunk + overlap))
    while left.end < size:
        at, wide = left.end - overlap, overlap
        right = cut(tokenizer, text, at, min(size, at + chunk + overlap))
        while (common := _splice(left, right, max(at, joined), left.end - edge)) is None and left.end < size:
            wide *= 2
            left = cut(tokenizer, text, joined, min(size, at + wide))
            if left.end > right.end:
                right = cut(tokenizer, text, at, min(size, left.end + chunk))
        if common is None:  # left now goes to the end
            break
        total += left.tokens_before(common) - (left.tokens_before(joined) if joined else 0)
        left, joined = right, common
    return total + left.n - (left.tokens_before(joined) if joined else 0)


def _splice(left: Chunk, right: Chunk, low: int, high: int) -> int | None:
    """The first boundary from ``low`` to ``high`` that both have."""
    known = left.starts
    for b in right.starts[bisect_left(right.starts, low) : bisect_right(right.starts, high)]:
        i = bisect_left(known, b)
        if i < len(known) and known[i] == b:
            return b
    return None


def counter(tokenizer_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """text -> tokens. Where boundaries aren't proven (a ``.model``, a pre-tokenizer that isn't byte-level) texts are encoded whole."""
    if tokenizer_path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=tokenizer_path)
        return lambda text: len(pieces.encode(text))
    from .bpe import encoder

    held = encoder(tokenizer_path)
    if not held.cuts:
        return lambda text: len(held.tokenizer.encode(text, add_special_tokens=False))
    return lambda text: count(held, text, chunk, overlap) if text else 0


def token_counts(docs: DataFrame, tokenizer_path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text; others are ignored).

    A null or empty text has no bytes and no tokens; rows that repeat get equal results; null ids stay
    null; an empty table gives an empty result. Texts of any length are counted whole, those of more than
    ``chunk + overlap`` code points over several chunks.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        tokens = counter(tokenizer_path, chunk, overlap)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(tokens(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every row of documents by the byte-level BPE."""
    from .registry import BYTE_BPE

    return token_counts(documents(spark, sf_dir), BYTE_BPE)
