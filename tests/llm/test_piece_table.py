import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm.piece_table import TABLE_PIECES, BatchEncoder, PieceTable, parts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def encoded(text):
    return np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("limit, segment", [(8, 40), (60, 300), (5000, 1 << 20)])
def test_many_texts_encode_as_whole_ones(limit, segment):
    rnd, encoder = random.Random(limit), BatchEncoder(PATH, limit, side=40)
    alphabet = ["a", "the", "Straße", " ", " ", " ", " ", "  ", "\n", ".", ",\nNext", "'s", "7", "é", "中", "\t", "\0", "\x1c", " ", "!!", "<|endoftext|>", "abcdefghijklmnop", "eight_by"]
    texts = ["", " ", " a", "a ", "word", "x\0 x", "one two " * 300 + "end", "é" * 8 + " " + "é" * 9, " <|endoftext|> b", "abcdefgh abcdefghi abcdefghijklmnop abcdefghijklmnopq"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    for _ in range(2):
        assert list(encoder.many(texts, segment)) == [encoded(t) for t in texts]
        rnd.shuffle(texts)
    assert encoder(texts[0]) == encoded(texts[0]) and list(encoder.many([])) == []


def test_other_tokenizers_encode_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = ["", "One two", "  x\n\ny é 中", "a b c"]
    assert list(BatchEncoder(path, 50).many(texts)) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pieces_are_made_once_and_those_used_again_stay():
    """300,000 different pieces, more than the dicts held, are encoded once; a turn keeps what was used again."""
    made = []

    def make(piece):
        made.append(piece)
        return len(piece).to_bytes(4, "little") * (len(piece) % 3)

    table, words = PieceTable(make, "<u2", TABLE_PIECES), [b"%d " % i for i in range(300_000)]
    for _ in range(2):
        ids, ends = table.ids(b"".join(words))
        assert np.diff(ends, prepend=0).tolist() == [(len(w) - 1) % 3 for w in words]
        assert ids.tolist() == [len(w) - 1 for w in words for _ in range((len(w) - 1) % 3)]
    assert len(made) == len(words)
    small = PieceTable(make, "<u2", 100)
    for i in range(400):
        small.ids(b"often again %d " % i)
    assert made.count(b"often") == 1 and small.n <= 103


def test_parts_end_with_spaces():
    data = b"one three a verylongword x "
    for size in (1, 3, 8, 100):
        assert b"".join(parts(data, size)) == data and all(p.endswith(b" ") for p in parts(data, size))
