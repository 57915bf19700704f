import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm.bpe import PieceEncoder
from tablewright.llm.token_counts import count, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE, PIECES = Tokenizer.from_file(PATH), PieceEncoder(PATH, limit=50)


def plain(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False))


@pytest.mark.parametrize("chunk, overlap", [(40, 17), (64, 20), (200, 30), (31, 1)])
def test_spliced_counts(chunk, overlap):
    rnd = random.Random(chunk)
    alphabet = ["a", "the", "Word", " ", "  ", "\n", "\n\n", ".", "'s", "'re", "12", "é", "中", "🎉", "\t", " <|endoftext|>", "<|endoftext|>", "<|endof", "!!"]
    for _ in range(120):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(50, 400)))
        assert count(WHOLE, text, chunk, overlap) == plain(text), text
        assert count(PIECES, text, chunk, overlap) == plain(text), text


def test_words_and_spaces_longer_than_the_overlap():
    for text in ["a" * 900, "word " * 20 + "b" * 500 + " end" * 30, " " * 700 + "x", "\n" * 300 + " " * 300, "x" * 100 + " " * 200 + "1" * 300 + "<|endoftext|>" * 40]:
        assert count(WHOLE, text, 100, 10) == plain(text)
        assert count(PIECES, text, 100, 10) == plain(text)


def test_query(spark):
    texts = [None, "", " ", "one", "one", "<|endoftext|>", "long text, " * 9000, "é" * 70_000]
    rows = [(i if i else None, t, 5) for i, t in enumerate(texts)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(2), PATH, chunk=5000, overlap=64).collect()
    want = [(i, len((t or "").encode()), plain(t), plain(t) > 1024) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_libraries_and_files(spark, name):
    path, texts = public_tokenizers.path(name), ["", "One two", "  x\n\ny <s> é 中", "many words " * 900]
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        want = [len(SentencePieceProcessor(model_file=path).encode(t)) for t in texts]
    else:
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in texts]
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want
