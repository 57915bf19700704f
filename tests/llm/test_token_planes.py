import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm.bpe import PieceEncoder, cuts_at_spaces
from tablewright.llm.common import fresh_path
from tablewright.llm.token_planes import ShardReader, ShardWriter, from_planes, piece_encoder, to_planes, token_planes, write_token_planes

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a   b ", "\n\n a", "a \n b", "it's  don't 're", "x<|endoftext|>y  <|endoftext|>", "a\x1c b", "word.\n next,\nfoo. bar,", "日本 語 🎉🎉", "a　b  ", "1,234.5 %"]


def encoded(text):
    return np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_encode_as_the_whole_text():
    rnd, encoder, whole = random.Random(3), PieceEncoder(PATH, limit=50), Tokenizer.from_file(PATH)
    alphabet = ["a", "the", " ", "  ", "\n", ".", ",", "'s", "7", "é", "中", "\t", "\x1c", " ", "!!", "<|endoftext|>"]
    for text in ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))) for _ in range(3000)]:
        assert encoder.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (from_planes(to_planes(ids, mode), n, mode) == ids).all()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_shard_round_trip_over_block_borders(mode):
    rng, out = np.random.default_rng(1), io.BytesIO()
    docs = [(i if i != 3 else None, rng.integers(0, 50257, k).astype("<u4").tobytes()) for i, k in enumerate([0, 5, 300, 0, 64, 63, 1])]
    writer = ShardWriter(out, mode, block=64)
    for d in docs:
        writer.add(*d)
    assert writer.close() == (7, 433)
    reader = ShardReader(pa.BufferReader(out.getvalue()))
    assert [(d, b"".join(parts)) for d, parts in reader.documents()] == docs


def test_query_matches_the_library(spark):
    texts = [*ODD, None, "same", "same", "long " * 40_000]
    rows = [(i * 3 if i else None, t, "en") for i, t in enumerate(texts)] + [(3, "again", "x")]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = sorted(map(tuple, token_planes(df, PATH, block=1000).collect()), key=lambda r: r[1])
    hashed = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("h")).collect()}
    start = 0
    for (doc_id, text, _), row in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""])), got, strict=True):
        ids = encoded(text or "") + bytes(4)
        assert row == (doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_empty_table(spark):
    assert token_planes(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_one_id_is_split(spark):
    """Rows without an id, or of one id, fill several shards."""
    df = spark.createDataFrame([(None, f"text {i}") for i in range(200)] + [(5, f"text {i}") for i in range(200)], "doc_id long, text string")
    manifest = write_token_planes(df, fresh_path(spark, "hot"), piece_encoder(PATH), shards=8).collect()
    assert sum(r.n_docs for r in manifest) == 400 and max(r.n_docs for r in manifest) < 150


def test_other_tokenizers_encode_whole():
    other = public_tokenizers.path("word_bpe_49k.json")
    assert cuts_at_spaces(PATH) and not cuts_at_spaces(other)
    whole = Tokenizer.from_file(other)
    for text in ODD:
        assert PieceEncoder(other).encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
