import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tablewright.llm import jpeg, media


def test_payload():
    assert [len(media.payload(t)) for t in (None, "", "a", "é" * 288, "x" * 577)] == [576, 576, 576, 576, 1152]
    assert media.payload("ab") == b"ab" + b"\xff" * 574


def test_tones():
    assert sorted(jpeg.TONES.tolist()) == list(range(256)) == jpeg.BYTES[jpeg.TONES].tolist()
    assert [jpeg.TONES[ord(c)] for c in " eta"] == [128, 129, 127, 130]


@pytest.mark.parametrize("n", [576, 1152, 576 * 400])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"\xff" * n, b"\x00\xff" * (n // 2), b"text " * (n // 5) + b"t" * (n % 5)):
        (stream,) = jpeg.encode([data])
        ((w, h, pixels),) = jpeg.thumbnails([stream])[0]
        assert jpeg.BYTES[pixels].tobytes() == data and (w, h) == (pixels.shape[1] * 8, pixels.shape[0] * 8)


def test_several_images_a_payload(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 48)
    data = np.random.default_rng(0).integers(0, 256, 576 * 120, dtype=np.uint8).tobytes()
    streams = jpeg.encode([data, data[:576]])
    found = jpeg.thumbnails(streams)
    assert len(found[0]) == 3 and b"".join(jpeg.BYTES[p].tobytes() for *_, p in found[0]) == data and jpeg.BYTES[found[1][0][2]].tobytes() == data[:576]


def plain_decode(data):
    """A bit-by-bit decoder of one image, for comparison."""
    image, _ = jpeg.parse(data)
    codes = {}
    for name, table in image.tables.items():
        code, at = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                codes[name, n, code] = table[at]
                code, at = code + 1, at + 1
            code <<= 1
    total, values = image.mcus[0] * image.mcus[1], []
    for s, seg in enumerate(image.segments):
        bits, at = "".join(f"{b:08b}" for b in seg), 0
        before = [0] * 4

        def take(n):
            nonlocal at
            at += n
            return int(bits[at - n : at] or "0", 2)

        def symbol(name):
            code = n = 0
            while (name, n, code) not in codes or not n:
                code, n = code << 1 | take(1), n + 1
            return codes[name, n, code]

        step = image.restart or total
        for _ in range(min(step, total - s * step)):
            for c in image.blocks():
                size = symbol(image.components[c][4])
                v = take(size)
                before[c] += v if not size or v >> (size - 1) else v - (1 << size) + 1
                if c == 0:
                    values.append(before[c])
                k = 1
                while k < 64:
                    x = symbol(image.components[c][5])
                    take(x & 15)
                    k = 64 if x == 0 else k + (x >> 4) + 1
    return values


def coloured(rng, width, height, restart):
    """A random interleaved 4:2:0 image with AC coefficients, random bits under full code tables."""
    dc = {i: 4 for i in range(9)}
    ac = {0: 2, 0x01: 3, 0x12: 3, 0xF0: 4, 0x55: 4, 0x31: 5}
    head = b"\xff\xd8" + jpeg._segment(0xFE, b"comment") + jpeg._segment(0xDB, bytes([0]) + bytes(range(3, 67)))
    head += jpeg._segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += jpeg._segment(0xC4, jpeg._table(0, dc)) + jpeg._segment(0xC4, jpeg._table(0x10, ac))
    head += (jpeg._segment(0xDD, struct.pack(">H", restart)) if restart else b"") + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    dcs, acs, out = jpeg.canonical(dc), jpeg.canonical(ac), [head]
    units = -(-width // 16) * -(-height // 16)
    for s in range(0, units, restart or units):
        bits = ""
        for _ in range(min(restart or units, units - s) * 6):
            size = rng.randrange(9)
            bits += f"{dcs[size][0]:0{dcs[size][1]}b}" + "".join(rng.choice("01") for _ in range(size))
            k = 1
            while k < 64:
                x = rng.choice(list(ac))
                if k + (x >> 4) > 63:
                    x = 0
                bits += f"{acs[x][0]:0{acs[x][1]}b}" + "".join(rng.choice("01") for _ in range(x & 15))
                k = 64 if x == 0 else k + (x >> 4) + 1
        bits += "1" * (-len(bits) % 8)
        raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        out.append((b"\xff" + bytes([0xD0 + (s // restart - 1) % 8]) if s else b"") + raw)
    return b"".join(out) + b"\xff\xd9"


def test_decoder_on_general_images():
    rng = random.Random(9)
    streams = [coloured(rng, w, h, r) for w, h, r in [(16, 16, 0), (50, 33, 2), (100, 20, 3), (8, 8, 1), (33, 70, 0)]]
    streams += jpeg.encode([bytes(rng.randrange(256) for _ in range(1152))])
    images = [jpeg.parse(s)[0] for s in streams]
    assert [v.tolist() for v in jpeg.dc_values(images)] == [plain_decode(s) for s in streams]
    ((w, h, pixels),) = jpeg.thumbnails(streams[1:2])[0]
    assert (w, h, pixels.shape) == (50, 33, (5, 7))


def test_damage_is_told():
    (stream,) = jpeg.encode([b"some text " * 115 + b"xx"])
    with pytest.raises(ValueError):
        jpeg.thumbnails([stream[:-30] + b"\xff\xd9"])


def test_query(spark):
    texts = [None, "", "a", "a", "é" * 400, "long " * 60_000, "\xff" * 10]
    rows = [(i if i else None, t, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int").repartition(2)
    got = {r.doc_id: r for r in media.read_media(media.store_media(df)).collect()}
    for d, t, _ in rows:
        held, r = media.payload(t), got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-32:]))
    assert got[2][1:] == got[3][1:] and got[None][1:] == got[1][1:] and got[2].media_bytes == len(jpeg.encode([media.payload("a")])[0])
    assert media.read_media(media.store_media(df.limit(0))).count() == 0


def test_query_reads_a_stored_table(spark, tmp_path):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(folder.glob("tablewright-media-*"))
    got = {r.doc_id: r.media_sha256 for r in media.op7_media_jpeg(spark, str(tmp_path)).collect()}
    (new,) = set(folder.glob("tablewright-media-*")) - before
    assert {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in spark.read.parquet(f"file://{new}").collect()} == got and len(got) == 2
