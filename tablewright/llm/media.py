"""Media columns: texts stored as baseline JPEG images, and what is read back from the stored bytes."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import bound_batches, documents, stored

UNIT = 576
#: Payload bytes that are encoded or decoded together.
GROUP = 2_000_000


def payload(text: str | None) -> bytes:
    """UTF-8, filled with bytes 255 to a positive multiple of 576; null is an empty text."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT or UNIT * (not raw))


def _grouped(items: list[bytes], most: int = GROUP):
    group, size = [], 0
    for x in items:
        if group and size + len(x) > most:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        yield group


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (a JPEG stream) for every row of ``docs`` (doc_id, text).

    A null or empty text is 576 bytes 255; a very long one is several images one after another; equal
    texts and repeated rows get equal bytes; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, media, group, held = [], [], [], 0
            for value in batch.column(1):
                text = value.as_py()
                sizes.append(len((text or "").encode()))
                group.append(payload(text))
                held += len(group[-1])
                if held > GROUP:
                    media += jpeg.encode(group)
                    group, held = [], 0
            media += jpeg.encode(group) if group else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What the stored bytes of ``media`` (doc_id, n_bytes, media) hold.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: the
    size of each image and the average hash of its DC thumbnail. A row for each of ``media``, which may
    repeat ids or lack them; null or damaged media are an error.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for group in _grouped(batch.column(2).to_pylist()):
                for data, images in zip(group, jpeg.thumbnails(group), strict=True):
                    held = b"".join(jpeg.BYTES[p].tobytes() for *_, p in images)
                    feature = ";".join(f"{w}x{h}:{jpeg.average_hash(p)}" for w, h, p in images)
                    rows.append((len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            c = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(c, kinds, strict=True)]], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, null and empty texts as 576 bytes 255; other columns are ignored."""
    return read_media(stored(store_media(documents(spark, sf_dir)), "media"))
