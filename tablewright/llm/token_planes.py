"""Token-ID output in bit- or byte-plane shuffled shards.

Shard layout (little-endian)::

    magic "TWPL", u8 version, u8 mode (0 byte planes, 1 bit planes), u32 ids per block
    chunk data: for each block its zstandard-compressed planes, one after another
    document index: zstandard of [null flags u8][doc_id i64][token count i64], column by column
    chunk index: for each block u64 offset, u32 ids, u32 crc32 of the ids, then u32 stored size of
    each plane (0: the plane is all zero bytes and is not stored)
    trailer: u64 offset of the document index, u64 its size, u64 offset of the chunk index,
    u64 number of blocks, u64 number of documents, u64 number of ids, magic

A block holds a fixed number of ids (the last may hold fewer) and ignores document borders. A plane
collects the same byte (or bit) of every id of a block, so that the rare high planes vanish and the
low ones compress on their own. Any block can be read from the chunk index alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, shuffle_partitions
from .storage import AtomicFile, make_dir, open_input

MAGIC = b"TWPL"
HEAD, TRAILER = struct.Struct("<4sBBI"), struct.Struct("<6Q4s")
MODES = {"byte": 0, "bit": 1}
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block, the lowest first."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [cells[:, i].tobytes() for i in range(4)]
    planes = []
    for i in range(4):
        if not cells[:, i].any():
            planes += [bytes((len(ids) + 7) // 8)] * 8
            continue
        bits = np.unpackbits(cells[:, i : i + 1], axis=1, bitorder="little")
        planes += [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(8)]
    return planes


def from_planes(planes: list[bytes | None], n: int, mode: str) -> np.ndarray:
    """The ids of a block; None stands for a plane of zeros."""
    cells = np.zeros((n, 4), np.uint8)
    for i, plane in enumerate(planes):
        if plane is None:
            continue
        if mode == "byte":
            cells[:, i] = np.frombuffer(plane, np.uint8)
        else:
            bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
            cells[:, i // 8] |= bits << (i % 8)
    return cells.view("<u4").reshape(-1)


class ShardWriter:
    """Streams documents into a shard; memory is one block and 17 bytes a document."""

    def __init__(self, out, mode: str = "byte", block: int = 65536, level: int = 1):
        self.out, self.mode, self.block = out, mode, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.n_waiting, self.n_ids = HEAD.size, [], 0, 0
        self.chunks: list[bytes] = []
        self.null, self.ids, self.counts = bytearray(), bytearray(), bytearray()
        out.write(HEAD.pack(MAGIC, 1, MODES[mode], block))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        n = len(ids) // 4
        self.null.append(doc_id is None)
        self.ids += (doc_id or 0).to_bytes(8, "little", signed=True)
        self.counts += n.to_bytes(8, "little")
        self.waiting.append(ids)
        self.n_waiting += n
        if self.n_waiting >= self.block:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        full = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, full, self.block):
            self._put(ids[i : min(i + self.block, full)])
        self.waiting, self.n_waiting = [ids[full:].tobytes()], len(ids) - full

    def _put(self, ids: np.ndarray) -> None:
        sizes, start = [], self.at
        for plane in to_planes(ids, self.mode):
            stored = self.pack.compress(plane) if plane.strip(b"\0") else b""
            self.out.write(stored)
            sizes.append(len(stored))
            self.at += len(stored)
        self.chunks.append(struct.pack(f"<QII{len(sizes)}I", start, len(ids), zlib.crc32(ids.tobytes()), *sizes))
        self.n_ids += len(ids)

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        self._flush(last=True)
        index = self.pack.compress(bytes(self.null + self.ids + self.counts))
        self.out.write(index)
        for c in self.chunks:
            self.out.write(c)
        self.out.write(TRAILER.pack(self.at, len(index), self.at + len(index), len(self.chunks), len(self.null), self.n_ids, MAGIC))
        return len(self.null), self.n_ids


class ShardReader:
    """Documents of a shard, in order, one block at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        magic, version, mode, self.block = HEAD.unpack(source.read(HEAD.size))
        source.seek(size - TRAILER.size)
        index_at, index_size, self.chunks_at, self.n_chunks, self.n_docs, self.n_ids, end = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC or end != MAGIC or version != 1:
            raise ValueError("not a token-plane shard")
        self.mode = {v: k for k, v in MODES.items()}[mode]
        source.seek(index_at)
        raw = zstandard.decompress(source.read(index_size))
        n = self.n_docs
        self.null = np.frombuffer(raw, np.uint8, n).astype(bool)
        self.doc_ids = np.frombuffer(raw, "<i8", n, n)
        self.counts = np.frombuffer(raw, "<i8", n, n * 9)

    def blocks(self) -> Iterator[np.ndarray]:
        k = PLANES[self.mode]
        entry = struct.Struct(f"<QII{k}I")
        unpack = zstandard.ZstdDecompressor()
        for c in range(self.n_chunks):
            self.source.seek(self.chunks_at + c * entry.size)
            at, n, crc, *sizes = entry.unpack(self.source.read(entry.size))
            self.source.seek(at)
            data, planes, p = self.source.read(sum(sizes)), [], 0
            for s in sizes:
                planes.append(unpack.decompress(data[p : p + s]) if s else None)
                p += s
            ids = from_planes(planes, n, self.mode)
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"block {c} is damaged")
            yield ids

    def documents(self) -> Iterator[tuple[int | None, Iterator[bytes]]]:
        """(doc_id, parts of its ids as bytes); a document's parts must be used up before the next one's."""
        blocks, held = self.blocks(), b""

        def parts(n: int):
            nonlocal held
            while n:
                if not held:
                    held = next(blocks).tobytes()
                take, held = held[: 4 * n], held[4 * n :]
                n -= len(take) // 4
                yield take

        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.counts.tolist(), strict=True):
            yield (None if null else doc_id), parts(n)


def write_token_planes(
    docs: DataFrame,
    path: str,
    make_encoder: Callable[[], Callable[[str], bytes]],
    end_id: int | None = 0,
    mode: str = "byte",
    block: int = 65536,
    level: int = 1,
    shards: int | None = None,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards under ``path``, in ascending doc_id order; the manifest.

    Rows: shard, path, n_docs, n_ids, start (ids of all shards before). Documents without an id come
    first; rows of one id are ordered by a hash of the text, then by text, so that the range shuffle can
    split an id (or no id) that many rows share; a null text is an empty one; very long texts are encoded
    whole; an encoder with a method ``many`` gets the texts of a batch together; other columns are ignored; an empty table gives empty shards. Each task streams one shard, and
    a shard appears under its name only when complete, so a task may run again. The manifest (a row for
    each shard) is the only thing that reaches the driver. Without ``shards`` there is one for each shuffle partition.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    make_dir(path)
    n = shards or shuffle_partitions(spark)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n, F.asc_nulls_first("doc_id"), "print").sortWithinPartitions(F.asc_nulls_first("doc_id"), "print", "text").drop("print")
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def write(batches):
        encode, shard = make_encoder(), TaskContext.get().partitionId()
        many = getattr(encode, "many", lambda texts: map(encode, texts))
        name = f"{path}/shard-{shard:06d}.twpl"
        with AtomicFile(name) as out:
            to = ShardWriter(out, mode, block, level)
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), many(text.as_py() for text in batch.column(1)), strict=True):
                    to.add(doc_id, ids + end)
            n_docs, n_ids = to.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    found = sorted(tuple(r) for r in ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect())
    rows, start = [], 0
    for shard, name, n_docs, n_ids in found:
        rows.append((shard, name, n_docs, n_ids, start))
        start += n_ids
    return spark.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, start long")


def read_token_planes(manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids_crc32 of every document, a task for each shard."""

    def read(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(path) as source:
                    rows: list[tuple] = []
                    for doc_id, parts in ShardReader(source).documents():
                        n = crc = 0
                        for part in parts:
                            n, crc = n + len(part) // 4, zlib.crc32(part, crc)
                        rows.append((doc_id, at, n, crc))
                        at += n
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    shards = manifest.count()
    return manifest.select("path", "start", "shard").repartition(max(1, shards), "shard").select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def piece_encoder(tokenizer_path: str) -> Callable[[], Callable[[str], bytes]]:
    def make():
        from .piece_table import batch_encoder

        return batch_encoder(tokenizer_path)

    return make


def token_planes(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` as token planes in the shared folder, read them back, one row a document."""
    manifest = write_token_planes(docs, fresh_path(docs.sparkSession, "tokens"), piece_encoder(tokenizer_path), **options)
    return read_token_planes(manifest)
