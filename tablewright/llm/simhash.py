"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two fingerprints that differ in at most three of 64 bits agree in at least five of their eight
bytes. Postings of one positional byte hold a 256th of all fingerprints, so the index is keyed by
*four* positional bytes: the 14 blocks of the Steiner system S(3,4,8). Every set of three positions
lies in one block, whose complement is a block too, so whichever three bytes differ, some block's
four bytes agree. Within a posting list the shared positional bytes of a pair are tallied, pairs with
at least five go on, and the bits are compared. Lists longer than ``BLOCK_ROWS`` are dealt out in
pairs of chunks, each a task's bounded work, and every list leaves at most a forest of its links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import bound_batches, documents, sized, stored, text_print
from .components import components
from .near_copies import _LOWER, BLOCK_ROWS, SEED

MAX_BITS = 3
#: Least equal bytes of two fingerprints within MAX_BITS.
LEAST_BYTES = 8 - MAX_BITS


def steiner_blocks() -> list[tuple[int, ...]]:
    """The 14 four-sets of the points 0-7 as vectors of GF(2)^3 whose sum is zero: each three points are in one."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (a hash of the text), fp. A null text has no words."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "print", "fp"])

    return docs.select("doc_id", text_print().alias("print"), "text").mapInArrow(run, "doc_id long, print long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """For XORs of fingerprints: how many of the eight bytes are equal."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return 8 - np.bitwise_count(y & np.uint64(0x0101010101010101)).astype(np.int64)


def forest(fps: np.ndarray, max_bits: int = MAX_BITS, least_bytes: int = LEAST_BYTES) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one posting list as all links within ``max_bits`` would."""
    links, rest = [], np.unique(fps.astype(np.int64)).view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = rest ^ queue[-1]
            near = shared_bytes(x) >= least_bytes
            near[near] = np.bitwise_count(x[near]) <= max_bits
            u = int(queue.pop().astype(np.int64))
            links += [(u, int(v)) for v in rest[near].astype(np.int64)]
            queue += list(rest[near])
            rest = rest[~near]
    return links


def _masks() -> list[int]:
    found = [sum(0xFF << (8 * p) for p in block) for block in steiner_blocks()]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): a forest over all links between the distinct ``fp`` of a table.

    Each fingerprint enters 14 posting lists; lists of one are dropped. A list of more than
    ``block_rows`` is cut into chunks by a hash, and each pair of chunks is a group of its own.
    """
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()])).alias("part", "bytes"))
    lists = stored(postings.groupBy("part", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "posting-lists")
    held = postings.join(sized(lists), ["part", "bytes"])
    chunks = F.ceil(F.col("n") / block_rows).cast("int")
    dealt = held.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["part", "bytes", "a", "b"]
    grouped = dealt.select("part", "bytes", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        kept = None  # the last group of a batch may go on in the next
        for batch in batches:
            now = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            now = now if kept is None else np.concatenate([kept, now])
            if not len(now):
                continue
            starts = np.flatnonzero(np.r_[True, (now[1:, :4] != now[:-1, :4]).any(axis=1)])
            kept = now[starts[-1] :]
            yield _pairs(now, starts)
        if kept is not None:
            yield _pairs(kept, np.array([0, len(kept)]))

    return grouped.mapInArrow(run, "u long, v long").distinct()


def _pairs(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    found = [link for i, j in zip(starts[:-1], starts[1:], strict=True) for link in forest(rows[i:j, 4])]
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def near_duplicates(docs: DataFrame, by: str = "bits") -> DataFrame:
    """doc_id, print, component_id, stays (and fp) for every row of ``docs`` (doc_id, text; others are ignored).

    ``by="bits"`` links fingerprints of at most three differing bits; texts without words (null, empty,
    white space) have fingerprint 0 and link like any other. ``by="shingles"`` links texts whose five-word
    shingles have a similarity of 0.8 or more (see :mod:`.near_copies`). Very long texts count whole. The
    component id is the least doc_id reachable over links; null ids don't count, and a component of null
    ids alone has none. ``stays`` marks the row to keep of each component: that of the least doc_id, then
    of the least hash of the text. Repeated rows give repeated results; an empty table gives an empty one.
    """
    if by == "shingles":
        return near_copies.near_copies(docs)
    prints = stored(fingerprints(docs), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    distinct = stored(prints.groupBy("fp").agg(F.min(own).alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("first"))
    classes = stored(rooted.join(groups, "root").select("fp", "first"), "classes")
    return prints.join(classes, "fp").select("doc_id", "print", "fp", F.col("first.doc_id").alias("component_id"), (own == F.col("first")).alias("stays"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, linked by three bits of three-word shingles."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
