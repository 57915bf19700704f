"""SimHash near-dedup by shingle similarity: the operator's second definition of a link.

Two texts link if the sets of their ``WIDTH``-word shingles have a Jaccard similarity of ``LEAST`` or more.
The positional bytes of a 64-bit majority fingerprint can't find such pairs (at 0.8 about ten bits
differ, which guarantees no equal byte), so the fingerprint here has ``BANDS`` x ``ROWS`` positional bytes, each a
byte of the least value of the shingles under a hash of its own: a byte agrees with the probability of
the similarity. The index is inverted by byte position as in :mod:`.simhash`: ``ROWS`` neighbouring bytes
make a key. Two texts of similarity s share a key with probability 1 - (1 - s^5)^30: all but 7 in a
million at 0.8. Within a posting list the shared bytes of a pair are tallied, pairs with ``AGREE`` or more go
on, and the sets of shingles (as 64-bit hashes) are compared.

Lists are worked through in two rounds. The first takes a few bands, and a list longer than a block
only in parts, each against itself: linear work that joins most of a large group. The second takes
all bands, but only lists that still hold several components; of those, members outside the largest
component are compared with all others, block by block. No pair is emitted or shuffled but links, a
forest for each block, and no pair of different texts is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, sized, stored, text_print
from .components import components

SEED = 42
#: Words of a shingle; the least similarity, as a fraction.
WIDTH, LEAST = 5, (4, 5)
BANDS, ROWS = 30, 5
#: Of BANDS * ROWS bytes so many agree at least in a pair worth a comparison: 5.5 deviations below what 0.8 gives.
AGREE = 93
#: Bands of the first round.
FIRST_BANDS = 4
#: Most rows and bytes of text of a block of a posting list, unless a single text is larger.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16_000_000
PIECE = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_PLACES = _RNG.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
#: Hashes of words that a worker remembers.
MEMO_WORDS = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


_hash_of = _Words()


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at white space."""
    return (text or "").encode().translate(_LOWER).split()


def shingles(found: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of each WIDTH words in a row; of fewer words, of all as one; none without words."""
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    each = np.fromiter(map(_hash_of.__getitem__, found), np.uint64, len(found))
    n = len(each) - WIDTH + 1
    mixed = each[:n] * _PLACES[0]
    for i in range(1, WIDTH):
        mixed += each[i : i + n] * _PLACES[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _PLACES[0]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is LEAST or more; two sets without shingles are alike."""
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def positional_bytes(found: np.ndarray) -> bytes:
    """A byte of each of the least values of ``found`` under BANDS * ROWS hashes."""
    hashes = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for i in range(0, len(hashes), PIECE):
        value = _FACTORS * hashes[i : i + PIECE]
        value += _TERMS
        np.minimum(least, value.min(axis=1), out=least)
    return least.astype(np.uint8).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, print, node (a hash of the words in order), size (distinct shingles), weight (bytes of the text), mins (the positional bytes)."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            node, size, weight, mins = [], [], [], []
            for t in batch.column(2):
                found = words(t.as_py())
                s = shingles(found)
                node.append(xxhash.xxh64_intdigest(b" ".join(found), SEED))
                size.append(len(s))
                weight.append(sum(map(len, found)) + len(found))
                mins.append(positional_bytes(s))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).astype(np.int64)), pa.array(size, pa.int64()), pa.array(weight, pa.int64()), pa.array(mins, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "node", "size", "weight", "mins"])

    return docs.select("doc_id", text_print().alias("print"), "text").mapInArrow(run, "doc_id long, print long, node long, size long, weight long, mins binary")


def postings(nodes: DataFrame) -> DataFrame:
    """(band, key, node, weight, n): the members of each posting list of more than one, with their number."""
    key = lambda b: F.expr(f"substring(mins, {b * ROWS + 1}, {ROWS})")
    keyed = nodes.select("node", "weight", F.posexplode(F.array(*[key(b) for b in range(BANDS)])).alias("band", "key"))
    lists = stored(keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).where("n > 1"), "posting-lists")
    return keyed.join(sized(lists), ["band", "key"])


def _parts(n, size) -> F.Column:
    """How many blocks ``n`` rows of ``size`` bytes make."""
    return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")


def first_round(members: DataFrame) -> DataFrame:
    """Blocks of the first bands: each part of a list against itself."""
    part = F.pmod(F.xxhash64("node", "band"), _parts(F.col("n"), F.col("bytes"))).cast("int")
    return members.where(F.col("band") < FIRST_BANDS).select("band", "key", part.alias("a"), part.alias("b"), part.alias("own"), "node", F.col("node").alias("root"))


def second_round(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks of all lists that hold several components: what isn't of the largest, against everything.

    Lists that the first round saw whole are done.
    """
    seen = (F.col("band") < FIRST_BANDS) & (_parts(F.col("n"), F.col("bytes")) == 1)
    rooted = stored(members.where(~seen).join(roots, "node", "left").select("band", "key", "node", "weight", F.coalesce("root", "node").alias("root")), "members")
    by_root = rooted.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes"))
    most = F.max(F.struct("n", "root", "bytes"))
    open_ = by_root.groupBy("band", "key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), most.alias("most")).where("roots > 1")
    whole = _parts(F.col("n"), F.col("bytes")) == 1
    lists = open_.select("band", "key", F.col("most.root").alias("major"), F.when(whole, 0).otherwise(_parts(F.col("most.n"), F.col("most.bytes"))).alias("majors"), F.when(whole, 1).otherwise(_parts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))).alias("minors"))
    placed = rooted.join(sized(stored(lists, "open-lists")), ["band", "key"])
    # Chunks of the largest component come first, then the others'; in a list of one block all have chunk 0.
    of_major = (F.col("root") == F.col("major")) & (F.col("majors") > 0)
    mixed = F.xxhash64("node", "band")
    own = F.when(of_major, F.pmod(mixed, F.greatest("majors", F.lit(1)))).otherwise(F.col("majors") + F.pmod(mixed, F.greatest("minors", F.lit(1)))).cast("int")
    dealt = placed.withColumn("own", own)
    to = F.when(of_major, F.sequence(F.col("majors"), F.col("majors") + F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("majors") + F.col("minors") - 1))
    dealt = dealt.withColumn("other", F.explode(to))
    return dealt.select("band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "root")


def linked(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links that join the members of each block as all links of different roots would.

    ``texts`` has node, size, mins and text. A block goes through one task.
    """
    bound_batches(blocks.sparkSession)
    keys = ["band", "key", "a", "b"]
    rows = blocks.join(texts, "node").select(*keys, "own", "node", "root", "mins", "text").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        now, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:8]]
            for i, key in enumerate(zip(*columns[:4], strict=True)):
                if key != now:
                    yield from _links(now, held)
                    now, held = key, []
                held.append((columns[4][i], columns[5][i], columns[6][i], columns[7][i], batch.column(8)[i].as_py()))
        yield from _links(now, held)

    return rows.mapInArrow(run, "u long, v long").distinct()


def _links(key: tuple | None, rows: list[tuple]):
    """The links of one block of (own, node, root, mins, text)."""
    if len(rows) < 2:
        return
    band, _, a, b = key
    own, node, root = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    mins = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), BANDS * ROWS)
    group = np.unique(root, return_inverse=True)[1]
    sets: list[np.ndarray | None] = [None] * len(rows)

    def of(i: int) -> np.ndarray:
        if sets[i] is None:
            sets[i] = shingles(words(rows[i][4]))
        return sets[i]

    u, v = [], []
    for i in range(len(rows) - 1):
        fits = group[i + 1 :] != group[i]
        if a != b:
            fits &= own[i + 1 :] != own[i]
        at = i + 1 + np.flatnonzero(fits)
        if not len(at):
            continue
        equal = mins[at] == mins[i]
        shared = equal.sum(axis=1)
        # A pair is compared in the first band that it shares.
        first = equal.reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        keep = np.flatnonzero((shared >= AGREE) & first)
        for j in at[keep[np.argsort(-shared[keep], kind="stable")]]:
            if group[j] != group[i] and alike(of(i), of(j)):
                u.append(int(node[i]))
                v.append(int(node[j]))
                group[group == group[j]] = group[i]
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, print, component_id, stays for every row of ``docs`` (doc_id, text; others are ignored).

    Components are those of the links between texts whose shingles have a Jaccard similarity of LEAST
    or more. Null and empty texts have no words and are alike; a text of fewer words than a shingle is one
    shingle; very long texts count whole. ``component_id`` is the least doc_id of the component; null ids
    don't count, and a component of null ids alone has none. ``stays`` marks the rows to keep: those of
    the least doc_id, then of the least hash of the text, which repeated rows share. An empty table gives an
    empty result.
    """
    rows = stored(sketches(docs), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    nodes = stored(rows.groupBy("node").agg(F.min(own).alias("least"), F.first("size").alias("size"), F.first("weight").alias("weight"), F.first("mins").alias("mins")), "nodes")
    members = stored(postings(nodes), "postings")
    compared = stored(members.select("node").distinct().join(nodes, "node").select("node", F.col("least.doc_id").alias("__id"), F.col("least.print").alias("__print"), "mins"), "compared")
    found = docs.select("doc_id", "text").join(sized(compared), F.col("doc_id").eqNullSafe(F.col("__id")) & (text_print() == F.col("__print")))
    texts = stored(found.groupBy("node").agg(F.first("mins").alias("mins"), F.first("text").alias("text")), "texts")
    links = stored(linked(first_round(members), texts), "links")
    links = links.union(stored(linked(second_round(members, stored(components(links), "roots")), texts), "links"))
    roots = components(links)
    rooted = stored(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    classes = stored(rooted.join(firsts, "root").select("node", "first"), "classes")
    return rows.join(classes, "node").select("doc_id", "print", F.col("first.doc_id").alias("component_id"), (own == F.col("first")).alias("stays"))
