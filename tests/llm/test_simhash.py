import random

import numpy as np
import xxhash

from tablewright.llm import simhash
from tablewright.llm.components import components
from tablewright.llm.simhash import fingerprint, links, near_duplicates, shared_bytes, steiner_blocks


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(values, near):
    left, found = set(values), {}
    while left:
        start = min(left)
        left.discard(start)
        queue, group = [start], [start]
        while queue:
            u = queue.pop()
            hit = [v for v in left if near(u, v)]
            left.difference_update(hit)
            queue += hit
            group += hit
        found |= {v: min(group) for v in group}
    return found


def test_blocks_cover_any_three_bytes():
    from itertools import combinations

    blocks = steiner_blocks()
    assert len(blocks) == 14
    for lost in combinations(range(8), 3):
        assert any(not set(lost) & set(b) for b in blocks)


def test_fingerprints():
    for text in [None, "", " \t\n", "One", "one TWO", "É é A\x0bB\x0cc", "a b c a b c a b c", "x\x1cy z w", "w " * 70_000 + "end"]:
        assert fingerprint(text) & (1 << 64) - 1 == plain(text), text


def test_shared_bytes():
    xs = np.random.default_rng(0).integers(0, 2**64, 200, dtype=np.uint64) & np.random.default_rng(1).choice(np.array([0xFF, 0xFF00FF00, 2**64 - 1], np.uint64), 200)
    assert shared_bytes(xs).tolist() == [int(x).to_bytes(8, "little").count(0) for x in xs]


def test_links_join_what_all_pairs_join(spark):
    """Dense and long chains, in lists both below and above the block size."""
    rnd = random.Random(5)
    values = [rnd.getrandbits(64) for _ in range(200)]
    for centre in values[:4]:
        at = centre
        for _ in range(60):
            at ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
            values.append(at)
        values += [centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(60)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = roots_of(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for block in (4096, 16):
        got = {r.node: r.root for r in components(links(df, block)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(150)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(151)} | {500: 500, 501: 500}


def test_query_against_brute_force(spark):
    rnd = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(5)]
    rows = [(10, None), (11, ""), (12, " \n"), (None, "a b c"), (13, "A b C"), (14, "solo"), (14, "solo")]
    for i in range(60):
        text = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(200)] = "edit"
        rows.append((100 - i, " ".join(text)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, fp int").repartition(5)
    fps = {plain(t) for _, t in rows}
    root = roots_of(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, t in rows:
        if d is not None:
            least[root[plain(t)]] = min(d, least.get(root[plain(t)], d))
    want = sorted([(d, plain(t), least.get(root[plain(t)])) for d, t in rows], key=str)
    got = sorted([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(df).collect()], key=str)
    assert got == want
    assert near_duplicates(df.limit(0)).count() == 0
    assert simhash.MAX_BITS == 3
