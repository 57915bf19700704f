import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from tablewright.llm import near_copies as m, simhash  # noqa: E402


def similarity(a, b):
    a, b = (a or "").lower().split(), (b or "").lower().split()
    if not a or not b:
        return float(a == b)
    x, y = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def made():
    rnd, rows = random.Random(4), [(900, None), (901, " \n"), (None, "a b c"), (902, "A b C"), (903, "a b"), (904, "one two three four five"), (904, "one two three four five")]
    for b in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        for i in range(8):
            text = list(base)
            for _ in range(rnd.randint(0, 9)):
                text[rnd.randrange(300)] = f"edit{rnd.randrange(1000)}"
            rows.append((b * 20 + i, " ".join(text)))
    passage = " ".join(f"common{i}" for i in range(40))
    rows += [(500 + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(12)]
    return rows


def test_stage_against_all_pairs(spark):
    """Near copies over 3 bits apart go too, and pairs below the similarity stay."""
    rows = made()
    texts = list({t for _, t in rows})
    root = {t: i for i, t in enumerate(texts)}
    far = 0
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similarity(a, b) >= 0.8:
                far += (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
                x, y = root[a], root[b]
                root = {t: x if r == y else r for t, r in root.items()}
    assert far > 20
    least = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        least.setdefault(root[t], d)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = m.near_copies(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == sorted((d or -1, least[root[t]]) for d, t in rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(least.values())


def test_rounds_and_blocks(spark, monkeypatch):
    """Without the first round, and with lists dealt out in blocks of three rows, the result is the same."""
    docs = spark.createDataFrame(made(), "doc_id long, text string").repartition(3)
    want = sorted(map(str, m.near_copies(docs).collect()))
    monkeypatch.setattr(m, "BLOCK_ROWS", 3)
    assert sorted(map(str, m.near_copies(docs).collect())) == want
    monkeypatch.setattr(m, "FIRST_BANDS", 0)
    assert sorted(map(str, m.near_copies(docs).collect())) == want


def test_shingles_and_alike():
    a, b = (m.shingles(m.words(" ".join(f"w{i}" for i in range(s, s + 44)))) for s in (0, 2))
    assert len(a) == 40 and m.alike(a, a) and m.alike(a[:0], b[:0]) and not m.alike(a, b[:0])
    assert m.alike(a, b) == (38 * 5 >= 42 * 4) and m.alike(a, b[:36]) == (34 * 5 >= 42 * 4)
    assert m.shingles(m.words("A b c d e a b c d E")).tolist() == m.shingles(m.words("a b c d e a b c d e")).tolist()
    assert len(m.positional_bytes(a)) == len(m.positional_bytes(a[:0])) == m.BANDS * m.ROWS
    long = m.shingles(m.words(" ".join(str(i) for i in range(5000))))
    assert len(long) == 4996 and m.positional_bytes(long) != m.positional_bytes(long[:-900])


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_copies(none).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, node long, mins string")
    assert sorted((r.doc_id or -1, r.component_id) for r in m.near_copies(odd).collect()) == [(-1, None), (1, 1)]
