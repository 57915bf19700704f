import hashlib
import random
import re

import pytest

from tablewright.llm import decontaminate as m


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items):
    rows = []
    for doc_id, text in docs:
        w, hit, ids = cut(text), set(), set()
        for item_id, item in items:
            v = cut(item)
            k = min(10, len(v))
            for s in range(len(v) - k + 1) if v else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit.update(range(p, p + k))
                        ids |= {str(item_id)} - {"None"}
        rows.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


def planted():
    rnd = random.Random(4)
    vocabulary = ["Wa", "wb", "É", "x9", "the", "the", "the"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([10, 14, 30, 3, 1, 9, 11])]
    items += [(7, None), (8, " .!"), (9, "solo,two"), (None, "no id has this item"), (9, "solo two"), (10, "the " * 12)]
    docs = [(None, "a b"), (0, None), (1, ""), (2, "Solo -- TWO"), (3, items[2][1]), (3, items[1][1]), (4, "the " * 40), (4, "the " * 40), (5, "é X9 the")]
    for i in range(30):
        text = [rnd.choice(vocabulary) for _ in range(60)]
        text[20:20] = items[rnd.randrange(7)][1].split()[: rnd.randint(8, 14)]
        docs.append((10 + i, rnd.choice([" ", ", ", "\n"]).join(text)))
    return docs, items


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(m, "fits", lambda index: small)
    docs, items = planted()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, words string").repartition(3)
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    assert sorted(map(tuple, m.decontaminate(d, b).drop("print").collect()), key=str) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = planted()
    d = spark.createDataFrame(docs[:4], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert m.decontaminate(d.limit(0), b).count() == 0
    assert [r.n_hit for r in m.decontaminate(d, b.limit(0)).collect()] == [0] * 4


def test_shared_passage_is_indexed_once(spark):
    passage = " ".join(f"shared{i}" for i in range(10))
    items = [(i, f"own{i} {passage} end{i}") for i in range(40)]
    windows, classes = m.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    of = {" ".join(r.window): r.item_class for r in windows.collect()}
    assert len(of) == 1 + 2 * 40
    assert classes.where(classes.item_class == of[passage]).count() == 40
    docs = [(1, f"a b {passage} c"), (2, passage), (3, "long " * 200_000 + passage), (4, passage[1:])]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in m.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (10, 40), 2: (10, 40), 3: (10, 40), 4: (0, 0)}
