import random
import re

from tablewright.llm import license_scan as m


def plain(text):
    w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    found = []
    for t in m.TEMPLATES:
        key = list(m.cut(t.key))
        for i in range(len(w)):
            if w[i : i + len(key)] == key:
                start = i - t.key_at
                share = sum(0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(t.words)) / len(t.words)
                if share >= 0.5:
                    found.append((t, i, share))
    base = [i for t, i, _ in found if t.base]
    labels = lambda some: ",".join(sorted({t.label for t in some}))
    return len(w), len(base), min(base, default=None), max(base, default=None), labels(t for t, _, _ in found if t.base), labels(t for t, _, _ in found), max((s for *_, s in found), default=0.0)


def test_query_against_plain_search(spark):
    rnd = random.Random(3)
    words = sorted({w.decode() for t in m.TEMPLATES for w in t.words}) + ["é", "x"]
    texts = [None, "", " .", "CC-BY", "cc by cc by", "All RIGHTS\nreserved. all rights reserved", "the MIT license", "Released under the MIT License.", "apache license", "gnu General Public License", "cc " * 50 + "by", "x " * 20_000 + "licensed under CC BY-NC 4.0"]
    texts += [" ".join(rnd.choice(words) for _ in range(30)) + " " + rnd.choice(m.TEMPLATES).text + rnd.choice([" ", ", "]) + " ".join(rnd.choice(words) for _ in range(5)) for _ in range(150)]
    rows = [(i if i else None, t, "z") for i, t in enumerate(texts)] + [(4, texts[4], "z")]
    got = m.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *plain(t)) for i, t, _ in rows], key=str)
    assert m.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
