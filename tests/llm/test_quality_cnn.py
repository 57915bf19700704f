import random
import zlib

import numpy as np

from tablewright.llm import quality_cnn as m


def made(n, seed=0):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rnd.choice("etaoin") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
        good = rnd.random() < 0.6
        rows.append((i, " ".join(words) + "." if good else "!! ".join(words).upper(), int(good)))
    return rows


def naive(net, text):
    data = (text or "").encode() or b"\0"
    data += bytes(m.WIDTH - 1)
    acts = [sum(net.filters[j][data[p + j]] for j in range(m.WIDTH)) + net.bias for p in range(len(data) - m.WIDTH + 1)]
    blocks = [np.max(acts[i : i + m.STEP], axis=0) for i in range(0, len(acts), m.STEP)]
    chunks = [np.max(blocks[i : i + 2], axis=0) for i in range(max(1, len(blocks) - 1))]
    chunks = np.maximum(chunks, 0)
    z = net.offset + (net.weights * np.stack([chunks.mean(0), chunks.max(0), chunks.min(0)])).sum()
    return 1 / (1 + np.exp(-z))


def test_forward_pass_against_plain_loops(monkeypatch):
    monkeypatch.setattr(m, "PIECE", 2 * m.STEP)
    net = m.Network.fresh()
    for text in [None, "", "a", "é" * 100, "x" * m.STEP, "word " * 300]:
        assert abs(net.score(text) - naive(net, text)) < 1e-4


def test_gradient():
    net, data, h = m.Network.fresh(), m.as_bytes("some text " * 40), 1e-2
    grads = [np.zeros_like(p) for p in (net.filters, net.bias, net.weights, np.zeros(1, np.float32))]
    m._forward_backward(net, data, 1.0, grads)
    loss = lambda: -np.log(naive(net, "some text " * 40))
    for p, g, at in [(net.filters, grads[0], (2, ord("e"), 3)), (net.bias, grads[1], (5,)), (net.weights, grads[2], (1, 4))]:
        p[at] += h
        up = loss()
        p[at] -= 2 * h
        down = loss()
        p[at] += h
        assert abs((up - down) / (2 * h) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_query_learns_and_leaves_held_out_labels_alone(spark, monkeypatch):
    monkeypatch.setattr(m, "PASSES", 2)
    rows = made(200)
    docs = spark.createDataFrame([(d, t, "x", 1.5) for d, t, _ in rows] + [(None, None, None, None), (7, "", "y", 0.0)], "doc_id long, text string, score string, quality double").repartition(3)
    out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    labels = [(d, y, 0) for d, _, y in rows]
    flipped = [(d, 1 - y if out(d) else y, 0) for d, y, _ in labels] + [(None, 1, 0), (3, None, 0)]
    nets = [m.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    scored = [m.quality_scores(docs, n).collect() for n in nets]
    assert sorted(scored[0], key=str) == sorted(scored[1], key=str)
    assert len(scored[0]) == 202 and all(0 <= r.score <= 1 for r in scored[0])
    truth = {d: y for d, _, y in rows}
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in scored[0] if r.doc_id is not None and out(r.doc_id)]
    assert sum(held) >= 0.95 * len(held)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    net = m.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in m.quality_scores(docs, net).collect()] == [0.5, 0.5]
    assert m.quality_scores(docs.limit(0), net).count() == 0


def test_long_texts_and_the_bounds_of_the_sample(spark, monkeypatch):
    """Texts above TEXT_BYTES or beyond FIT_BYTES aren't sampled; the others count whole, each id once."""
    seen = []
    monkeypatch.setattr(m, "train", lambda rows, prior, **_: seen.append(rows) or m.Network.fresh())
    monkeypatch.setattr(m, "TEXT_BYTES", 5000)
    rows = [(d, t * 20 if d % 9 == 0 else t, y) for d, t, y in made(90)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")
    m.fit(docs, labels)
    out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    assert sorted(seen[0]) == sorted((t, y) for d, t, y in rows if d % 9 and not out(d))
    monkeypatch.setattr(m, "FIT_BYTES", 4000)
    m.fit(docs, labels)
    assert set(seen[1]) < set(seen[0]) and 0 < sum(len(t) for t, _ in seen[1]) <= 4000
    net = m.Network.fresh()
    long = "word and more. " * 20_000
    assert [r.score for r in m.quality_scores(spark.createDataFrame([(1, long)] * 2, "doc_id long, text string"), net).collect()] == [net.score(long)] * 2


def test_blocked_maxima(monkeypatch):
    net, data = m.Network.fresh(), m.as_bytes("some text " * 100)
    whole = m._maxima(net, data)
    monkeypatch.setattr(m, "PIECE", 2 * m.STEP)
    assert all((a == b).all() for a, b in zip(whole, m._maxima(net, data), strict=True))
