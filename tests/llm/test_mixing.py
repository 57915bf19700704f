import math
import random

import pytest

from tablewright.llm import mixing as m


def made(n=300):
    rnd, rows = random.Random(1), []
    kinds = {"a": ["red", "rose", "fire"], "b": ["sea!!", "sky!!"], "c": ["leaf", "moss"]}
    for i in range(n):
        k = rnd.choice("aaaabbc")
        words = [rnd.choice(kinds[k]) if rnd.random() < 0.3 else "w%d" % rnd.randrange(50) for _ in range(rnd.randint(20, 80))]
        rows.append((i, " ".join(words), k))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, 2.0) for d, t, _ in rows], "doc_id long, text string, domain int, n_tokens double").repartition(3)
    return docs, spark.createDataFrame([(d, k) for d, _, k in rows if d is not None and d % 2], "doc_id long, domain string")


TARGETS = {"a": 0.2, "b": 0.3, "c": 0.5}


def test_posteriors_against_plain_bayes_and_truth(spark):
    rows = made()
    docs, labelled = frames(spark, rows)
    model, other, priors = m.fit(docs, labelled, ("a", "b", "c"))
    got = {r.doc_id: [r.p0, r.p1, r.p2] for r in m.posteriors(docs, model, other, priors).collect()}
    assert sum("abc"[got[d].index(max(got[d]))] == k for d, _, k in rows if d % 2 == 0) > 0.95 * len(rows) / 2
    weights = {r.bucket: [r.w0, r.w1, r.w2] for r in model.collect()}
    buckets = {r.word: r.b for r in spark.createDataFrame([(w,) for w in {w for _, t, _ in rows for w in t.split()}], "word string").select("word", m._bucket(m.F.col("word")).alias("b")).collect()}
    for d, text, _ in rows[:40]:
        w = [weights.get(buckets[x], other) for x in text.split()]
        z = [p + sum(x[i] for x in w) / m.SCALE / len(w) ** 0.25 for i, p in enumerate(priors)]
        e = [math.exp(x - max(z)) for x in z]
        assert got[d] == pytest.approx([x / sum(e) for x in e], abs=2e-6)


def test_rates_meet_the_targets(spark):
    docs, labelled = frames(spark, made())
    got = m.mix(docs, labelled, TARGETS).collect()
    total = sum(r.n_tokens for r in got)
    for k, t in TARGETS.items():
        assert sum(r.n_tokens * r.rate * r[f"p_{k}"] for r in got) / total == pytest.approx(t, abs=1e-3)
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    assert sum(r.copies for r in got) == pytest.approx(sum(r.rate for r in got), rel=0.15)


def test_rates_against_reference_projection(spark):
    """Targets that no rates reach: the residual must not be improved by any single document's rate."""
    rows = [(i, 0, 1, 10 + i, 0.6, 0.4) for i in range(5)] + [(9, 0, 2, 30, 0.8, 0.2)]
    members = spark.createDataFrame(rows, "doc_id long, print long, copies long, n_tokens long, p0 double, p1 double")
    rate, shares = m.rates(members, [0.1, 0.9])
    r = {x.doc_id: x.r for x in members.select("doc_id", rate.alias("r")).collect()}
    total = sum(x[2] * x[3] for x in rows)
    residual = [sum(x[2] * x[3] * r[x[0]] * x[4 + k] for x in rows) / total - (0.1, 0.9)[k] for k in (0, 1)]
    for x in rows:
        slope = x[4] * residual[0] + x[5] * residual[1]
        assert slope > -1e-3 and (r[x[0]] == 0 or abs(slope) < 1e-3)
    assert shares == pytest.approx([v + t for v, t in zip(residual, (0.1, 0.9))], abs=1e-6)


def test_odd_rows_and_empty_tables(spark):
    rows = made(60) + [(None, "red rose", "a"), (None, None, "a"), (3, "", "b"), (500, None, "b")] + [(700, "moss leaf", "c")] * 3
    docs, labelled = frames(spark, rows)
    labelled = labelled.union(spark.createDataFrame([(None, "a"), (5, None), (7, "other")], "doc_id long, domain string"))
    got = m.mix(docs, labelled, TARGETS).collect()
    assert sum(r.alike for r in got) == len(rows) and len({(r.doc_id, r.print) for r in got}) == len(got)
    assert next(r.alike for r in got if r.doc_id == 700) == 3 and next(r.n_tokens for r in got if r.doc_id == 500) == 0
    assert m.mix(docs.limit(0), labelled, TARGETS).count() == 0
    assert m.mix(docs, labelled.limit(0), TARGETS).count() == len(got)
