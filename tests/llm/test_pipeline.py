import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as p  # noqa: E402

from tablewright.llm import common, mixing, quality_cnn, simhash  # noqa: E402


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 8 == 1)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = []
    for i in range(40):
        words = [f"w{(i * 37 + j * j) % 997}" for j in range(60)]
        rows.append((i, ("!! ".join(words).upper() if i % 4 == 0 else " ".join(words)) + (" vile" * 5 if i % 8 == 1 else ""), "en", "s", 1))
    rows += [(50, rows[5][1], "en", "s", 1), (51, "x " + " ".join(f"bench{i}" for i in range(12)), "en", "s", 1), (None, "no id", "en", None, None), (60, None, None, "s", 0)]
    rows += [(7, rows[7][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, score string, _print string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(quality_cnn, "PASSES", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.collect()

    kept = p.quality(spark, docs, sf_dir)
    assert kept.columns == columns
    net = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in rows if net.score(r.text) >= 0.5)

    single = p.near_duplicates(spark, docs, sf_dir)
    assert single.columns == columns
    fps, want = {}, []
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        fp = simhash.fingerprint(r.text)
        if not any(((fp ^ f) & (1 << 64) - 1).bit_count() <= 3 for f in fps):
            fps[fp] = r
            want.append(str(r))
    assert sorted(map(str, single.collect())) == sorted(want)

    clean = p.decontamination(spark, docs, sf_dir)
    assert clean.columns == columns and sorted(map(str, clean.collect())) == sorted(str(r) for r in rows if r.doc_id != 51)

    mixed = p.mix(spark, docs, sf_dir)
    rated = mixing.mix(docs, mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), mixing.TARGETS).collect()
    assert mixed.columns == columns and mixed.count() == sum(r.alike * r.copies for r in rated)
    assert set(map(str, mixed.collect())) <= set(map(str, rows))

    assert p.tokens(spark, docs, sf_dir).count() == len(rows)


def test_run_and_empty(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(quality_cnn, "PASSES", 1)
    before = len(common.WRITTEN)
    out = p.run(spark, sf_dir)
    (left,) = common.WRITTEN[before:]
    assert [f.split("/")[-2] for f in out.inputFiles()][:1] == [left.split("/")[-1]]
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_null_ids_alone_and_long_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(quality_cnn, "PASSES", 1)
    rows = [(None, None), (None, ""), (None, "same text here"), (None, "same text here"), (None, " ".join(f"w{i % 5003}" for i in range(60_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert p.near_duplicates(spark, docs, sf_dir).count() == 3
    assert p.decontamination(spark, docs, sf_dir).count() == len(rows)
    assert p.quality(spark, docs, sf_dir).columns == p.mix(spark, docs, sf_dir).columns == docs.columns
    assert sorted(r.n_tokens for r in p.tokens(spark, docs, sf_dir).collect())[:2] == [1, 1]


def test_names():
    assert [len(s) for s in p.STAGES] == [2] * 5 and all(re.fullmatch(r"[\w -]+", n) for n, _ in p.STAGES)
