"""Each stage against plain Python on the rows that it gets."""

from collections import defaultdict

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, frame, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf_dir, tmp_path):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        have, rows = pairs(before), None
        if name != "best_fit_packing":
            assert after.columns == before.columns
            rows = sorted((i, t) for i, t in pairs(after))
        if name == "quality_rules":
            assert rows and all(not brute.op4_base(t)[-1] for _, t in rows)
            kept = {i for i, _ in rows}
            assert {i for i, t in have if not brute.op4_base(t)[-1] and i < 40} <= kept
        elif name == "line_dedup":
            left = [(i, t, u) for (i, u), t in zip(have, brute.op8_text(have), strict=True)]
            assert rows == sorted((i, t) for i, t, u in left if brute.WORDS.search(t) or t == u)
        elif name == "ngram_join":
            alone = {i for i, _, c in brute.op6(have, 5, 80) if i == c}
            assert rows == sorted((i, t) for i, t in have if i in alone)
        elif name == "suffix_dedup":
            want = sorted((i, [w for w, g in zip(brute.WORDS.findall(t or ""), gone) if not g]) for (i, t), gone in zip(have, brute.op2_gone(have)))
            assert sorted((i, brute.WORDS.findall(t)) for i, t in rows) == want
        else:
            lengths = defaultdict(int)
            for r in after.collect():
                lengths[r.sequence_id] += r.length
            assert {r.doc_id for r in after.collect()} == {i for i, _ in have} and max(lengths.values()) <= 4096
        before = after


def test_run_is_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns[:2] == ["doc_id", "piece"]
