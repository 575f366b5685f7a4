"""Null ids, rows that repeat, one very long text and empty tables."""

from collections import Counter

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import media
from tessera.llm.bpe import bpe_round_trip
from tessera.llm.license_scan import license_scan
from tessera.llm.packing import best_fit_packing, packed
from tessera.llm.quality import judged

BYTES, WORDS = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids with equal and with null texts, repeated rows, and a text of 3 MB."""
    text, long = " ".join(f"word{k} and apache license" for k in range(60)), "A long word list, " * 180_000
    rows = [(None, text), (None, text), (None, None), (5, text), (5, text), (6, long), (7, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_maps_keep_null_ids(odd):
    rows, df = odd
    ids = Counter(i for i, _ in rows)
    for out in (media.texts_as_media(df), bpe_round_trip(df, BYTES), license_scan(df)):
        held = out.collect()
        assert Counter(r.doc_id for r in held) == ids
        one = [tuple(r)[1:] for r in held if r.doc_id == 5]
        assert one[0] == one[1] and sum(tuple(r)[1:] == one[0] for r in held if r.doc_id is None) == 2
    labels = license_scan(df).where("doc_id = 5").first()
    assert labels.labels == "apache" and (labels.n_base, labels.first_word) == (60, 2)


def test_quality_of_null_ids(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    held = judged(df, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.base_failed) for r in held) == Counter((i, brute.op4_base(t)[0], brute.op4_base(t)[-1]) for i, t in rows)
    assert len({r.score for r in held if r.n_words == 240}) == 1
    none = judged(df, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in none)


def test_packing_of_null_ids_and_a_long_text(odd):
    rows, df = odd
    held = best_fit_packing(df, WORDS).collect()
    assert Counter(r.doc_id for r in held if r.piece == 0) == Counter(i for i, _ in rows)
    spans = {}
    for r in held:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    long = sorted((r.piece, r.start, r.length) for r in held if r.doc_id == 6)
    assert [s for _, s, _ in long] == [4096 * k for k in range(len(long))] and all(n == 4096 for _, _, n in long[:-1])


def test_repeated_pieces_are_dealt_over_the_groups(spark, monkeypatch):
    """A hundred thousand equal rows are no group of their own."""
    from tessera.llm import packing

    monkeypatch.setattr(packing, "GROUP_ROWS", 10_000)
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    out = packed(rows)
    by_group = [r.n for r in out.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count("*").alias("n")).collect()]
    assert len(by_group) == 10 and max(by_group) < 12_000 and sum(by_group) == 100_000
    assert out.select("sequence_id").distinct().count() <= 100_000 // 40 + 10


def test_pipeline_of_an_empty_table_and_without_labels(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").collect() == []
    texts = [" ".join(f"w{k}x{j}" for j in range(80)) for k in range(4)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate([*texts, texts[0], None, ""])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()}) == [0, 1, 2, 3]
