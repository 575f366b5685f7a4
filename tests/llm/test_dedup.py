import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.blocks import Run
from tessera.llm.components import connected_components
from tessera.llm.line_dedup import PerfectHash, Shard, line_dedup
from tessera.llm.ngram_join import ngram_join, one_of_each, overlaps, size_class
from tessera.llm.substring_dedup import batched_dedup, compact, index_of, substring_dedup
from tessera.llm.suffix_dedup import anchors, cut, repeated_passages, suffix_dedup


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_substring_dedup(frame, docs):
    assert got(substring_dedup(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op3(docs))


def test_line_dedup(frame, docs):
    assert got(line_dedup(frame), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.op8(docs))


def test_line_dedup_keeps_columns(frame, docs):
    out = line_dedup(frame, documents_out=True)
    assert out.columns == frame.columns
    assert sorted((r.doc_id, brute.sha(r.text)) for r in out.collect()) == sorted((i, s) for i, _, _, s in brute.op8(docs))
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    assert sorted(r.chunk for r in out.collect()) == sorted(r.chunk for r in frame.collect())


def test_line_dedup_drops_the_emptied(spark):
    rows = [(1, "this is a long line"), (2, "this is a long line\n  THIS is a long line \n"), (3, ""), (4, None), (5, "this is a long line\nother"), (6, "\n\n")]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), documents_out=True, drop_emptied=True)
    assert got(out, "doc_id", "text") == [(1, "this is a long line"), (3, ""), (4, ""), (5, "other"), (6, "\n\n")]


@pytest.mark.parametrize("window, depth", [(50, 20), (10, 4), (5, 5)])
def test_suffix_dedup(frame, docs, window, depth):
    want = [(i, sum(g)) for (i, _), g in zip(docs, brute.op2_gone(docs, window), strict=True)]
    spans = got(repeated_passages(frame, window, depth), "doc_id", "start_word", "end_word", "n_words")
    have = {}
    for i, a, b, n in spans:
        assert window <= b - a <= n
        have[i] = have.get(i, 0) + b - a
    assert have == {i: n for i, n in want if n}


def test_suffix_dedup_texts(frame, docs):
    out = {r.doc_id: r.text for r in suffix_dedup(frame).collect()}
    for (i, t), gone in zip(docs, brute.op2_gone(docs), strict=True):
        kept = [w for w, g in zip(brute.WORDS.findall(t or ""), gone, strict=True) if not g]
        assert brute.WORDS.findall(out[i] or "") == kept
        if not any(gone):
            assert out[i] == (t or "")


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(frame, docs, size, percent):
    assert got(ngram_join(frame, size, percent), "doc_id", "n_shingles", "component_id") == sorted(brute.op6(docs, size, percent))


def test_one_of_each(frame, docs):
    out = one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in brute.op6(docs, 5, 80) if c == i)


def test_hot_group_in_blocks(spark, monkeypatch):
    """A group larger than a block: pairs of blocks find all links."""
    from tessera.llm import ngram_join as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 8)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:j] + [f"n{k}"] + base[j + 1 :])) for k, j in enumerate(list(range(60)) + list(range(40)))] + [(200, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join(df, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(brute.op6(rows, 3, 90))


@pytest.mark.parametrize("percent, step", [(90, 10), (80, 5), (50, 2), (100, 3)])
def test_size_classes(spark, monkeypatch, percent, step):
    """Sets at the very bound of their sizes, in classes and in blocks cut by bytes: none is parted from its partners."""
    from tessera.llm import ngram_join as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 4)
    monkeypatch.setattr(m, "BLOCK_BYTES", 2000)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[: 20 + k * step])) for k in range(30)]
    rows += [(100 + k, " ".join(words[: 100 * percent // 100 * (k + 1) // 2])) for k in range(6)] + [(200 + k, " ".join(words[: 50 * (k + 1)])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join(df, 1, percent), "doc_id", "n_shingles", "component_id") == sorted(brute.op6(rows, 1, percent))


def test_size_classes_hold_all_sizes_that_link(spark):
    for percent in (50, 80, 90, 99):
        n = spark.range(1, 3000).select(F.col("id").alias("large"), F.ceil(F.col("id") * percent / 100).alias("small"))
        gap = size_class(F.col("large"), percent) - size_class(F.col("small"), percent)
        assert n.where(gap > 1).count() == 0


def test_empty_tables(empty):
    for df in (substring_dedup(empty), line_dedup(empty), line_dedup(empty, documents_out=True), repeated_passages(empty), suffix_dedup(empty), ngram_join(empty), one_of_each(empty)):
        assert df.count() == 0


def test_null_ids(no_ids):
    assert sorted((r.doc_id is None, r.n_removed) for r in substring_dedup(no_ids).collect()) == [(False, 0), (False, 0), (True, 0), (True, 80), (True, 80)]
    assert sorted((r.doc_id is None, r.n_dropped) for r in line_dedup(no_ids).collect()) == [(False, 0), (False, 0), (True, 0), (True, 1), (True, 1)]
    assert [(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(no_ids).collect()] == [(None, 0, 80)] * 2
    assert {(r.doc_id, r.component_id) for r in ngram_join(no_ids).collect()} == {(None, None), (5, 5), (6, 6)}
    assert one_of_each(no_ids).count() == 5


def test_history(frame, docs, spark):
    """A batch against a compacted index of earlier ones equals all at once."""
    low, high = frame.where("doc_id < 70"), frame.where("doc_id >= 70")
    history = compact(index_of(low, buckets=16))
    again = substring_dedup(high, history=history, buckets=16)
    assert got(again, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(r for r in brute.op3(docs) if r[0] >= 70)


def test_history_of_other_sizes(frame, docs, tmp_path):
    """Batches that chose other numbers of buckets still meet; another window is an error."""
    low, mid, high = frame.where("doc_id < 45"), frame.where("doc_id >= 45 AND doc_id < 70"), frame.where("doc_id >= 70")
    index_of(low, buckets=3).unionByName(index_of(mid, buckets=7)).write.parquet(str(tmp_path / "runs"))
    stored = frame.sparkSession.read.parquet(str(tmp_path / "runs"))
    want = sorted(r for r in brute.op3(docs) if r[0] >= 70)
    for history in (stored, compact(stored)):
        for buckets in (None, 5):
            assert got(substring_dedup(high, history=history, buckets=buckets), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    with pytest.raises(ValueError):
        substring_dedup(high, window=9, history=stored)


def test_coarse_level(spark, frame, docs, monkeypatch):
    """Runs joined before they are cut finely give the same answers, and history too."""
    monkeypatch.setattr(blocks, "MOST_BLOCKS", 1)
    assert blocks.chunked(frame, counts=(8, 16))[2].finer == 4
    monkeypatch.setattr(blocks, "sizes", lambda df, **_: (8, 16))
    four = "doc_id", "n_words", "n_removed", "kept_sha256"
    assert got(substring_dedup(frame), *four) == sorted(brute.op3(docs))
    assert got(substring_dedup(frame.where("doc_id >= 70"), history=compact(index_of(frame.where("doc_id < 70")))), *four) == sorted(r for r in brute.op3(docs) if r[0] >= 70)
    assert got(line_dedup(frame), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.op8(docs))
    assert got(ngram_join(frame, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(brute.op6(docs, 3, 90))
    have = {}
    for i, a, b in got(repeated_passages(frame), "doc_id", "start_word", "end_word"):
        have[i] = have.get(i, 0) + b - a
    assert have == {i: sum(g) for (i, _), g in zip(docs, brute.op2_gone(docs), strict=True) if any(g)}


def test_blocks_grow_less_than_squared():
    def count(chunks):
        buckets = blocks.Buckets.of(chunks, chunks // 4, blocks.MOST_BLOCKS)
        assert buckets * buckets.finer >= chunks // 4
        return chunks * buckets + -(-chunks // buckets) * buckets * buckets.finer if buckets.finer > 1 else chunks * buckets

    assert count(1000) == 250_000 and count(400_000) < 4e8 and count(400_000) / count(100_000) < 4**1.55


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_batches_equal_one(frame, docs, batches):
    assert got(batched_dedup(frame, batches=batches), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op3(docs))


def test_batches_of_few_ids(empty, no_ids):
    assert batched_dedup(empty).count() == 0
    assert sorted((r.doc_id is None, r.n_removed) for r in batched_dedup(no_ids).collect()) == [(False, 0), (False, 0), (True, 0), (True, 80), (True, 80)]
    assert batched_dedup(no_ids.where("doc_id IS NULL")).count() == 3


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 9))
def test_runs_travel_whole(keys, buckets):
    values = np.array(keys, np.uint64)
    run = Run.merged(values, np.arange(len(keys)) % 3 + 2**40)
    parts = [Run.unpack(run.pack(part)) for _, part in run.cut(buckets)]
    assert np.array_equal(np.concatenate([np.empty(0, np.uint64), *(p.keys for p in parts)]), run.keys)
    assert np.array_equal(np.concatenate([np.empty(0, np.int64), *(p.ids for p in parts)]), run.ids)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    values = np.array(sorted(keys), np.uint64)
    assert sorted(PerfectHash(values)(values).tolist()) == list(range(len(values)))


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_shards_reject_foreign_keys(keys, others):
    own, asked = np.array(sorted(keys), np.uint64), np.array(sorted(keys | others), np.uint64)
    got = Shard([Run(own, np.full(len(own), 5))]).probe(Run(asked, np.full(len(asked), 7)))
    known = {k & 0xFFFFFFFF for k in keys}
    assert all(g == (k in keys) for k, g in zip(asked.tolist(), got.tolist(), strict=True) if k in keys or k & 0xFFFFFFFF not in known)


def test_one_id_travels_once():
    run = Run(np.arange(5, dtype=np.uint64) << np.uint64(20), np.full(5, -(2**63)))
    back = Run.unpack(run.pack(slice(None)))
    assert back.ids.tolist() == run.ids.tolist() and back.keys.tolist() == run.keys.tolist()


@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 12))
def test_anchors(values, spread):
    v = np.array(values, np.uint64)
    assert anchors(v, spread).tolist() == [k + int(np.argmin(v[k : k + spread])) for k in range(len(v) - spread + 1)]


def test_cut_keeps_white_space():
    assert cut(b" a  b\tc\nd ", np.array([False, True, True, False])) == b" a  d "
    assert cut(b"a b", np.array([True, True])) == b""


@settings(max_examples=40)
@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=30), st.integers(0, 30))
def test_overlaps(sets, split):
    rows = [np.array(sorted(s), np.uint64) for s in sets]
    whole = [[len(a & b) for b in sets] for a in sets]
    split = min(split, len(rows))
    assert overlaps(rows[:split], rows[split:]).tolist() == [row[split:] for row in whole[:split]]


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 105), (105, 101), (200, 200)] + [(500, k) for k in range(501, 540)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{k: 0 for k in range(1, 31)}, 105: 100, 101: 100, **{k: 500 for k in range(501, 540)}}


def test_text_is_shuffled_once(frame):
    out = substring_dedup(frame)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    assert blocks.chunked(frame)[0].columns == ["chunk", "doc_id", "text"]
