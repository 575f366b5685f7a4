import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import cells, fulltext, knn, neighbours, quantize
from tessera.operators.cells import CellIndex, recall
from tessera.operators.fulltext import Postings, TextIndex, _Term, encoded, pack, score_segment, unpack
from tessera.operators.fusion import diversified, fused
from tessera.operators.quantize import Codebook, quantised_top_k
from tessera.operators.vectors import Nearest, exact, lloyd

VECTORS = "id long, vector array<float>"


def random_vectors(n, d=8, seed=0, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 2
    return (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * 0.4).astype(np.float32)


def frame_of(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row] if row is not None else None) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)], VECTORS).repartition(4)


def brute(x, ids, q, k):
    out = []
    for name, v in q:
        gap = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(row, v, strict=True)), int(i)) for i, row in zip(ids, x, strict=True) if row is not None)
        out += [(name, i, g, rank) for rank, (g, i) in enumerate(gap[:k], 1)]
    return out


def found_of(df):
    return sorted((r.query_id, r.id, r.distance, r.rank) for r in df.collect())


# ---- exact top k


def test_batch_takes_the_smallest_ids_of_many_copies(spark):
    rows = frame_of(spark, np.ones((100, 4)), range(99, -1, -1)).coalesce(1)
    asked = spark.createDataFrame([(7, [1.0] * 4)], "query_id long, vector array<float>")
    assert [r.id for r in knn.batch_top_k(rows, asked, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.id for r in knn.top_k(rows, [1.0] * 4, 3).orderBy("distance", "id").collect()] == [0, 1, 2]


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_batch_equals_single_with_copies_nulls_and_mirrored_ties(spark, metric):
    x = [*random_vectors(60, 4, 3), *([np.array([1, 0, 0, 0.0])] * 30), *([np.array([-1, 0, 0, 0.0])] * 30), *([None] * 10), np.zeros(4)]
    ids = list(range(len(x)))
    random.Random(1).shuffle(ids)
    rows = frame_of(spark, x, ids)
    asked = [(1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [0.3, 0.1, 0.0, 2.0]), (4, None)]
    batch = found_of(knn.batch_top_k(rows, spark.createDataFrame(asked, "query_id long, vector array<float>"), 25, metric))
    single = [(q, r.id, r.distance) for q, v in asked if v for r in knn.top_k(rows, [float(np.float32(a)) for a in v], 25, metric).orderBy("distance", "id").collect()]
    assert [(q, i, g) for q, i, g, _ in sorted(batch, key=lambda r: (r[0], r[3]))] == single


def test_string_keys_and_a_task_gives_k_rows(spark):
    rows = frame_of(spark, np.ones((50, 2))).select(F.concat(F.lit("k"), "id").alias("id"), "vector").coalesce(1)
    asked = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [0.0, 1.0])], "query_id string, vector array<float>")
    assert [r.id for r in knn.batch_top_k(rows, asked, 3).where("query_id = 'b'").orderBy("rank").collect()] == ["k0", "k1", "k10"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        near = knn._near(rows, [tuple(r) for r in asked.collect()], asked.select("query_id"), 3, "l2", "vector", "id", 1024)
        assert near.count() == 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-2, 2), st.integers(-2, 2)), min_size=1, max_size=60), st.integers(1, 5), st.integers(1, 9))
def test_running_top_k(points, k, step):
    x, ids = np.array(points, float), np.arange(len(points))[::-1]
    nearest = Nearest(np.array([[0.0, 0.0], [1.0, -1.0]]), k)
    for a in range(0, len(x), step):
        nearest.add(ids[a : a + step], x[a : a + step])
    at, found, gap = next(nearest.found())
    have = sorted(zip(at.tolist(), gap.tolist(), found.tolist(), strict=True))
    want = [(j, g, i) for j, q in enumerate(nearest.q) for g, i in sorted(zip(exact(q, x, "l2").tolist(), ids.tolist(), strict=True))[:k]]
    assert have == sorted(want)


# ---- cells


def test_cell_index(spark, tmp_path):
    x = random_vectors(3000, 8, 5, 40)
    x[2000:2900] = x[0]  # a third are copies
    rows = frame_of(spark, [*x, None])
    index = CellIndex.build(rows, f"{tmp_path}/cells", cells=40, recall=0.95)
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    truth = knn.batch_top_k(rows, asked, 10)
    assert found_of(index.top_k(asked, 10, exact=True)) == found_of(truth)
    assert index.meta["probes"] < len(index.centres()[0]) and recall(index.top_k(asked, 10), truth) >= 0.9
    assert recall(truth, truth) == 1.0 and index.vectors().count() == 3000
    again = CellIndex(spark, f"{tmp_path}/cells")
    assert found_of(again.top_k(asked, 10)) == found_of(index.top_k(asked, 10))


def test_cells_prune_files_and_take_more_rows(spark, tmp_path):
    x = random_vectors(800, 8, 6, 20)
    index = CellIndex.build(frame_of(spark, x[:600], range(600)), f"{tmp_path}/cells", cells=20)
    one = frame_of(spark, x[:1], [0]).withColumnRenamed("id", "query_id")
    few, names, q = index._probed([0], x[:1].astype(float), one.select("query_id"), [np.array([3, 4])], 5), [0], None
    assert len({f for f in index.vectors().where("cell IN (3, 4)").inputFiles()}) <= len(index.vectors().inputFiles())
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN \(3,4\)", plan)
    scanned = index.vectors().where("cell IN (3, 4)")
    assert {r.cell for r in scanned.select("cell").distinct().collect()} <= {3, 4}
    index.add(frame_of(spark, x[600:], range(600, 800)))
    asked = frame_of(spark, x[:40:5], range(0, 40, 5)).withColumnRenamed("id", "query_id")
    everything = frame_of(spark, x)
    assert found_of(CellIndex(spark, f"{tmp_path}/cells").top_k(asked, 10, exact=True)) == found_of(knn.batch_top_k(everything, asked, 10))


def test_cells_of_no_rows_and_of_few(spark, tmp_path, monkeypatch):
    none = spark.createDataFrame([(1, None)], VECTORS)
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    empty = CellIndex.build(none, f"{tmp_path}/none")
    assert empty.top_k(asked, 5).collect() == []
    with pytest.raises(ValueError):
        empty.add(frame_of(spark, np.ones((1, 2))))
    few = CellIndex.build(frame_of(spark, np.ones((3, 2))), f"{tmp_path}/few")
    assert found_of(few.top_k(asked, 5, exact=True)) == [(1, k, 2.0, k + 1) for k in range(3)] == found_of(few.top_k(asked, 5))
    monkeypatch.setattr(cells, "MOST_QUERIES", 2)
    many = frame_of(spark, np.ones((5, 2))).withColumnRenamed("id", "query_id")
    assert few.top_k(many, 1).count() == 5
    monkeypatch.setattr(cells, "MOST_CENTRE_BYTES", 1)
    with pytest.raises(ValueError):
        few.add(frame_of(spark, np.ones((1, 2))))


# ---- codes


def test_quantised_search(spark):
    x = random_vectors(2000, 8, 7, 30)
    rows = frame_of(spark, [*x, None])
    book = Codebook.fit(rows, 4)
    codes = book.encode(rows)
    assert codes.count() == 2000 and {len(r.code) for r in codes.collect()} == {4}  # 4 bytes instead of 32
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    found, truth = quantised_top_k(rows, codes, book, asked, 10), knn.batch_top_k(rows, asked, 10)
    assert recall(found, truth) >= 0.9
    true = {(r.query_id, r.id): r.distance for r in truth.collect()}
    assert all(r.distance == true.get((r.query_id, r.id), r.distance) for r in found.collect())
    # with candidates for all rows the result is exact
    assert found_of(quantised_top_k(rows, codes, book, asked, 10, oversample=200)) == found_of(truth)


def test_candidates_are_the_nearest_codes(spark, monkeypatch):
    x = random_vectors(300, 4, 8)
    rows = frame_of(spark, x)
    book = Codebook([lloyd(x[:, p : p + 2].astype(float), 8) for p in (0, 2)])
    codes = book.encode(rows)
    monkeypatch.setattr(quantize, "MOST_TABLES", 3)
    asked = rows.where("id < 7").withColumnRenamed("id", "query_id")
    near = {(r.query_id, r.id) for r in quantize.candidates(codes, book, asked, 5).collect()}
    decoded = {r.id: np.concatenate([book.centres[p][c] for p, c in enumerate(r.code)]) for r in codes.collect()}
    for q in range(7):
        gap = sorted((round(float(((x[q] - v) ** 2).sum()), 9), i) for i, v in decoded.items())
        last = gap[4][0]
        mine = {i for a, i in near if a == q}
        assert len(mine) == 5 and all(g <= last + 1e-6 for g, i in gap if i in mine)


def test_codes_of_no_rows_and_odd_parts(spark):
    none = spark.createDataFrame([(1, None)], VECTORS)
    book = Codebook.fit(none, 2)
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<float>")
    assert quantised_top_k(none, spark.createDataFrame([], "id long, code binary"), book, asked, 3).collect() == []
    with pytest.raises(ValueError):
        Codebook.fit(frame_of(spark, np.ones((2, 5))), 2)


# ---- neighbour graph


def test_graph_recall_and_copies(spark, monkeypatch):
    x = random_vectors(1200, 8, 9, 15)
    x[400:800] = x[3]
    rows = frame_of(spark, [*x, None])
    nodes, members = neighbours.classes(rows)
    assert nodes.count() == 800 and members.count() == 1200
    assert {r.node for r in members.where("id BETWEEN 400 AND 799 OR id = 3").collect()} == {3}
    edges = neighbours.graph(nodes, width=10)
    truth = knn.batch_top_k(nodes.withColumnRenamed("node", "id"), nodes.withColumnRenamed("node", "query_id"), 11).where("query_id <> id")
    have = edges.select(F.col("node").alias("query_id"), F.col("neighbour").alias("id"))
    assert recall(have, truth.where("rank <= 11")) >= 0.9
    assert edges.groupBy("node").count().where("count <> 10").isEmpty()
    assert edges.where("node = neighbour").isEmpty()
    true = {(r.query_id, r.id): r.distance for r in truth.collect()}
    assert all(abs(r.distance - true.get((r.node, r.neighbour), r.distance)) < 1e-12 for r in edges.collect())


def test_graph_of_few_nodes(spark):
    nodes, _ = neighbours.classes(frame_of(spark, [[0.0], [1.0], [5.0], [1.0], None]))
    have = sorted((r.node, r.neighbour, r.distance, r["rank"]) for r in neighbours.graph(nodes, width=4).collect())
    assert have == [(0, 1, 1.0, 1), (0, 2, 25.0, 2), (1, 0, 1.0, 1), (1, 2, 16.0, 2), (2, 0, 25.0, 2), (2, 1, 16.0, 1)]
    nodes, members = neighbours.classes(spark.createDataFrame([(1, None)], VECTORS))
    assert neighbours.graph(nodes).collect() == [] and members.collect() == []


# ---- full text


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x5E\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bm25(docs, asked, k):
    held = [(i, words(t)) for i, t in docs]
    n, mean = len(held), sum(len(w) for _, w in held) / len(held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for q, text in asked:
        scores = []
        for i, w in held:
            tf = Counter(w)
            terms = [t for t in set(words(text)) if tf[t]]
            if terms:
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms)
                scores.append((-round(s, 9), i is None, i or 0, i))
        out += [(q, i, round(-s, 6), rank) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Größe", "naïve", "x_1"]
    text = lambda: rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.choice([3, 20, 200])))
    rows = [(k, text()) for k in range(n)]
    rows += [(n + k, rows[k][1].upper()) for k in range(40)] + [(9001, None), (9002, ""), (9003, "..."), (9004, "w0 " * 5000), (9004, "w0 " * 5000), (None, rows[5][1])]
    return rows


ASKED = [(0, "w1 W2, w2 w299"), (1, "größe"), (2, "Größe w0 nothing_like_it"), (3, "nothing_like_it"), (4, ""), (5, None), (6, " ".join(f"w{k}" for k in range(60)))]


@pytest.mark.parametrize("segment, block", [(65_536, 128), (50, 4)])
def test_bm25_against_brute_force(spark, tmp_path, monkeypatch, segment, block):
    monkeypatch.setattr(fulltext, "SEGMENT_WORDS", segment * 20)
    monkeypatch.setattr(fulltext, "BLOCK", block)
    docs = corpus()
    index = TextIndex.build(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(3), f"{tmp_path}/text", "doc_id")
    assert index.size()[0] == len(docs)
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    found = sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in index.top_k(asked, 10).collect())
    assert found == sorted((q, rank, i, s) for q, i, s, rank in bm25(docs, ASKED, 10))
    df = Counter(t for _, text in docs for t in set(words(text)))
    assert {r.term: r.df for r in index.terms().collect()} == df


def test_text_index_takes_more_documents(spark, tmp_path, monkeypatch):
    docs = corpus(100)
    schema = "id long, text string"
    index = TextIndex.build(spark.createDataFrame(docs[:60], schema), f"{tmp_path}/text")
    index.add(spark.createDataFrame(docs[60:], schema))
    monkeypatch.setattr(fulltext, "MOST_QUERIES", 3)
    again = TextIndex(spark, f"{tmp_path}/text")
    found = sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in again.top_k(spark.createDataFrame(ASKED, "query_id long, text string"), 5).collect())
    assert found == sorted((q, rank, i, s) for q, i, s, rank in bm25(docs, ASKED, 5))


def test_phrases(spark, tmp_path):
    docs = [(1, "the cat sat on the cat sat"), (2, "sat the cat"), (3, "cat. SAT\non the mat"), (4, None), (5, "a a a a"), (6, "the cat sat" + " filler" * 70000 + " the cat sat on")]
    index = TextIndex.build(spark.createDataFrame(docs, "id long, text string").repartition(2), f"{tmp_path}/text")
    asked = [(0, "Cat sat"), (1, "the cat sat on"), (2, "a a"), (3, "mat the"), (4, "unknown cat"), (5, ""), (6, "on"), (7, "filler the cat")]
    found = {(r.query_id, r.id): r.places for r in index.phrase(spark.createDataFrame(asked, "query_id long, text string")).collect()}
    want = {}
    for q, text in asked:
        p = words(text)
        for i, t in docs:
            w = words(t)
            n = sum(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)) if p else 0
            if n:
                want[q, i] = n
    assert found == want


def test_text_index_of_no_documents(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/text")
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    assert index.top_k(asked, 3).collect() == [] and index.phrase(asked).collect() == [] and index.size() == (0, 0.0)


def test_phrase_reads_positions_and_scoring_skips_blocks():
    rng = np.random.default_rng(1)
    lengths = rng.integers(10, 200, 20_000)
    rare, often = np.sort(rng.choice(20_000, 30, replace=False)), np.arange(20_000)
    heads, blocks = encoded(np.repeat([0, 1], [30, 20_000]), np.concatenate([rare, often]), np.concatenate([np.full(30, 2), rng.integers(1, 4, 20_000)]), lengths)
    held = [_Term(Postings(h, b), w) for h, b, w in zip(heads.to_pylist(), blocks.to_pylist(), (6.0, 0.1), strict=True)]
    every, score = score_segment(held, lengths, 100.0, -np.inf)
    assert len(every) == 20_000
    floor = np.sort(score)[-10]
    seen = {}
    docs, some = score_segment(held, lengths, 100.0, floor, seen)
    want = {d: s for d, s in zip(every, score, strict=True) if s >= floor}
    assert {d: s for d, s in zip(docs, some, strict=True) if s >= floor} == want
    assert seen["skipped"] > 100 and seen["blocks"] < 40
    assert len(score_segment(held, lengths, 100.0, 1e9)[0]) == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 35) - 1), max_size=50))
def test_packing_of_numbers(values):
    data, ends = pack(np.array(values, np.int64))
    assert unpack(data.tobytes()).tolist() == values and len(data) <= 5 * len(values)
    assert [unpack(data[a:b].tobytes()).tolist() for a, b in zip([0, *ends[:-1]], ends)] == [[v] for v in values]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 100_000), min_size=1, max_size=400, unique=True), min_size=1, max_size=5), st.randoms())
def test_postings_round_trip(terms, rng):
    docs = [np.sort(np.array(d)) for d in terms]
    tf = [np.array([rng.choice([1, 2, 300, 70_000]) for _ in d]) for d in docs]
    lengths = np.arange(100_001) % 977
    heads, blocks = encoded(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs), np.concatenate(tf), lengths)
    for h, b, d, f in zip(heads.to_pylist(), blocks.to_pylist(), docs, tf, strict=True):
        held = Postings(h, b)
        assert [x.tolist() for x in held.whole()] == [d.tolist(), f.tolist()]
        some = np.array(sorted(rng.sample(range(len(held.heads)), rng.randint(1, len(held.heads)))))
        want = [k for k in range(len(d)) if k // fulltext.BLOCK in some]
        assert [x.tolist() for x in held.some(some)] == [d[want].tolist(), f[want].tolist()]
        assert held.heads[0, 3] == lengths[d[: fulltext.BLOCK]].min() and held.heads[-1, 1] == d[-1]


# ---- fusion


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    found = [tuple(r) for r in fused([a, b], 2).orderBy("query_id", "rank").collect()]
    assert found == [(1, 11, round(1 / 62 + 1 / 61, 12), 1), (1, 10, round(1 / 61, 12), 2), (2, 10, round(1 / 61, 12), 1)]
    weighted = fused([a, b], 3, [0.0, 2.0]).where("query_id = 1").orderBy("rank").collect()
    assert [r.id for r in weighted] == [11, 12, 10]
    assert fused([a.limit(0), b.limit(0)], 3).collect() == []


def brute_diverse(rows, k, trade):
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    unit = [np.array(v) / np.linalg.norm(v) if v is not None and np.linalg.norm(v) else np.zeros(2) for _, _, v in rows]
    chosen, top = [], rows[0][1]
    while len(chosen) < min(k, len(rows)):
        best = max((j for j in range(len(rows)) if j not in chosen), key=lambda j: (round(trade * rows[j][1] / top - (1 - trade) * max((float(unit[j] @ unit[c]) for c in chosen), default=0.0), 12), -j))
        chosen.append(best)
    return [rows[j][0] for j in chosen]


def test_diversity(spark):
    rng = random.Random(3)
    rows = [(q, i, round(rng.random(), 3), rng.choice([None, [1.0, 0.0], [0.0, 0.0], [rng.random(), rng.random()]])) for q in range(3) for i in range(30)]
    found = diversified(spark.createDataFrame(rows, "query_id long, id long, score double, vector array<float>"), 8, 0.6)
    for q in range(3):
        mine = [(i, s, None if v is None else [float(np.float32(a)) for a in v]) for a, i, s, v in rows if a == q]
        assert [r.id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == brute_diverse(mine, 8, 0.6)


def test_words_of_texts():
    assert [[w for w in ws if w] for ws in fulltext.words_of(pa.array(["A b_c-D é1", None, ""])).to_pylist()] == [["a", "b_c", "d", "é1"], [], []]
