import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, chunking, fulltext, neighbours, vectors

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("some", [None, np.arange(0, 1500, 7)])
def test_distances_are_held_by_tiles(monkeypatch, some):
    """F7, F8: however many queries and rows a batch brings."""
    rng, sizes, plain = np.random.default_rng(3), [], vectors.gaps
    monkeypatch.setattr(vectors, "gaps", lambda q, x, metric: sizes.append(len(q) * len(x)) or plain(q, x, metric))
    q, x = rng.normal(size=(1500, 4)), np.round(rng.normal(size=(9000, 4)), 1)
    nearest = vectors.Nearest(q, 3)
    nearest.add(np.arange(9000), x, some)
    assert max(sizes) <= 512 * 4096
    at, ids, gap = (np.concatenate(v) for v in zip(*nearest.found(), strict=True))
    for j in (0, 7, 511 // 7 * 7, 1400):
        true = ((x - q[j]) ** 2).sum(1)
        order = np.lexsort((np.arange(9000), vectors.exact(q[j], x, "l2")))[:3]
        assert ids[at == j].tolist() == order.tolist() and np.allclose(gap[at == j], true[order])


def test_probed_cells_travel_as_bits(spark, tmp_path, monkeypatch):
    """one bit a query and cell, also where every query probes every cell."""
    x = np.random.default_rng(5).normal(size=(400, 4))
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, vector array<double>")
    index = cells.CellIndex.build(rows, str(tmp_path / "cells"), cells=8, k=3)
    sent = []
    context = type(spark.sparkContext)
    plain = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    found = index.top_k(rows.withColumnRenamed("id", "query_id"), 3, probes=8, exact=True)
    bits = [v[2] for v in sent if isinstance(v, tuple) and len(v) == 3]
    assert bits and all(b.dtype == np.uint8 and b.nbytes <= 8 * 50 for b in bits)
    have = {(r.query_id, r["rank"]): r.id for r in found.collect()}
    for j in range(0, 400, 37):
        assert [have[j, k] for k in (1, 2, 3)] == np.argsort(((x - x[j]) ** 2).sum(1), kind="stable")[:3].tolist()
    assert all(cells.at_once(np.empty((n, 2))) * n <= cells.MOST_GAPS for n in (1, 1000, 65_536))


def test_wide_rows_come_in_bounded_batches(spark):
    """F4, F9, F10."""
    docs = spark.createDataFrame([(1, "a.py", "x = 1")], "id long, filePath string, text string")
    groups = spark.createDataFrame([], "members array<struct<node: long, vector: array<double>, fresh: boolean, bound: double>>")
    for make in (lambda: neighbours._offers(groups, 4), lambda: chunking.syntax_chunks(docs), lambda: fulltext.segments(docs, "id", "text")):
        spark.conf.unset(BOUND)
        make()
        assert int(spark.conf.get(BOUND)) <= 8 << 20


def test_texts_are_cut_by_bytes():
    """F10."""
    assert fulltext.cuts(np.array([5, 5, 1, 30, 2]), 10) == [(0, 2), (2, 1), (3, 1), (4, 1)]
    assert fulltext.cuts(np.zeros(5, int), 10, 2) == [(0, 2), (2, 2), (4, 1)] and fulltext.cuts(np.empty(0, int), 10) == []
