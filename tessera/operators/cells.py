"""Nearest neighbours through cells: an inverted file of vectors, stored as Parquet partitions.

k-means centres cut the space into cells. The vectors are stored below one folder for each cell, so that a search
reads the folders of the cells it probes and no others. Two ways to search:

* approximate: each query probes the cells whose centres are nearest. How many is measured when the index is built: for
  a bounded sample of stored vectors the exact neighbours are found, and the number is the least that reaches the recall
  asked for.
* exact: the k-th distance found in a few cells bounds the answer. A cell can't hold anything nearer if its centre is
  farther away than that by more than its radius; all others are probed. Euclidean only.

Centres are fitted on a bounded sample (``SAMPLE_PER_CELL`` rows a cell, by a hash of the key); every row is indexed. A cell
that holds a third of all rows is spread over as many files as its bytes need. Later rows are appended under the same
centres, and each append is one more version that the pointer file names.

Defined results: rows and queries without a vector play no part; ties go by key; no rows give an index with no cells
and searches without results; rows that repeat are rows of their own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Folder
from .batches import bounded_batches
from .knn import MOST_QUERIES, arrow_type, batch_top_k, ranked
from .vectors import Nearest, gaps, keys, matrix

#: Rows for each cell that the centres are fitted on; queries that the number of probes is measured with.
SAMPLE_PER_CELL, MEASURED = 64, 256
#: Bytes of centres that are sent to every task, at most.
MOST_CENTRE_BYTES = 256 << 20
#: Pairs of a query and a cell that a part of the queries has at most, and distances to centres that are held at once.
MOST_PAIRS, MOST_GAPS = 1 << 24, 1 << 20


def sampled(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """n rows by a hash of the key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(1)), key).limit(n)


def fit_centres(rows: DataFrame, cells: int, seed: int = 0, rounds: int = 12, vector: str = "vector", key: str = "id") -> np.ndarray:
    """At most ``cells`` centres, by Spark's k-means over a bounded sample."""
    held = sampled(rows.where(F.col(vector).isNotNull()).select(key, vector), cells * SAMPLE_PER_CELL, key)
    held = held.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if held.isEmpty():
        return np.empty((0, 0))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=rounds).fit(held)
    return np.unique(np.array(model.clusterCenters(), np.float64), axis=0)


def at_once(centres: np.ndarray) -> int:
    """Vectors that are held against all centres at once."""
    return max(16, min(1024, MOST_GAPS // max(1, len(centres))))


def with_cell(rows: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """The rows with a vector, with ``cell`` and the distance ``off`` (not squared) from its centre."""
    if centres.nbytes > MOST_CENTRE_BYTES:
        raise ValueError(f"{len(centres)} centres take more than {MOST_CENTRE_BYTES} bytes in every task: use fewer cells")
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # bounded above
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, cell int, off double"

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch[vector])
            gap, step = np.empty((len(x), 2)), at_once(shared.value)
            for a in range(0, len(x), step):
                near = gaps(x[a : a + step], shared.value, "l2")[0].argmin(1)
                gap[a : a + step, 0] = near
                gap[a : a + step, 1] = np.sqrt(((x[a : a + step] - shared.value[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gap[:, 0].astype(np.int32)), pa.array(gap[:, 1])], [*batch.schema.names, "cell", "off"])

    return rows.where(F.col(vector).isNotNull()).mapInArrow(of_task, schema)


class CellIndex:
    """An inverted file at a path of any file system that Spark opens."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.meta: dict = json.loads(self.folder.read("CURRENT") or "{}")
        self._centres: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, k: int = 10, recall: float = 0.95, seed: int = 0, key: str = "id", vector: str = "vector") -> CellIndex:
        """Indexes (key, vector). cells: the square root of the rows if not given."""
        rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
        if cells is None:
            cells = min(65_536, max(2, math.isqrt(rows.count())))
        self = cls(rows.sparkSession, path)
        centres = fit_centres(rows, cells, seed)
        self.meta = {"versions": [], "cells": len(centres), "dimensions": centres.shape[1], "id": rows.schema["id"].dataType.simpleString(), "vector": rows.schema["vector"].dataType.simpleString()}
        self._write_centres(centres)
        if len(centres):
            self._append(rows, centres)
            self.meta["probes"] = self._measured(rows, k, recall)
        self._commit()
        return self

    def _write_centres(self, centres: np.ndarray) -> None:
        held = [(i, c.tolist()) for i, c in enumerate(centres)]
        self.spark.createDataFrame(held, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/centres")

    def _commit(self) -> None:
        self.folder.write("CURRENT", json.dumps(self.meta))
        self._centres = None

    def _append(self, rows: DataFrame, centres: np.ndarray) -> None:
        version = max(self.meta["versions"], default=0) + 1
        top = f"{self.folder.path}/vectors/v={version}"
        with_cell(rows, centres).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(top)
        written = self.spark.read.parquet(top).groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n"))
        written.coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/sizes/v={version}")
        self.meta["versions"].append(version)

    def add(self, rows: DataFrame, key: str = "id", vector: str = "vector") -> None:
        """More rows, under the centres that are there."""
        if not self.meta.get("cells"):
            raise ValueError("an index without cells takes no rows: build it")
        self._append(rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")), self.centres()[0])
        self._commit()

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii by cell; a cell without rows has the radius -1."""
        if self._centres is None:
            held = self.spark.read.parquet(f"{self.folder.path}/centres").orderBy("cell").collect()  # as many as cells
            radii = np.full(len(held), -1.0)
            if self.meta["versions"]:
                for r in self._at("sizes").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
                    radii[r.cell] = r.radius
            self._centres = np.array([r.centre for r in held], np.float64).reshape(len(held), -1), radii
        return self._centres

    def _at(self, name: str) -> DataFrame:
        top = f"{self.folder.path}/{name}"
        return self.spark.read.option("basePath", top).parquet(*(f"{top}/v={v}" for v in self.meta["versions"]))

    def vectors(self) -> DataFrame:
        """(id, vector, cell) of all versions."""
        if not self.meta.get("versions"):
            return self.spark.createDataFrame([], f"id {self.meta.get('id', 'long')}, vector {self.meta.get('vector', 'array<float>')}, cell int")
        return self._at("vectors").select("id", "vector", "cell")

    def _measured(self, rows: DataFrame, k: int, recall: float) -> int:
        """How many cells a query must probe to find that share of its k exact neighbours: from the place of each neighbour's cell in the query's order of cells."""
        asked = sampled(rows, MEASURED)
        held = asked.collect()  # MEASURED rows
        truth = batch_top_k(rows, asked.withColumnRenamed("id", "query_id"), k).select("query_id", "id")
        cells = {}
        for r in truth.join(self.vectors().select("id", "cell"), "id").select("query_id", "cell").collect():  # k rows a query, more where ids repeat
            cells.setdefault(r.query_id, []).append(r.cell)
        order = gaps(np.array([r.vector for r in held], np.float64), self.centres()[0], "l2")[0].argsort(1).argsort(1)
        places = np.sort(np.concatenate([order[j, cells.get(r.id, [])] for j, r in enumerate(held)]))
        return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1

    def top_k(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, query_key: str = "query_id", vector: str = "vector") -> DataFrame:
        """(query_id, id, distance, rank, score) of the k nearest in the probed cells, or of all if exact. Queries are taken in parts of MOST_QUERIES, or fewer where cells are many."""
        kind = queries.schema[query_key].dataType.simpleString()
        empty = self.spark.createDataFrame([], f"query_id {kind}, id {self.meta['id']}, distance double")
        if not self.meta["cells"]:
            return ranked(empty, k)
        centres, radii = self.centres()
        asked, found = queries.where(F.col(vector).isNotNull()).select(query_key, vector).toLocalIterator(), empty
        while held := list(islice(asked, max(1, min(MOST_QUERIES, MOST_PAIRS // len(centres))))):
            names, q = [r[0] for r in held], np.array([r[1] for r in held], np.float64)
            chosen = self._nearest_cells(q, centres, radii, probes or self.meta["probes"])
            if exact:
                bound = self._bounds(names, q, queries.select(query_key), chosen, k)
                chosen, step = [], at_once(centres)
                for a in range(0, len(q), step):
                    chosen += [np.flatnonzero((radii >= 0) & (np.sqrt(np.maximum(g, 0)) - radii <= np.sqrt(b) * (1 + 1e-9) + 1e-9)).astype(np.int32) for g, b in zip(gaps(q[a : a + step], centres, "l2")[0], bound[a : a + step], strict=True)]
            found = found.unionByName(self._probed(names, q, queries.select(query_key), chosen, k))
        return ranked(found, k)

    @staticmethod
    def _nearest_cells(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, probes: int) -> list[np.ndarray]:
        chosen, step = [], at_once(centres)
        for a in range(0, len(q), step):
            gap = gaps(q[a : a + step], centres, "l2")[0]
            gap[:, radii < 0] = np.inf
            chosen += [order[: min(probes, int((radii >= 0).sum()))].astype(np.int32) for order in gap.argsort(1, kind="stable")]
        return chosen

    def _bounds(self, names: list, q: np.ndarray, asked: DataFrame, chosen: list[np.ndarray], k: int) -> np.ndarray:
        """The k-th distance that a few cells give; infinite where they hold fewer rows. One number a query of this part."""
        few = ranked(self._probed(names, q, asked, [c[: max(1, len(c) // 4)] for c in chosen], k), k)
        kth = {r.query_id: r.distance for r in few.where(F.col("rank") == k).select("query_id", "distance").collect()}
        return np.array([kth.get(name, np.inf) for name in names])

    def _probed(self, names: list, q: np.ndarray, asked: DataFrame, chosen: list[np.ndarray], k: int) -> DataFrame:
        """(query_id, id, distance): the k nearest of each task's rows for each query that probes their cell."""
        probing = np.zeros((1 + max((int(c.max()) for c in chosen if len(c)), default=0), len(chosen)), bool)  # bounded by MOST_PAIRS
        for j, cells in enumerate(chosen):
            probing[cells, j] = True
        rows = self.vectors().where(F.col("cell").isin(np.flatnonzero(probing.any(1)).tolist()))  # partitions of other cells aren't listed for the scan
        bounded_batches(self.spark)
        shared = self.spark.sparkContext.broadcast((names, q, np.packbits(probing, axis=1)))  # one bit a query and cell
        types = arrow_type(asked, asked.columns[0]), arrow_type(rows, "id")

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, bits = shared.value
            nearest = Nearest(q, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x, cell = keys(batch["id"]), matrix(batch["vector"]), batch["cell"].to_numpy()
                order = cell.argsort(kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    nearest.add(ids[part], x[part], np.flatnonzero(np.unpackbits(bits[cell[part[0]]], count=len(q))))
            for at, ids, gap in nearest.found():
                yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in at], types[0]), pa.array(ids.tolist(), types[1]), pa.array(gap)], ["query_id", "id", "distance"])

        return rows.mapInArrow(of_task, f"query_id {asked.schema[0].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query_id, id) pairs that were found."""
    hits = exact.select("query_id", "id").distinct().join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
