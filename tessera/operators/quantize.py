"""Product quantisation: vectors as a few bytes each, searched by table lookups, the best candidates ranked again exactly.

A vector is cut into parts of equal length. Each part's centres (at most 256) are fitted by k-means on a bounded sample
(``SAMPLE`` rows by a hash of the key), one Spark group a part; a vector's code has one byte for each part, its nearest
centre. A query makes a table of its distances to all centres; a row's distance is then one lookup a part and a sum. Each
task keeps the nearest ``oversample`` times k codes a query, a ranking keeps as many of all tasks, and only those meet their
vectors by a join, for exact distances.

Defined results: rows and queries without a vector play no part; approximate and exact ties go by key; a dimension that
the parts don't divide is an error; without rows searches have no results; rows that repeat are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distance
from .cells import sampled
from .knn import arrow_type, ranked
from .vectors import gaps, keys, lloyd, matrix

#: Rows that the centres are fitted on; queries whose tables are sent to every task at once (16 kB each with 8 parts).
SAMPLE, MOST_TABLES = 16_384, 2_048
CENTRES = 256


@dataclass
class Codebook:
    """centres: one array (centres, part length) for each part."""

    centres: list[np.ndarray]

    @classmethod
    def fit(cls, rows: DataFrame, parts: int, seed: int = 0, key: str = "id", vector: str = "vector") -> Codebook:
        held = sampled(rows.where(F.col(vector).isNotNull()).select(key, vector), SAMPLE, key)
        first = held.select(F.size(vector).alias("n")).first()
        if first is None:
            return cls([])
        if first.n % parts:
            raise ValueError(f"{parts} parts don't divide {first.n} dimensions")
        width = first.n // parts
        cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(vector, p * width + 1, width))

        def centres_of(part: pd.DataFrame) -> pd.DataFrame:
            found = lloyd(np.array(part["piece"].tolist(), np.float64), CENTRES, seed=seed)
            return pd.DataFrame({"part": part["part"].iloc[0], "centre": found.tolist()})

        fitted = held.select(F.posexplode(cut).alias("part", "piece")).groupBy("part").applyInPandas(centres_of, "part int, centre array<double>")
        by_part: dict[int, list] = {}
        for r in fitted.collect():  # 256 centres a part
            by_part.setdefault(r.part, []).append(r.centre)
        return cls([np.array(by_part[p]) for p in range(parts)])

    def encode(self, rows: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
        """(id, code) of the rows with a vector."""
        books, kind = self.centres, rows.schema[key].dataType.simpleString()

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch["v"])
                width = x.shape[1] // len(books)
                code = np.stack([gaps(x[:, p * width : (p + 1) * width], book, "l2")[0].argmin(1).astype(np.uint8) for p, book in enumerate(books)], axis=1)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([row.tobytes() for row in code], pa.binary())], ["id", "code"])

        source = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
        return source.mapInArrow(of_task, f"id {kind}, code binary")

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part the distances of the queries to its centres."""
        width = q.shape[1] // len(self.centres)
        return [gaps(q[:, p * width : (p + 1) * width], book, "l2")[0] for p, book in enumerate(self.centres)]


def candidates(codes: DataFrame, book: Codebook, queries: DataFrame, n: int, query_key: str = "query_id", vector: str = "vector") -> DataFrame:
    """(query_id, id): for each query the n rows whose codes are nearest."""
    kind, query_kind = codes.schema["id"].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    schema = f"query_id {query_kind}, id {kind}, distance double"
    found = codes.sparkSession.createDataFrame([], schema)
    types = arrow_type(queries, query_key), arrow_type(codes, "id")
    asked = queries.where(F.col(vector).isNotNull()).select(query_key, vector).toLocalIterator()
    while book.centres and (held := list(islice(asked, MOST_TABLES))):
        shared = codes.sparkSession.sparkContext.broadcast(([r[0] for r in held], book.tables(np.array([r[1] for r in held], np.float64))))
        found = found.unionByName(codes.mapInArrow(_nearest_codes(shared, types, n), schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "id")


def _nearest_codes(shared, types: tuple[pa.DataType, pa.DataType], n: int, block: int = 128):  # noqa: ANN001, ANN202
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables = shared.value
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * -(-len(names) // block)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = keys(batch["id"])
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            for b in range(len(best)):
                gap = sum(table[b * block : (b + 1) * block][:, code[:, p]] for p, table in enumerate(tables))
                of = np.broadcast_to(ids, gap.shape)
                if best[b] is not None:
                    gap, of = np.concatenate([best[b][0], gap], axis=1), np.concatenate([best[b][1], of], axis=1)
                order = np.lexsort((of, gap), axis=1)[:, :n]
                best[b] = np.take_along_axis(gap, order, 1), np.take_along_axis(of, order, 1)
        for b, held in enumerate(best):
            if held is not None:
                asked = np.repeat(np.arange(len(held[0])) + b * block, held[0].shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in asked], types[0]), pa.array(held[1].ravel().tolist(), types[1]), pa.array(held[0].ravel())], ["query_id", "id", "distance"])

    return of_task


def reranked(rows: DataFrame, queries: DataFrame, near: DataFrame, k: int, metric: str = "l2", key: str = "id", query_key: str = "query_id", vector: str = "vector") -> DataFrame:
    """(query_id, id, distance, rank, score): the k nearest of each query's candidates by exact distance."""
    held = near.join(queries.select(F.col(query_key).alias("query_id"), F.col(vector).alias("q")), "query_id").join(rows.select(F.col(key).alias("id"), F.col(vector).alias("v")), "id")
    return ranked(held.select("query_id", "id", distance(F.col("v"), F.col("q"), metric).alias("distance")), k)


def quantised_top_k(rows: DataFrame, codes: DataFrame, book: Codebook, queries: DataFrame, k: int, oversample: int = 10) -> DataFrame:
    """rows: (id, vector) that ``codes`` encode; queries: (query_id, vector)."""
    return reranked(rows, queries, candidates(codes, book, queries, oversample * k), k)
