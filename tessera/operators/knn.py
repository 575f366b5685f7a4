"""Exact nearest neighbours.

One query: a projection of the distance and TakeOrderedAndProject, so that each
task keeps k rows. Many queries: blocks of vectors against blocks of queries in
NumPy with a running top k, so that a task gives k ids and distances a query
however many batches it reads; a ranking follows whose group limit runs before its
shuffle. Distances are computed in double precision in the order of the elements
either way, so both give the same numbers, and ties go by key.

Rows and queries whose vector is null play no part; neither do rows at no distance
(the cosine of a zero vector). Rows of other lengths than the query are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distance, score
from .batches import bounded_batches
from .vectors import Nearest, keys, matrix

#: Query vectors that are sent to every task at once.
MOST_QUERIES = 20_000


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def top_k(rows: DataFrame, query: list[float], k: int, metric: str = "l2", vector: str = "vector", key: str = "id", wide: list[str] | None = None) -> DataFrame:
    """The k nearest rows with their distance and score, ties by key. wide: columns that join only the rows that survive."""
    near = rows.where(F.col(vector).isNotNull()).select(key, *[c for c in rows.columns if c not in {key, vector, *(wide or [])}], distance(F.col(vector), literal(query), metric).alias("distance"))
    best = near.where(F.col("distance").isNotNull() & ~F.isnan("distance")).orderBy("distance", key).limit(k)
    if wide:
        best = rows.select(key, *wide).join(F.broadcast(best), key)  # k rows
    return best.withColumn("score", score(F.col("distance")))


def merge(parts: list[DataFrame], k: int, key: str = "id") -> DataFrame:
    """The k best of several results."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.desc("score"), key).limit(k) if len(parts) > 1 else out


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return df.sparkSession.createDataFrame([], df.select(column).schema).toArrow().schema.field(0).type


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vector: str = "vector", key: str = "id", query_key: str = "query_id", query_block: int = 1024) -> DataFrame:
    """(query_id, id, distance, score, rank) of the k nearest rows of each query.

    queries: any number, none too; each part of ``MOST_QUERIES`` is sent to every task and read against all rows in turn.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(query_key, vector).toLocalIterator()
    found = []
    while (held := [(r[0], r[1]) for r in islice(asked, MOST_QUERIES)]) or not found:
        found.append(_near(rows, held, queries.select(query_key), k, metric, vector, key, query_block))
    return ranked(reduce(DataFrame.unionByName, found), k)


def ranked(near: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query from (query_id, id, distance) of all tasks, with rank and score."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", score(F.col("distance")))


def _near(rows: DataFrame, held: list[tuple], asked: DataFrame, k: int, metric: str, vector: str, key: str, query_block: int) -> DataFrame:
    """(query_id, id, distance): the k nearest rows of each task for one part of the queries."""
    bounded_batches(rows.sparkSession)
    names = np.array([i for i, _ in held])
    blocks = [np.array([v for _, v in held[a : a + query_block]], np.float64) for a in range(0, len(held), query_block)]
    shared = rows.sparkSession.sparkContext.broadcast((names, blocks))
    kind, query_kind = rows.schema[key].dataType.simpleString(), asked.schema[0].dataType.simpleString()
    types = arrow_type(asked, asked.columns[0]), arrow_type(rows, key)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, blocks = shared.value
        nearest = [Nearest(q, k, metric) for q in blocks]
        for batch in batches:
            if batch.num_rows:
                ids, x = keys(batch["id"]), matrix(batch["v"])
                for block in nearest:
                    block.add(ids, x)
        for b, block in enumerate(nearest):
            for at, ids, gap in block.found():
                yield pa.RecordBatch.from_arrays([pa.array(names[b * query_block + at].tolist(), types[0]), pa.array(ids.tolist(), types[1]), pa.array(gap)], ["query_id", "id", "distance"])

    return rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(of_task, f"query_id {query_kind}, id {kind}, distance double")
