"""Putting ranked results together: reciprocal rank fusion, and a re-ranking for diversity.

Defined results: a list's rank counts from 1; what a list doesn't have adds nothing; fused scores are rounded to 12 digits so
that ties go by id; a null or zero vector is like nothing else; an id that repeats in one list counts with each of its ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .knn import arrow_type
from .vectors import keys

#: Dampens the weight of the first ranks; the value of the published method.
CONSTANT = 60


def fused(lists: list[DataFrame], k: int, weights: list[float] | None = None, constant: int = CONSTANT) -> DataFrame:
    """(query_id, id, score, rank): the k best of several lists of (query_id, id, rank), by the sum of weight / (constant + rank)."""
    parts = [part.select("query_id", "id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for part, w in zip(lists, weights or [1.0] * len(lists), strict=True)]
    score = F.round(F.sum("part"), 12).alias("score")
    total = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def diversified(candidates: DataFrame, k: int, trade: float = 0.7, depth: int = 100) -> DataFrame:
    """(query_id, id, score, rank): k of the ``depth`` best of each query's (query_id, id, score, vector), by maximal marginal relevance.

    One after the other, the candidate with the greatest trade * relevance - (1 - trade) * its cosine with the most similar of those
    chosen; relevance is the score over the query's greatest. A query's rows are bounded by depth.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = candidates.withColumn("place", place).where(F.col("place") <= depth)
    held = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "vector"))).alias("held"))
    kinds = [candidates.schema[c].dataType.simpleString() for c in ("query_id", "id")]
    types = [arrow_type(candidates, c) for c in ("query_id", "id")]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, rows in zip(batch["query_id"].to_pylist(), batch["held"], strict=True):
                ids, score = keys(rows.values.field("id")), rows.values.field("score").to_numpy(zero_copy_only=False).astype(float)
                vectors = rows.values.field("vector").to_pylist()
                width = max((len(v) for v in vectors if v is not None), default=1)
                x = np.array([v if v is not None else [0.0] * width for v in vectors], np.float64)
                norms = np.sqrt((x * x).sum(1))
                x = x / np.where(norms > 0, norms, 1)[:, None]
                relevance, nearest, left, chosen, values = score / (score.max() or 1), np.zeros(len(ids)), np.ones(len(ids), bool), [], []
                for _ in range(min(k, len(ids))):
                    value = np.where(left, np.round(trade * relevance - (1 - trade) * nearest, 12), -np.inf)
                    j = int(value.argmax())  # the first of equals, and rows stand by score and id
                    chosen.append(j)
                    values.append(value[j])
                    left[j] = False
                    like = x @ x[j]
                    nearest = like if len(chosen) == 1 else np.maximum(nearest, like)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(chosen), types[0]), pa.array(ids[chosen].tolist(), types[1]), pa.array(np.array(values, float)), pa.array(np.arange(1, len(chosen) + 1, dtype=np.int32))], ["query_id", "id", "score", "rank"])

    return held.mapInArrow(of_task, f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")
