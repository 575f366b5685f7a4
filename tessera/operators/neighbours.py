"""A k-nearest-neighbour graph over all vectors, by the descent over neighbours of neighbours.

Equal vectors are one node, named by its smallest id (``classes``), so copies, be they a third of all rows, cost nothing
beyond one aggregate and one join. Each node starts with the nearest of some random groups of about ``GROUP`` nodes. A round
brings each node together with its neighbours and with at most ``width`` nodes that have it as theirs; within such a group,
of bounded size, all distances are computed that a new edge asks for, and each member is offered those nearer than its
present last one. The best ``width`` of all offers stay. Rounds end when fewer than ``settled`` of all edges change.

State is one table of edges, checkpointed each round; the driver sees one count a round. Offers and reverse edges are ranked
with a group limit before their shuffle, so a node that many have as neighbour gathers no more than ``width`` rows of a task.

Defined results: rows without a vector are no nodes; ties go by id; rows that repeat are one node; fewer nodes than
``width`` + 1 all become neighbours; the result is approximate, tests measure its recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed
from .batches import bounded_batches
from .vectors import exact, gaps, matrix

#: Nodes of a starting group on average; starting groups each node is put into; rounds at most.
GROUP, STARTS, ROUNDS = 64, 4, 12
_EDGES = "node long, neighbour long, distance double, fresh boolean"


def classes(rows: DataFrame, key: str = "id", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(node, vector) of the distinct vectors and (id, node) of all rows that have one."""
    held = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    nodes = checkpointed(held.groupBy("vector").agg(F.min("id").alias("node")).select("node", "vector"))
    return nodes, held.join(nodes, "vector").select("id", "node")


def _best(offers: DataFrame, width: int) -> DataFrame:
    """The nearest ``width`` edges of each node; an edge that was there before isn't fresh."""
    once = offers.groupBy("node", "neighbour").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("distance", "neighbour"))
    return once.withColumn("place", place).where(F.col("place") <= width).drop("place")


def _offers(groups: DataFrame, width: int) -> DataFrame:
    """Edges between the members of each row's group. members: structs of node, vector, fresh, bound (the distance of its last edge)."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for members in batch["members"]:
                held = members.values
                node, fresh = held.field("node").to_numpy(), held.field("fresh").to_numpy(zero_copy_only=False)
                bound, x = held.field("bound").to_numpy(), matrix(held.field("vector"))
                if len(node) < 2:
                    continue
                gap, off = gaps(x, x, "l2")
                wanted = (fresh[:, None] | fresh[None, :]) & (gap <= (bound + off)[:, None])
                np.fill_diagonal(wanted, False)
                gap[~wanted] = np.inf
                if width < len(node):  # a member needs no more than its nearest of a group
                    wanted &= gap <= np.partition(gap, width - 1, axis=1)[:, width - 1, None] + off[:, None]
                a, b = np.nonzero(wanted)
                if len(a):
                    for held_out, values in zip(out, (node[a], node[b], exact(x[a], x[b], "l2")), strict=True):
                        held_out.append(values)
            if out[0]:
                node, neighbour, gap = (np.concatenate(v) for v in out)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(neighbour), pa.array(gap), pa.array(np.ones(len(node), bool))], ["node", "neighbour", "distance", "fresh"])

    bounded_batches(groups.sparkSession)
    return groups.mapInArrow(of_task, _EDGES)


def _member(fresh: Column, bound: Column) -> Column:
    return F.struct("node", "vector", fresh.alias("fresh"), bound.alias("bound"))


def _start(nodes: DataFrame, n: int, width: int, seed: int) -> DataFrame:
    groups = max(1, n // max(GROUP, width + 1))
    starts = F.array(*(F.pmod(F.xxhash64("node", F.lit(seed + s)), F.lit(groups)) + s * groups for s in range(STARTS if groups > 1 else 1)))
    member = _member(F.lit(True), F.lit(float("inf")))
    return _best(_offers(nodes.select(F.explode(starts).alias("start"), member.alias("member")).groupBy("start").agg(F.collect_list("member").alias("members")).select("members"), width), width)


def _round(nodes: DataFrame, edges: DataFrame, width: int, number: int) -> DataFrame:
    """The best edges after one exchange among neighbours."""
    bounds = edges.groupBy("node").agg(F.max("distance").alias("bound"), F.count("*").alias("n"))
    bounds = bounds.select("node", F.when(F.col("n") < width, float("inf")).otherwise(F.col("bound")).alias("bound"))
    forward = edges.select(F.col("node").alias("centre"), F.col("neighbour").alias("member"), "fresh")
    place = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("member", F.lit(number)), "member"))
    backward = edges.select(F.col("neighbour").alias("centre"), F.col("node").alias("member"), "fresh").withColumn("place", place).where(F.col("place") <= width).drop("place")
    own = bounds.select(F.col("node").alias("centre"), F.col("node").alias("member"), F.lit(False).alias("fresh"))
    together = forward.unionByName(backward).unionByName(own).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    alive = together.join(nodes.join(bounds, "node", "left").withColumnRenamed("node", "member"), "member")
    member = F.struct(F.col("member").alias("node"), "vector", "fresh", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    groups = alive.groupBy("centre").agg(F.collect_list(member).alias("members")).select("members")
    return _best(edges.withColumn("fresh", F.lit(False)).unionByName(_offers(groups, width)), width)


def graph(nodes: DataFrame, width: int = 16, settled: float = 0.002, seed: int = 0) -> DataFrame:
    """(node, neighbour, distance, rank) of the nearest ``width`` nodes of each node."""
    n = nodes.count()
    edges = checkpointed(_start(nodes, n, width, seed))
    for number in range(ROUNDS):
        edges = checkpointed(_round(nodes, edges, width, number))
        if edges.where("fresh").count() <= settled * n * width:
            break
    rank = F.row_number().over(Window.partitionBy("node").orderBy("distance", "neighbour"))
    return edges.select("node", "neighbour", "distance").withColumn("rank", rank)
