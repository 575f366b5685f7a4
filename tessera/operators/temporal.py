"""Joins over time and over ranges: the version valid at an event, and intervals that overlap.

``valid_at``: events and versions are put together and dealt by ranges of (key, time), so that a key with a third of all rows is
split like any other. Each task walks its sorted rows once and carries the last version of the key along. What a task's
first rows need from the tasks before is one version, the last of them: one row a partition, summed up in the order of
partitions and given to every task (a few bytes a partition, and as many rows as partitions, whatever the input).

``overlapping``: both sides are put into bins of ``width`` along the line, an interval into each bin it touches. A pair meets in
all bins that both touch, and is given out in one only, the bin in which the later of the two begins. A bin of a key that
holds many rows is a partition of the join that adaptive execution splits; the join is by equality, never a nested loop.

Defined results: null keys or times match nothing, their events stay with null columns; of versions of equal time the one
with the greatest columns counts, in their order, null smallest; at the time of a version it is valid; rows that repeat are
rows of their own; an event's column named as one that comes is replaced by it; an interval whose end is before its start, or with a null end, overlaps nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


def valid_at(events: DataFrame, versions: DataFrame, key: str, at: str, columns: list[str], version_at: str | None = None) -> DataFrame:
    """The events with ``columns`` of the version of their key that was valid at their time, and its time as ``valid_from``."""
    held = F.struct(F.col(version_at or at).alias("valid_from"), *columns)
    known = versions.where(F.col(key).isNotNull() & F.col(version_at or at).isNotNull()).select(F.col(key).alias("key"), F.col(version_at or at).alias("at"), held.alias("version"))
    known = known.groupBy("key", "at").agg(F.max("version").alias("version"))
    kind = known.schema["version"].dataType
    row = F.struct(*events.columns)
    dated = F.col(key).isNotNull() & F.col(at).isNotNull()
    asked = events.where(dated).select(F.col(key).alias("key"), F.col(at).alias("at"), row.alias("event"))
    union = asked.withColumn("version", F.lit(None).cast(kind)).unionByName(known.withColumn("event", F.lit(None).cast(asked.schema["event"].dataType)))
    order = ["key", "at", F.col("version").isNull()]
    sorted_rows = union.repartitionByRange(*order).sortWithinPartitions(*order)
    carried = _carried(sorted_rows.withColumn("part", F.spark_partition_id()))
    lasts = carried.groupBy("part").agg(F.max(F.when(F.col("version").isNotNull(), F.struct("key", "version"))).alias("last"))
    before = lasts.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    fits = F.when(F.col("before.key") == F.col("key"), F.col("before.version"))
    found = carried.where("event IS NOT NULL").join(F.broadcast(before), "part", "left").select("event", F.coalesce("version", fits).alias("version"))  # one row a partition
    lone = events.where(~dated).select(row.alias("event"), F.lit(None).cast(kind).alias("version"))
    new = [*columns, "valid_from"]
    own = [F.col(f"event.`{c}`").alias(c) for c in events.columns if c not in new]
    return found.unionByName(lone).select(*own, *[F.col(f"version.`{c}`").alias(c) for c in new])


def _carried(rows: DataFrame) -> DataFrame:
    """The sorted rows of each partition, events with the last version of their key that the partition has; written once, as ranges may be drawn otherwise again."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, version = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = pc.if_else(pc.is_valid(batch["version"]), pa.array(range(batch.num_rows), pa.int64()), pa.scalar(None, pa.int64()))
            last = pc.fill_null_forward(place)
            filled = pc.take(batch["version"], last)
            same = pc.fill_null(pc.equal(pc.take(batch["key"], last), batch["key"]), False)
            early = pc.is_null(last)  # before the batch's first version: what the batch before ended with
            filled = pc.if_else(same, filled, pa.scalar(None, filled.type))
            if key is not None and version.is_valid:
                carries = pc.and_(early, pc.equal(batch["key"], key))
                filled = pc.if_else(carries, version, filled)
            yield pa.RecordBatch.from_arrays([filled if name == "version" else batch[name] for name in batch.schema.names], schema=batch.schema)
            key, version = batch["key"][-1], filled[-1]

    return checkpointed(rows.mapInArrow(of_task, rows.schema))


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """(left, right) structs of all pairs of one key whose closed intervals of integers share a point. width: of a bin, best near the usual length."""

    def binned(side: DataFrame, name: str) -> DataFrame:
        first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
        whole = side.where(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
        return whole.select(F.struct(*side.columns).alias(name), F.col(key).alias("key"), F.explode(F.sequence(first, last)).alias("bin"))

    met = binned(left, "left").join(binned(right, "right"), ["key", "bin"])
    overlap = (F.col(f"left.{start}") <= F.col(f"right.{end}")) & (F.col(f"right.{start}") <= F.col(f"left.{end}"))
    begins = F.floor(F.greatest(f"left.{start}", f"right.{start}") / width)
    return met.where(overlap & (F.col("bin") == begins)).select("left", "right")
