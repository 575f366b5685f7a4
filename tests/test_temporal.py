import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.temporal import overlapping, valid_at


def ordered(rows):
    return sorted(rows, key=lambda row: [(x is not None, x) for x in row])


def brute_versions(events, versions):
    out = []
    for key, at, x in events:
        known = [v for v in versions if key is not None and at is not None and v[0] == key and v[1] is not None and v[1] <= at]
        best = max(known, key=lambda v: (v[1], v[2] is not None, v[2] or "", v[3] is not None, v[3] or 0), default=(None,) * 4)
        out.append((key, at, x, best[2], best[3], best[1]))
    return out


def versions_of(spark, events, versions):
    a = spark.createDataFrame(events, "key string, at long, part long").repartition(3)
    b = spark.createDataFrame(versions, "key string, since long, name string, size long, event string").repartition(3)
    return valid_at(a, b, "key", "at", ["name", "size"], "since").select("key", "at", F.col("part"), "name", "size", "valid_from")


@pytest.mark.parametrize("span, batch", [(40, 10_000), (4000, 10_000), (4000, 3)])
def test_version_at_events(spark, span, batch):
    rng = random.Random(span)
    keys = ["hot"] * 8 + ["a", "b", "c", None]
    at = lambda: rng.choice([None, *[rng.randrange(span)] * 30])
    events = [(rng.choice(keys), at(), k) for k in range(500)]
    events += events[:7]
    versions = [(rng.choice(keys), at(), rng.choice([None, "x", "y"]), rng.choice([None, 1, 2]), "e") for _ in range(120)]
    versions += [("hot", 1, "first", 0, "e"), ("only_version", 3, "z", 1, "e"), *versions[:5]]
    events.append(("only_event", 5, -1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert ordered(tuple(r) for r in versions_of(spark, events, versions).collect()) == ordered(brute_versions(events, [v[:4] for v in versions]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_versions_carry_over_partitions_without_any(spark):
    """One version long before, then partitions of events only."""
    events = [("hot", k, k) for k in range(2000)] + [("next", k, k) for k in range(200)]
    found = versions_of(spark, events, [("hot", 0, "v", 1, "e")])
    assert found.where("key = 'hot' AND name = 'v' AND valid_from = 0").count() == 2000
    assert found.where("key = 'next' AND name IS NULL").count() == 200


def test_versions_replace_columns_of_equal_names(spark):
    events = spark.createDataFrame([("a", 5, "old", 1, 2)], "key string, at long, name string, version long, valid_from long")
    found = valid_at(events, spark.createDataFrame([("a", 3, "new")], "key string, at long, name string"), "key", "at", ["name"])
    assert found.columns == ["key", "at", "version", "name", "valid_from"] and [tuple(r) for r in found.collect()] == [("a", 5, 1, "new", 3)]


def test_versions_of_empty_sides(spark):
    assert versions_of(spark, [], [("a", 1, "x", 1, "e")]).collect() == []
    assert [tuple(r) for r in versions_of(spark, [("a", 1, 2)], []).collect()] == [("a", 1, 2, None, None, None)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_come_once(spark, width):
    rng = random.Random(width)
    side = lambda n: [(rng.choice(["hot", "hot", "a", None]), a := rng.choice([None, rng.randrange(-50, 200)]), None if a is None else a + rng.choice([-1, 0, 3, 40]), k) for k in range(n)]
    left, right = side(120), side(90)
    right += right[:4]
    schema = "key string, lo long, hi long, bin long"
    found = overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "key", "lo", "hi", width)
    want = [(a, b) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (a[1], a[2], b[1], b[2]) and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]]
    assert sorted((tuple(r.left), tuple(r.right)) for r in found.collect()) == sorted(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
