import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.streaming.quiet import PROVIDER, Runs, merged, quiet
from tessera.streaming.watch import debounced


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(*PROVIDER)
    yield
    spark.conf.unset(PROVIDER[0])


def write(spark, folder, rows):
    spark.createDataFrame(rows, "path string, us long").select("path", F.timestamp_micros("us").alias("ts"), F.lit(1).alias("n")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema("path string, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = quiet(stream, "path", **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.parquet(f"{tmp_path}/out").select("key", F.unix_micros("start"), F.unix_micros("end"), "n")
    return sorted(tuple(r) for r in told.collect())


S = 1_000_000
FLUSH = [("z", 10_000_000 * S)]


def test_runs_equal_session_windows_through_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randrange(600) * S + rng.choice([0, 1, 500_000]), rng.choice(["hot"] * 6 + ["a", "b"])) for _ in range(400))
    rows = [(k, t) for t, k in rows]
    late = rows[5::29]  # within the watermark's delay: they come with the next file
    on_time = [r for r in rows if r not in late]
    write(spark, f"{tmp_path}/in", on_time[:200] + [(None, 5), ("a", None)])
    run(spark, tmp_path, gap_s=3.0, late="20 minutes")
    write(spark, f"{tmp_path}/in", late + on_time[200:])
    run(spark, tmp_path, gap_s=3.0, late="20 minutes")  # a new query from the checkpoint
    write(spark, f"{tmp_path}/in", FLUSH)
    told = run(spark, tmp_path, gap_s=3.0, late="20 minutes")
    table = spark.createDataFrame(late + on_time, "path string, us long").select("path", F.timestamp_micros("us").alias("ts"))
    want = debounced(table, "path", gap="3 seconds").select("path", F.unix_micros("start"), F.unix_micros("end") - 3 * S, "n")
    assert told == sorted(tuple(r) for r in want.collect())


def test_too_late_and_too_long(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [("busy", k * S) for k in range(1, 101)])
    run(spark, tmp_path, gap_s=2.0, late="0 seconds", most_s=30.0)
    write(spark, f"{tmp_path}/in", [("busy", 5 * S), ("busy", 101 * S), ("busy", 102 * S)])  # the first is behind the watermark
    run(spark, tmp_path, gap_s=2.0, late="0 seconds", most_s=30.0)
    write(spark, f"{tmp_path}/in", FLUSH)
    told = run(spark, tmp_path, gap_s=2.0, late="0 seconds", most_s=30.0)
    assert sum(n for _, _, _, n in told) == 102 and len(told) == 2 and told[0][1] == S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=30), st.integers(1, 5), st.randoms())
def test_merging_in_parts_equals_merging_at_once(times, gap, rng):
    rng.shuffle(times)
    cut = rng.randint(0, len(times))
    one = merged([(t, t, 1) for t in times], gap)
    two = merged(merged([(t, t, 1) for t in times[:cut]], gap) + [(t, t, 1) for t in times[cut:]], gap)
    assert one == two and sum(n for _, _, n in one) == len(times)
    assert all(b[0] - a[1] > gap for a, b in zip(one, one[1:]))


class Held:
    """A key's state and timers, with the messages that they cost."""

    def __init__(self):
        self.value, self.timers, self.messages = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages += 1
        self.value = value

    put = update

    def clear(self):
        self.update(None)

    def listTimers(self):  # noqa: N802
        self.messages += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.messages += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.messages += 1
        self.timers.discard(at)


def test_a_key_has_one_timer_however_many_runs():
    state, runs = Held(), Runs(2 * S, None)
    runs.init(state)
    told = list(runs._settle(("a",), [(10 * k * S, 10 * k * S, 1) for k in range(1000)], 0))
    assert told == [] and state.timers == {2000} and state.messages <= 4
    for at, left in ((2000, 999), (5_002_000, 499), (9_992_000, 0)):
        told += list(runs._settle(("a",), runs._held(), at))
        assert sum(map(len, told)) == 1000 - left and len(state.timers) == (left > 0)
    assert [n for t in told for n in t["n"]] == [1] * 1000
