"""Tolerant as-of join: for each row of the left the latest row of the right at or before it, at most a tolerance earlier.

The method: a window over the union of both sides with a RANGE frame from the tolerance before to the current row takes
the maximum of a packed struct (time, tie keys, payload); how many rows share the matched time is counted apart and joined
afterwards.

A key may hold a third of all rows, and such a frame costs as much as it has rows. So both sides are first reduced to their
distinct (key, time), the right one to the best row of each, and the union is dealt by ranges of (key, time) and numbered
there. ``FOLD`` rows with consecutive numbers are a slot, and the window runs within slots. What the slots before hold is
one packed struct, the last in the order of (key, time): a running maximum over slots, taken in groups of ``FOLD`` slots,
over groups in groups of groups, and so on, until at most ``FOLD`` are left. So no task, broadcast or driver value grows with
the input, whatever the keys. The joins on (key, time) are sort-merge joins, whose large partitions adaptive execution splits.

Defined results: a null key or time never matches; unmatched rows stay, with nulls and ``n_tied`` 0; of rows at one time the
larger tie keys win, in their order, and null loses; left rows that repeat are answered one by one; other columns of both
sides play no part and may have any names (a left column named as one that comes is replaced by it); empty sides give no
matches or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from .common import checkpointed

#: Rows of a slot, and so of a window's frame at most.
FOLD_BITS = 8
FOLD = 1 << FOLD_BITS
#: Bits of the row number within a partition in ``monotonically_increasing_id``.
_ROW_BITS = 33
TOLERANCE_US = 72 * 3_600_000_000
DAY_US = 24 * 3_600_000_000


def micros(column: Column, kind: DataType) -> Column:
    """Microseconds since 1970; a timestamp without a zone counts as UTC, whatever the session's zone."""
    if not isinstance(kind, TimestampNTZType):
        return F.unix_micros(column)
    seconds = (F.unix_date(F.to_date(column)).cast("long") * 24 + F.hour(column)) * 60 + F.minute(column)
    return seconds * 60_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")


def _shifts(most_rows: int, parts: int) -> list[int]:
    """By how many bits a row's number is shifted for each level of slots, until no more than FOLD are left of a level."""
    shifts = [FOLD_BITS]
    while most_rows >> shifts[-1] > FOLD:
        shifts.append(shifts[-1] + FOLD_BITS)
    shifts.append(_ROW_BITS)
    while parts >> (shifts[-1] - _ROW_BITS) > FOLD:
        shifts.append(shifts[-1] + FOLD_BITS)
    return shifts


def _before(lasts: DataFrame, shifts: list[int]) -> DataFrame:
    """(slot, before): the greatest ``last`` of all slots before each, from (slot, last)."""
    group = F.shiftright("slot", shifts[1] - shifts[0]) if len(shifts) > 1 else F.lit(0).cast("long")
    earlier = F.max("last").over(Window.partitionBy("group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    own = lasts.withColumn("group", group).withColumn("own", earlier)
    if len(shifts) == 1:
        return own.select("slot", F.col("own").alias("before"))
    groups = lasts.groupBy(group.alias("slot")).agg(F.max("last").alias("last"))
    outer = _before(groups, shifts[1:]).select(F.col("slot").alias("group"), "before")
    return own.join(outer.hint("merge"), "group").select("slot", F.coalesce("own", "before").alias("before"))


def matched(asked: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """(key, at, best) of the distinct (key, at) of ``asked`` that have a match. right: (key, at, best), best starting with at."""
    union = asked.select("key", "at", F.lit(None).cast(right.schema["best"].dataType).alias("best")).unionByName(right)
    order = ["key", "at", F.col("best").isNull()]
    dealt = union.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: numbers may differ if ranges are drawn again.
    numbered = checkpointed(dealt.withColumn("number", F.monotonically_increasing_id()))
    row, part = F.col("number").bitwiseAND((1 << _ROW_BITS) - 1), F.shiftright("number", _ROW_BITS)
    most_rows, parts = numbered.agg(F.max(row), F.max(part)).first()
    slots = numbered.withColumn("slot", F.shiftright("number", FOLD_BITS))
    lasts = slots.groupBy("slot").agg(F.max(F.when(F.col("best").isNotNull(), F.struct("key", "best"))).alias("last"))
    before = _before(lasts, _shifts(most_rows or 0, parts or 0))
    frame = Window.partitionBy("slot", "key").orderBy("at").rangeBetween(-tolerance, Window.currentRow)
    carried = F.when((F.col("before.key") == F.col("key")) & (F.col("at") - F.col("before.best.at") <= tolerance), F.col("before.best"))
    found = slots.join(before.hint("merge"), "slot").withColumn("own", F.max("best").over(frame))
    return found.where("best IS NULL").select("key", "at", F.coalesce("own", carried).alias("best")).where("best IS NOT NULL")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: int, ties: list[Column], payload: list[str]) -> DataFrame:
    """The rows of ``left`` with ``matched_at``, the payload columns of the matched row, and ``n_tied``.

    key, at: columns of both sides, at in integer microseconds (or any unit of ``tolerance``). ties: over ``right``.
    """
    named = [F.col(c).alias(f"p{k}") for k, c in enumerate(payload)]
    held = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.struct(F.col(at).alias("at"), *(t.alias(f"t{k}") for k, t in enumerate(ties)), *named).alias("best"))
    held = held.groupBy("key", "at").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    asked = left.select(F.col(key).alias("key"), F.col(at).alias("at")).where("key IS NOT NULL AND at IS NOT NULL").distinct()
    best = matched(asked, held.drop("n"), tolerance)
    counts = held.select("key", F.col("at").alias("matched_at"), F.col("n").alias("n_tied"))
    answers = best.withColumn("matched_at", F.col("best.at")).join(counts.hint("merge"), ["key", "matched_at"])
    answers = answers.select(F.struct("key", "at").alias("answer_key"), "matched_at", *[F.col(f"best.p{k}").alias(f"p{k}") for k in range(len(payload))], "n_tied")
    rows = left.select(F.struct(*left.columns).alias("left"), F.col(key).alias("key"), F.col(at).alias("at"))
    joined = rows.join(answers.hint("merge"), (F.col("key") == F.col("answer_key.key")) & (F.col("at") == F.col("answer_key.at")), "left")
    new = {"matched_at", "n_tied", *payload}
    own = [F.col(f"left.`{c}`").alias(c) for c in left.columns if c not in new]
    return joined.select(*own, "matched_at", *[F.col(f"p{k}").alias(c) for k, c in enumerate(payload)], F.coalesce("n_tied", F.lit(0)).alias("n_tied"))


def _used(time: Column, hashed: Column) -> Column:
    """Where the hash is odd, the start of the time's day."""
    return F.when(hashed % 2 == 1, time - F.pmod(time, F.lit(DAY_US))).otherwise(time)


def clicks_of(clicks: DataFrame) -> DataFrame:
    """(click_id, client_id, ts_us), copies once: of copies that differ the one with the greatest client_id and ts stays. Rows without a click_id are copies where client_id and ts are equal."""
    lone = [F.when(F.col("click_id").isNull(), F.col(c)).alias(f"lone_{c}") for c in ("client_id", "ts")]
    h = F.crc32(F.col("click_id").cast("string"))
    ts = micros(F.col("row.ts"), clicks.schema["ts"].dataType)
    once = clicks.groupBy("click_id", *lone).agg(F.max(F.struct("client_id", "ts")).alias("row"))
    return once.select("click_id", "row.client_id", _used(ts, h).alias("ts_us"))


def orders_of(sales: DataFrame) -> DataFrame:
    """(sale_id, client_id, ts_us, total_cents, priority) of each row, and of its twin where it has one."""
    h = F.crc32(F.col("sale_id").cast("string"))
    cents = F.floor(100 * F.col("total") + 0.5).cast("long")
    once = sales.select("sale_id", "client_id", _used(micros(F.col("sold_at"), sales.schema["sold_at"].dataType), h).alias("ts_us"), cents.alias("total_cents"), F.col("priority").cast("long").alias("priority"), h.alias("h"))
    twin = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    both = F.when(F.col("h") % 3 != 0, F.array(F.struct("sale_id", "priority"), twin)).otherwise(F.array(F.struct("sale_id", "priority")))
    return once.select("client_id", "ts_us", "total_cents", F.inline(both))


def op11_tolerant_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = clicks_of(spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "client_id", "ts"))
    orders = orders_of(spark.read.parquet(f"{sf_dir}/sales.parquet").select("sale_id", "client_id", "total", "sold_at", "priority"))
    found = asof_join(clicks, orders, "client_id", "ts_us", TOLERANCE_US, [F.col("priority"), -F.col("sale_id")], ["sale_id", "total_cents"])
    return found.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("matched_at")).alias("lag_us"), "total_cents", "n_tied")


#: crc32 by its table of 256 values, made by a recursion; the match by DuckDB's ASOF join.
SQL = """
WITH RECURSIVE bits AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hashed_clicks AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(click_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS us FROM clicks), crc
), hashed_sales AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM (SELECT sale_id, client_id, epoch_us(sold_at) AS us, priority, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents FROM sales), crc
), asked AS (
  SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN CAST(floor(us / 86400000000.0) AS BIGINT) * 86400000000 ELSE us END AS ts_us FROM hashed_clicks
), orders AS (
  SELECT sale_id, client_id, CASE WHEN h % 2 = 1 THEN CAST(floor(us / 86400000000.0) AS BIGINT) * 86400000000 ELSE us END AS placed, priority, cents, h FROM hashed_sales
), twins AS (
  SELECT sale_id, client_id, placed, priority, cents FROM orders
  UNION ALL SELECT -1 - sale_id, client_id, placed, 6 - priority, cents FROM orders WHERE h % 3 <> 0
), best AS (
  SELECT *, count(*) OVER (PARTITION BY client_id, placed) AS n,
         row_number() OVER (PARTITION BY client_id, placed ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST) AS place
  FROM twins WHERE client_id IS NOT NULL AND placed IS NOT NULL
), found AS (
  SELECT a.click_id, a.client_id, a.ts_us, b.sale_id, b.placed, b.cents, b.n, a.ts_us - b.placed <= 259200000000 AS near
  FROM asked a ASOF LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON a.client_id = b.client_id AND a.ts_us >= b.placed
)
SELECT click_id, client_id, ts_us, CASE WHEN near THEN sale_id END AS sale_id, CASE WHEN near THEN ts_us - placed END AS lag_us,
       CASE WHEN near THEN cents END AS total_cents, CASE WHEN near THEN n ELSE 0 END AS n_tied
FROM found
"""
