import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import asof
from tessera.llm.asof import asof_join, clicks_of, micros, op11_tolerant_asof, orders_of
from tessera.llm.exact_dedup import _named_blocks, blocks_of, exact_dedup, named_documents
from tessera.llm.filter_audit import audit, cells_of, failures, filter_audit, swaps

DAY = 86_400_000_000


def rows_of(df, *columns):
    key = lambda row: [(x is not None, x) if not isinstance(x, tuple) else x for x in row]
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=key)


# ---- as-of join


def brute_asof(left, right, tolerance):
    """left: (key, at, x); right: (key, at, tie, name)."""
    out = []
    for key, at, x in left:
        near = [r for r in right if key is not None and at is not None and r[0] == key and r[1] is not None and at - tolerance <= r[1] <= at]
        latest = max((r[1] for r in near), default=None)
        tied = [r for r in near if r[1] == latest]
        best = max(tied, key=lambda r: (r[2] is not None, r[2] or 0, r[3]), default=(None,) * 4)
        out.append((key, at, x, latest, best[3], len(tied)))
    return out


def joined(spark, left, right, tolerance, partitions=3):
    a = spark.createDataFrame(left, "key string, at long, best long").repartition(partitions)
    b = spark.createDataFrame(right, "key string, at long, tie long, name string, best string, slot long").repartition(partitions)
    return asof_join(a, b, "key", "at", tolerance, [F.col("tie"), F.col("name")], ["name"]).select("key", "at", "best", "matched_at", "name", "n_tied")


def sides(rng, n, span, keys):
    left = [(rng.choice(keys), rng.choice([None, *[rng.randrange(span)] * 20]), k) for k in range(n)]
    left += left[:5]
    right = [(rng.choice(keys), rng.choice([None, *[rng.randrange(span)] * 20]), rng.choice([None, 1, 2]), f"n{k:04d}", "b", k) for k in range(n)]
    return left, right + right[:5]


@pytest.mark.parametrize("span, tolerance", [(50, 3), (5000, 40), (5000, 5000), (5000, 0)])
def test_asof_against_brute_force(spark, span, tolerance):
    left, right = sides(random.Random(span + tolerance), 600, span, ["hot"] * 6 + ["a", "b", "c", None])
    want = brute_asof(left, [r[:4] for r in right], tolerance)
    key = lambda row: [(x is not None, x) for x in row]
    assert rows_of(joined(spark, left, right, tolerance)) == sorted(want, key=key)


def test_asof_through_levels_of_slots(spark, monkeypatch):
    """With slots of four rows the carry goes through every level."""
    monkeypatch.setattr(asof, "FOLD_BITS", 2)
    monkeypatch.setattr(asof, "FOLD", 4)
    assert asof._shifts(1000, 40) == [2, 4, 6, 8, 33, 35, 37]
    left, right = sides(random.Random(5), 400, 3000, ["hot"] * 6 + ["a", "b", None])
    right = [r for r in right if r[0] != "hot" or r[1] is None or r[1] < 500]  # long stretches of slots without right rows
    want = brute_asof(left, [r[:4] for r in right], 2000)
    key = lambda row: [(x is not None, x) for x in row]
    assert rows_of(joined(spark, left, right, 2000)) == sorted(want, key=key)


def test_asof_of_empty_sides(spark):
    left, right = sides(random.Random(1), 30, 50, ["a", "b"])
    assert rows_of(joined(spark, [], right, 5)) == []
    assert {(r.matched_at, r.name, r.n_tied) for r in joined(spark, left, [], 5).collect()} == {(None, None, 0)}


def test_asof_replaces_columns_of_equal_names(spark):
    a = spark.createDataFrame([("a", 5, 1, "x", 2, 3)], "key string, at long, matched_at long, name string, n_tied long, `left` long")
    b = spark.createDataFrame([("a", 3, "y", 1)], "key string, at long, name string, `left` long")
    out = asof_join(a, b, "key", "at", 10, [F.col("name")], ["name"])
    assert out.columns == ["key", "at", "left", "matched_at", "name", "n_tied"] and [tuple(r) for r in out.collect()] == [("a", 5, 3, 3, "y", 1)]


def test_asof_plan_sends_nothing_whole(spark):
    left, right = sides(random.Random(2), 200, 500, ["hot", "a"])
    plan = joined(spark, left, right, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_levels_leave_no_more_than_a_fold():
    for rows, parts in [(0, 0), (255, 3), (10**6, 199), (10**9, 10**6)]:
        shifts = asof._shifts(rows, parts)
        assert parts >> (shifts[-1] - 33) <= 256 and rows >> [s for s in shifts if s < 33][-1] <= 256


def brute_op11(clicks, sales):
    used = lambda key, us: None if us is None else us - us % DAY if key is not None and zlib.crc32(str(key).encode()) % 2 else us
    orders = []
    for sale, client, total, us, priority in sales:
        cents = None if total is None else int((100 * total + 0.5) // 1)
        orders.append((sale, client, used(sale, us), cents, priority))
        if sale is not None and zlib.crc32(str(sale).encode()) % 3:
            orders.append((-1 - sale, client, used(sale, us), cents, None if priority is None else 6 - priority))
    out = []
    for click, client, us in sorted(set(clicks), key=str):
        at = used(click, us)
        near = [o for o in orders if client is not None and at is not None and o[1] == client and o[2] is not None and at - 3 * DAY <= o[2] <= at]
        latest = max((o[2] for o in near), default=None)
        tied = [o for o in near if o[2] == latest]
        best = min(tied, key=lambda o: (o[4] is None, -(o[4] or 0), o[0] is None, o[0] or 0), default=None)
        out.append((click, client, at, best[0] if best else None, at - latest if best else None, best[3] if best else None, len(tied)))
    return out


@pytest.mark.parametrize("zone", ["timestamp", "timestamp_ntz"])
def test_op11_on_a_fixture(spark, tmp_path, zone):
    rng = random.Random(3)
    at = lambda: rng.choice([None, rng.randrange(20 * DAY), rng.randrange(20) * DAY, -5 * DAY + 7])
    clicks = [(k, rng.choice([None, 7, 7, 7, 8, 9]), at()) for k in range(300)] + [(None, 7, 3 * DAY)]
    clicks += clicks[:20] + [(None, 7, 3 * DAY)]
    sales = [(rng.choice([None, k, k, k, k]), rng.choice([None, 7, 7, 7, 8, 10]), rng.choice([None, 12.345, 0.005, 99.995]), at(), rng.choice([None, 1, 2, 3, 5])) for k in range(200)]
    sales += sales[:5]
    ntz = lambda c: F.expr(f"timestamp_ntz '1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {c} / 1000000.0)" if zone == "timestamp_ntz" else f"timestamp_micros({c})")
    spark.createDataFrame(clicks, "click_id long, client_id long, us long").select("click_id", "client_id", ntz("us").alias("ts"), F.lit("x").alias("key")).write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(sales, "sale_id long, client_id long, total double, us long, priority int").select("sale_id", "client_id", "total", ntz("us").alias("sold_at"), "priority").write.parquet(f"{tmp_path}/sales.parquet")
    for session_zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        try:
            found = rows_of(op11_tolerant_asof(spark, str(tmp_path)), "click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied")
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        key = lambda row: [(x is not None, x) for x in row]
        assert found == sorted(brute_op11(clicks, sales), key=key)


def test_micros_of_both_kinds(spark):
    df = spark.sql("SELECT timestamp_ntz '1969-12-31 23:59:58.000001' AS a, timestamp_micros(-1999999) AS b, CAST(NULL AS timestamp_ntz) AS c")
    assert tuple(df.select(*(micros(F.col(c), df.schema[c].dataType) for c in "abc")).first()) == (-1999999, -1999999, None)


def test_copies_and_twins(spark):
    clicks = spark.createDataFrame([(1, 5, 10), (1, 5, 10), (1, None, 10), (1, 6, None)], "click_id long, client_id long, us long").select("click_id", "client_id", F.timestamp_micros("us").alias("ts"))
    assert [tuple(r) for r in clicks_of(clicks).collect()] == [(1, 6, None)]
    sales = spark.createDataFrame([(None, 5, 1.0, 10, 3)], "sale_id long, client_id long, total double, us long, priority int").withColumn("sold_at", F.timestamp_micros("us"))
    assert orders_of(sales).count() == 1


# ---- exact dedup


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_op12(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return out


@pytest.mark.parametrize("size", [4096, 64, 3])
def test_exact_dedup(spark, docs, frame, size):
    if size == 3:  # many levels
        rows = [(k, t and t[:400]) for k, t in docs]
        frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, level string, name int").repartition(3)
        docs = rows
    found = rows_of(exact_dedup(frame, size), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == rows_of(spark.createDataFrame(brute_op12(docs), "a long, b long, c long, d boolean, e string"))


def test_exact_dedup_of_null_ids_and_empty(spark, no_ids, empty):
    assert exact_dedup(empty).collect() == []
    want = brute_op12([tuple(r) for r in no_ids.collect()])
    assert Counter(tuple(r) for r in exact_dedup(no_ids).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == Counter(want)


def test_blocks_join_to_the_text_and_odd_tails_differ(spark):
    texts = ["", "é" * 5000, "a" * 4096, "a" * 4097, "a" * 8192, "b" * 4096 + "a" * 4096, "a" * 4096 + "b" * 4096, "a" * 12288]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    for r in blocks_of(df).orderBy("row", "k").collect():
        pieces.setdefault(r.row, []).append(bytes(r.block))
    assert sorted(b"".join(p).decode() for p in pieces.values()) == sorted(texts)
    named = named_documents(df)
    assert named.select("level", "name").distinct().count() == len(texts)


def test_blocks_of_one_hash_are_told_apart(spark):
    rows = [(r, (r, "d"), 0, 1, r % 2, bytes([65 + r % 3])) for r in range(60)] + [(60, (60, "d"), 0, 1, 9, b"x"), (61, (61, "d"), 0, 1, 9, b"x")]
    blocks = spark.createDataFrame(rows, "row long, doc struct<doc_id: long, digest: string>, k int, n int, hash long, block binary")
    names = {}
    for r in _named_blocks(blocks).collect():
        names.setdefault(r.name, set()).add(rows[r.row][4:])
    assert len(names) == 7 and all(len(v) == 1 for v in names.values())


def test_exact_dedup_takes_linear_time(spark):
    """A text of 16 MB is lowered once, not once a block."""
    df = spark.createDataFrame([(1, "Aé" * 4_000_000), (2, "aé" * 4_000_000)], "doc_id long, text string").repartition(2)
    began = time.time()
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup(df).collect()) == [(1, 2), (2, 2)]
    assert time.time() - began < 60


def test_exact_dedup_runs_no_python(frame):
    plan = exact_dedup(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- filter audit


def brute_audit(masks):
    """masks: (mask, good, toxic) of each document."""
    fails = [lambda m, k=k: m >> k & 1 for k in range(5)]
    rows, totals = [], Counter()
    for order in itertools.permutations(range(5)):
        left = list(masks)
        for step, f in enumerate(order, 1):
            lost = [m for m in left if fails[f](m[0])]
            left = [m for m in left if not fails[f](m[0])]
            totals[f] += len(lost)
            every = [m for m in masks if fails[f](m[0])]
            rows.append(("".join("ABCDE"[x] for x in order), step, len(left), len(lost), len(every) - len(lost), sum(m[0] == 1 << f for m in masks), sum(m[1] for m in lost), sum(m[2] for m in lost), f))
    return sorted((*r[:-1], totals[r[-1]]) for r in rows)


def counted(masks):
    cells = {}
    for m, good, toxic in masks:
        n = cells.setdefault(m, [0, 0, 0])
        n[0] += 1
        n[1] += good
        n[2] += toxic
    return [(m, *n) for m, n in cells.items()]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 1), st.integers(0, 1)), max_size=40))
def test_audit_walk(masks):
    assert sorted(audit(counted(masks), "ABCDE")) == brute_audit(masks)


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def brute_masks(docs, labels):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for i, t, lang in docs:
        t = t or ""
        w = words.findall(t)
        mask = (len(w) < 100) | (100 * len(set(w)) < 80 * len(w)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) << 2 | bool(re.search("[#$%&*|]", t)) << 3
        mask |= (t in first and (i is None or i > first[t])) << 4
        told = [x for x in labels if x[0] == i and i is not None]
        out.setdefault(lang or "", []).append((mask, int(any(x[1] == 1 for x in told)), int(any(x[2] == 1 for x in told))))
    return out


def test_filter_audit(spark, docs):
    rng = random.Random(4)
    rows = [(i, rng.choice([t, t, t and t + rng.choice([" #", " $ ", "|", " AAAA" * 9])]), rng.choice(["en", "de", None, ""])) for i, t in docs]
    rows += [(None, rows[20][1], "en"), (None, None, None), (200, rows[20][1], "de"), (201, rows[20][1], "en")]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i, _, _ in rows for _ in range(rng.randint(0, 2))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit(cells_of(failures(frame), told), "ABCDE")
    have = {}
    for r in found.collect():
        have.setdefault(r.part, []).append(tuple(r)[1:])
    want = brute_masks(rows, labels)
    assert set(have) == set(want)
    for part, masks in want.items():
        assert sorted(have[part]) == brute_audit(masks)


def test_filter_audit_of_empty_tables(spark, empty):
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = empty.withColumn("lang", F.lit("en"))
    assert filter_audit(cells_of(failures(docs), told), "ABCDE").collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert filter_audit(cells_of(failures(one), told), "ABCDE").count() == 600
