import random

from pyspark.sql import functions as F

from tessera.operators import stats


def rows_of(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["main", "main", "work", None]), rng.choice(["py", "ts"]), f"f{rng.randrange(n // 5)}", f"h{rng.randrange(n // 2)}", rng.randrange(1000)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "branch string, lang string, filePath string, hash string, tokens long").repartition(4)


def test_rollup(spark):
    rows, df = rows_of(spark, 500)
    found = {(r.level, r.branch, r.lang): (r.files, r.chunks, r.tokens) for r in stats.rollup(df, ["branch", "lang"]).collect()}
    for level, keep in ((0, (0, 1)), (1, (0,)), (2, (1,)), (3, ())):
        groups = {}
        for r in rows:
            groups.setdefault((level, r[0] if 0 in keep else None, r[1] if 1 in keep else None), []).append(r)
        for key, held in groups.items():
            assert found.pop(key) == (len({r[2] for r in held}), len(held), sum(r[4] for r in held))
    assert not found and stats.rollup(df.limit(0), ["lang"]).where("level = 0").count() == 0


def test_sketches_of_versions_add_up(spark):
    """What later versions bring is merged into what is known; errors stay within the sketches' bounds."""
    rows, df = rows_of(spark, 20_000)
    first, second = df.where("hash < 'h5'"), df.where("hash >= 'h5'")
    kept = stats.sketches(first, ["lang"])
    both = stats.merged_sketches(kept.unionByName(stats.sketches(second, ["lang"])), ["lang"])
    for r in stats.estimates(both, ["lang"]).collect():
        held = [x for x in rows if x[1] == r.lang]
        assert r.chunks == len(held)
        assert abs(r.files - len({x[2] for x in held})) <= 0.05 * len({x[2] for x in held})
        assert abs(r.hashes - len({x[3] for x in held})) <= 0.05 * len({x[3] for x in held})
        tokens = sorted(x[4] for x in held)
        for q, told in ((0.5, r.q50), (0.9, r.q90), (0.99, r.q99)):
            assert abs(sum(t <= told for t in tokens) / len(tokens) - q) <= 0.03
    whole = stats.estimates(stats.merged_sketches(both, []), []).first()
    assert whole.chunks == len(rows)
    assert stats.estimates(stats.sketches(df.where(F.lit(False)), ["lang"]), ["lang"]).collect() == []


def test_a_store_keeps_sketches_by_version(spark, tmp_path, monkeypatch):
    """A delta commit adds a sketch of its rows; what is told comes from sketches alone."""
    from tessera.sources import snapshots
    from tessera.types import CHUNKS

    def chunks(a, b):
        return spark.createDataFrame([(f"i{k}", f"f{k // 3}", 1, 2, "t", "n", "x" * (4 * (k % 100)), "c", f"h{k % 700}", f"fh{k // 3}", [0.0]) for k in range(a, b)], CHUNKS)

    store = snapshots.Store(spark, f"{tmp_path}/store")
    assert store.estimates().first().chunks == 0
    store.append(chunks(0, 900))
    store.append(chunks(900, 1500))
    told = store.estimates()
    row = told.first()
    assert row.chunks == 1500 and abs(row.files - 500) <= 25 and abs(row.hashes - 700) <= 35 and abs(row.q50 - 50) <= 3
    assert all("/sketches/" in f for f in told.inputFiles()) and len(store.folder.names("sketches")) == 2
    store.change(chunks=(None, chunks(0, 300)))
    assert store.estimates().first().chunks == 1500  # until the next base
    store.compact()
    assert store.estimates().first().chunks == 1200 and len(store.folder.names("sketches")) == 1
