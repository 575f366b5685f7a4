import re

import pytest
from pyspark.sql import functions as F

from tessera import create_index, exchange
from tessera.config import Config
from tessera.operators.embedding import HashEmbedder
from tessera.plans.build import known_vectors
from tessera.sources import files as source
from tessera.types import BuildOptions


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.setenv("TESSERA_STATE", str(tmp_path / "state"))
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "skip").mkdir()
    for name in ("a.py", "b.py", "sub/c.py", "skip/d.py"):
        (root / name).write_text(f"def {name[-4]}():\n    value = '{name}' * 20\n    return value\n")
    (root / ".gitignore").write_text("skip/\n")
    return root


def exchanges(df):
    """What each exchange of the plan passes on."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.initialPlan())
            continue
        if name in ("Exchange", "BroadcastExchange"):
            found.append(node.output().mkString(","))
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return found


def test_scan_passes_no_contents_through_an_exchange(spark, tree):
    files = source.scan(spark, str(tree))
    assert sorted(r.filePath for r in files.collect()) == ["a.py", "b.py", "sub/c.py"]
    assert not any("content" in x for x in exchanges(files))
    named = source.scan(spark, str(tree), files=["a.py", "sub/c.py", "gone.py"])
    assert named.count() == 2 and not any("content" in x for x in exchanges(named))
    some = files.join(source.few(files.select("filePath").limit(2)), "filePath").select("filePath", F.length("content").alias("n"))
    assert not any(re.search(r"content|\bn#", x) for x in exchanges(some))


def test_stored_vectors_stay_where_they_are(spark, monkeypatch):
    stored = spark.createDataFrame([("h", f"c{k % 30}", [float(k), 1.0] if k % 7 else None) for k in range(90)], "context string, content string, vector array<float>")
    new = spark.createDataFrame([("h", "c1"), ("h", "c2"), ("h", "other")], "context string, content string").select(F.sha2(F.concat_ws("\n", "context", "content"), 256).alias("embedKey"))
    found = known_vectors(stored, new)
    assert found.count() == 2
    before = [x for x in exchanges(found.sparkSession.createDataFrame([], "a int"))]
    assert before == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan
    monkeypatch.setattr(source, "FEW", 1)
    assert known_vectors(stored, new).count() == 2


def test_a_build_asks_for_each_text_once(spark, tree):
    model = HashEmbedder(16)
    idx = create_index(spark, str(tree), Config("hash:16"), embedder=model)
    said = []
    first = idx.build(BuildOptions(on_progress=lambda *x: said.append(x)))
    assert first.succeeded == 3 and ("embed", 0, 3) in said and ("store", 3, 3) in said
    assert not idx.store.folder.exists("staging") or idx.store.folder.names("staging") == []
    assert idx.store.metadata()["dimensions"] == 16
    (tree / "a.py").write_text("def a():\n    value = 'new' * 20\n    return value\n")
    assert idx.build().succeeded == 1
    idx.close()


def odd_model():
    """One whose vectors are of another length than the query's for some texts."""

    class Odd(HashEmbedder):
        def embed(self, texts):
            return [v[:-1] if "sub/c.py" in t else v for t, v in zip(texts, super().embed(texts), strict=True)]

    return Odd(16)


def test_a_first_build_checks_dimensions(spark, tree):
    idx = create_index(spark, str(tree), Config("hash:16"), embedder=odd_model())
    done = idx.build()
    assert (done.succeeded, done.failed) == (2, 1)
    assert {r.n for r in idx.store.chunks().select(F.size("vector").alias("n")).collect()} == {16}
    idx.close()


def test_tables_are_of_one_commit(spark, tree, tmp_path):
    idx = create_index(spark, str(tree), Config("hash:16"))
    idx.build()
    tables = idx.store.tables()
    idx.store.reset()
    assert tables["chunks"].count() == 3 == tables["files"].count()
    assert exchange.export(idx.store, str(tmp_path / "out")) == {"chunks": 0, "files": 0}
    idx.close()
