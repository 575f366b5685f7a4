"""Every query with SQL against DuckDB on the same tables."""

import ast
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog, history, retrieval  # noqa: F401  they register their queries with the first

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(tuple(str(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_chunk_python_holds_whole_texts(spark, tmp_path):
    """Every document's text comes back from its chunk; a class above the size limit gives way to its method."""
    texts = {1: "short", 2: 'quotes """ and \\ back\\slashes\\', 3: "lines\n\r\n\rends\0 ünï 漢字 \x0c\u2028 \\n\"", 4: "word " * 9000 + "end", 5: "a line of text\n" * 4000 + "end", 6: ""}
    spark.createDataFrame([*texts.items(), (7, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = catalog.chunk_python(spark, str(tmp_path)).collect()
    assert {r.filePath: r.type for r in chunks} == {f"m{k}.py": "function_definition" if k in (4, 5) else "class_definition" for k in range(1, 8)}
    assert len(chunks) == 7
    for r in chunks:
        head = "" if r.content.startswith("class") else "class A:\n    "
        method = ast.parse(head + r.content.lstrip()).body[0].body[0]
        assert method.body[0].value.value == (texts.get(int(r.filePath[1:-3])) or "")


def test_batch_equals_single(spark):
    batch = {(r.query_id, r.rank): r.vec_id for r in catalog.knn_batch(spark, DATA).collect()}
    everything = catalog.vectors(spark, DATA)
    probe = catalog.vector_of(everything, 50)
    single = [r.id for r in catalog.knn.top_k(everything, probe, catalog.K).orderBy("distance", "id").collect()]
    assert [batch[50, k + 1] for k in range(catalog.K)] == single


def test_batch_in_parts(spark, monkeypatch):
    """More queries than are sent at once, and none."""
    everything = catalog.vectors(spark, DATA)
    queries = everything.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    ask = lambda q: sorted(tuple(r) for r in catalog.knn.batch_top_k(everything, q, 5).collect())
    whole = ask(queries)
    monkeypatch.setattr(catalog.knn, "MOST_QUERIES", 4)
    assert queries.count() > 8 and len(whole) == 5 * queries.count() and ask(queries) == whole
    assert ask(queries.where("query_id < 0")) == []


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    rows_ = catalog.vectors(spark, DATA)
    top = plan(catalog.knn.top_k(rows_.where("label = 4"), [0.0] * 64, 5))
    assert "TakeOrderedAndProject" in top
    assert "EqualTo(label,4)" in top
    assert "LeftAnti" in plan(catalog.chunk_dedup(spark, DATA))
    assert "WindowGroupLimit" in plan(catalog.knn_batch(spark, DATA))
    assert "StringStartsWith(source,src1)" in plan(catalog.table(spark, DATA, "documents").where("startswith(source, 'src1')"))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan(catalog.file_manifest(spark, DATA))
