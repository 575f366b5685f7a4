"""Registered queries of the vector and text indexes: cells, quantised codes, the neighbour graph, BM25, phrases, fusion.

Indexes are built anew below spark.checkpoint.dir by each query, from the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn, neighbours
from ..operators.cells import CellIndex
from ..operators.embedding import HashEmbedder, embedded
from ..operators.fulltext import TextIndex
from ..operators.fusion import diversified, fused
from ..operators.quantize import Codebook, quantised_top_k
from ..sources import scratch
from .catalog import _SCORE, _SQUARES, DIMENSIONS, ORACLE_SQL, K, query, ranked, table, vectors

__all__ = ["ORACLE_SQL"]


def asking(rows: DataFrame) -> DataFrame:
    return rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")


def _batch_sql(embeddings: str, every: int) -> str:
    return f"SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, {_SCORE} FROM (SELECT q.vec_id AS query_id, e.vec_id, d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, e.vec_id) AS rank FROM (SELECT *, embedding AS p FROM {embeddings} WHERE vec_id % {every} = 0 AND embedding IS NOT NULL) q, {embeddings} e, LATERAL (SELECT {_SQUARES.format(x='e.embedding')} AS d) WHERE e.embedding IS NOT NULL) WHERE rank <= {K}"


_COPIES = 20
_COPIED = f"(SELECT vec_id * {_COPIES} + j AS vec_id, CASE WHEN (vec_id + j) % 7 <> 3 THEN embedding END AS embedding FROM embeddings, range({_COPIES}) t(j))"


@query(_batch_sql(_COPIED, 1000))
def knn_batch_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector twenty times, some rows without one: ties by id, nulls left out."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1))).alias("j")
    rows = vectors(spark, sf_dir).select("id", "vector", copy).select((F.col("id") * _COPIES + F.col("j")).alias("id"), F.when((F.col("id") + F.col("j")) % 7 != 3, F.col("vector")).alias("vector"))
    found = knn.batch_top_k(rows, rows.where("id % 1000 = 0").withColumnRenamed("id", "query_id"), K)
    return ranked(found, "query_id", F.col("rank").cast("long").alias("rank"))


@query()
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours in as many cells as reach a recall of 0.95; approximate, so tests measure it."""
    rows = vectors(spark, sf_dir)
    found = CellIndex.build(rows, scratch.folder(spark)).top_k(asking(rows), K)
    return ranked(found, "query_id", F.col("rank").cast("long").alias("rank"))


@query(_batch_sql("embeddings", 50))
def ivf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the cells that may hold a neighbour."""
    rows = vectors(spark, sf_dir)
    found = CellIndex.build(rows, scratch.folder(spark)).top_k(asking(rows), K, exact=True)
    return ranked(found, "query_id", F.col("rank").cast("long").alias("rank"))


@query()
def pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours by codes of 16 bytes, ranked again by distance; approximate, so tests measure it."""
    rows = vectors(spark, sf_dir)
    book, path = Codebook.fit(rows, 16), scratch.folder(spark)
    book.encode(rows).write.parquet(path)
    found = quantised_top_k(rows, spark.read.parquet(path), book, asking(rows), K)
    return ranked(found, "query_id", F.col("rank").cast("long").alias("rank"))


@query()
def nn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen nearest nodes of every vector; approximate, so tests measure it."""
    nodes, members = neighbours.classes(vectors(spark, sf_dir))
    edges = neighbours.graph(nodes)
    return members.join(edges, "node").select("id", "node", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x5E\x60\x7B-\x7F]+')"
_SCORED = f"""
words AS (SELECT doc_id AS id, unnest({_WORDS}) AS w FROM documents),
tf AS (SELECT id, w, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT id, count(*) AS dl FROM words GROUP BY id),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
whole AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents) AS mean),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS w FROM benchmark),
scored AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS s
  FROM asked JOIN tf USING (w) JOIN df USING (w) JOIN lengths USING (id), whole GROUP BY query_id, id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored)"""


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex.build(table(spark, sf_dir, "documents"), scratch.folder(spark), "doc_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_SCORED} SELECT query_id, id AS doc_id, round(s, 6) AS score, rank FROM lexical WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are most like each benchmark item by BM25."""
    found = text_index(spark, sf_dir).top_k(items(spark, sf_dir), K)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_LEAD = 4


@query(f"""
WITH words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
runs AS (SELECT doc_id, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {_LEAD - 1} FOLLOWING) AS run FROM words),
asked AS (SELECT item_id AS query_id, array_to_string(({_WORDS})[1:{_LEAD}], ' ') AS run, len({_WORDS}) AS n FROM benchmark)
SELECT query_id, doc_id, count(*) AS places FROM asked JOIN runs USING (run) WHERE n >= {_LEAD} GROUP BY ALL""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold the first four words of a benchmark item in a row."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate("text", capitals, capitals.lower()), F.lit(r"([^\x00-\x2F\x3A-\x5E\x60\x7B-\x7F]+)"))
    asked = items(spark, sf_dir).withColumn("words", words).where(F.size("words") >= _LEAD)
    found = text_index(spark, sf_dir).phrase(asked.select("query_id", F.array_join(F.slice("words", 1, _LEAD), " ").alias("text")))
    return found.select("query_id", F.col("id").alias("doc_id"), "places")


_DEPTH = 50
_BUCKETS_OF = "SELECT {key} AS id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {n} AS bucket, count(*) AS tf FROM (SELECT {key}, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS tok FROM {table}) WHERE tok <> '' GROUP BY ALL"


def dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, rank) of the nearest documents of each item by cosine, rounded so that ties go by id, and the documents' vectors."""
    model = HashEmbedder(DIMENSIONS)
    vector = F.transform("vector", lambda x: x.cast("double"))
    docs = embedded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("embedText")), model)
    asked = embedded(items(spark, sf_dir).select("query_id", F.coalesce("text", F.lit("")).alias("embedText")), model)
    near = knn.batch_top_k(docs.select("id", vector.alias("vector")), asked.select("query_id", vector.alias("vector")), 2 * _DEPTH, "cosine")
    rank = F.row_number().over(knn.Window.partitionBy("query_id").orderBy(F.round("distance", 6), "id"))
    return near.select("query_id", "id", rank.alias("rank")).where(F.col("rank") <= _DEPTH), docs


@query(f"""
WITH {_SCORED},
d AS ({_BUCKETS_OF.format(key='doc_id', n=DIMENSIONS, table='documents')}), q AS ({_BUCKETS_OF.format(key='item_id', n=DIMENSIONS, table='benchmark')}),
dn AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM d GROUP BY id), qn AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM q GROUP BY id),
cosine AS (SELECT q.id AS query_id, d.id, round(1 - sum(d.tf * q.tf) / max(dn.norm) / max(qn.norm), 6) AS gap FROM d JOIN q USING (bucket) JOIN dn ON dn.id = d.id JOIN qn ON qn.id = q.id GROUP BY q.id, d.id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap, id) AS rank FROM cosine),
parts AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM lexical WHERE rank <= {_DEPTH} UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM dense WHERE rank <= {_DEPTH}),
total AS (SELECT query_id, id, round(sum(part), 12) AS s FROM parts GROUP BY query_id, id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM total)
SELECT query_id, id AS doc_id, round(s, 9) AS score, rank FROM placed WHERE rank <= {K}""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and cosine results of each benchmark item, fused by their ranks."""
    lexical = text_index(spark, sf_dir).top_k(items(spark, sf_dir), _DEPTH)
    found = fused([lexical, dense(spark, sf_dir)[0]], K)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def diverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 results of each benchmark item, re-ranked so that copies don't fill them; a greedy choice, tested against plain Python."""
    docs = embedded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("embedText")), HashEmbedder(DIMENSIONS))
    lexical = text_index(spark, sf_dir).top_k(items(spark, sf_dir), _DEPTH)
    found = diversified(lexical.select("query_id", "id", "score").join(docs.select("id", "vector"), "id"), K, depth=_DEPTH)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
