"""The registered queries and, where SQL can express them, their SQL for DuckDB.

``documents`` stands for a source tree (path = source/doc_id.lang), ``embeddings``
for chunk vectors (label = type), even and odd ids or languages for branches,
``events`` for change events, ``pages`` for HTML files, ``conversations`` for queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import exchange
from ..functions import secrets
from ..functions import text as T
from ..operators import changes, chunking, knn, stats
from ..operators.embedding import HashEmbedder, batch_totals, embedded
from ..sources import files as tree
from ..sources import snapshots
from ..streaming.watch import debounced
from ..types import SearchOptions
from .search import Target, filtered, search, tagged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- nearest neighbours ------------------------------------------------------------------------------------------

PROBE, NEGATIVE, K = 0, 7, 10


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def vector_of(rows: DataFrame, key: int) -> list[float]:
    return [float(x) for x in rows.where(F.col("id") == key).select("vector").first()[0]]


def searchable(rows: DataFrame) -> DataFrame:
    """Vectors as chunk rows of an index: the path is the id with the label for its extension, the file hash is the id."""
    blank = F.lit("")
    path = F.concat_ws("", F.col("id"), F.lit("."), "label")
    return rows.select("id", "vector", path.alias("filePath"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"), F.col("label").cast("string").alias("type"), blank.alias("name"), blank.alias("content"), blank.alias("context"), F.col("id").cast("string").alias("fileHash"))


def asked(spark: SparkSession, sf_dir: str, options: SearchOptions, negative: int | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """A search through the library, with the columns of ``ranked``."""
    rows = vectors(spark, sf_dir)
    found = search([Target(searchable(rows), manifest)], vector_of(rows, PROBE), options, None if negative is None else vector_of(rows, negative))
    return found.select(F.substring_index("filePath", ".", 1).cast("long").alias("id"), F.col("type").cast("int").alias("label"), "score")


def ranked(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("id").alias("vec_id"), *more, (F.round("score", 6) + 0.0).alias("score"))


_P = f"(SELECT embedding AS p FROM embeddings WHERE vec_id = {PROBE})"
_SQUARES = "list_sum(list_transform(range(1, len(p) + 1), lambda i: power(CAST({x}[i] AS DOUBLE) - CAST(p[i] AS DOUBLE), 2)))"
_L2 = _SQUARES.format(x="embedding")
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_SCORE = "round(1 - d, 6) + 0.0 AS score"


def _top(where: str = "true", distance: str = _L2, k: int = K, columns: str = "vec_id, label") -> str:
    return f"SELECT {columns}, d FROM (SELECT *, {distance} AS d FROM embeddings, {_P} WHERE {where}) ORDER BY d, vec_id LIMIT {k}"


@query(f"SELECT vec_id, label, {_SCORE} FROM ({_top('label IN (1, 2, 3)')})")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return ranked(knn.top_k(rows.where(F.col("label").isin(1, 2, 3)), vector_of(rows, PROBE), K), "label")


@query(f"SELECT vec_id, label, {_SCORE} FROM ({_top('label = 4', k=25)})")
def knn_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(asked(spark, sf_dir, SearchOptions(25, type=["4"])), "label")


@query(f"SELECT vec_id, label, {_SCORE} FROM ({_top(distance='1 - ' + _DOT.format(a='embedding', b='p') + ' / sqrt(' + _DOT.format(a='p', b='p') + ' * ' + _DOT.format(a='embedding', b='embedding') + ')')})")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return ranked(knn.top_k(rows, vector_of(rows, PROBE), K, "cosine"), "label")


@query(f"SELECT vec_id, label, {_SCORE} FROM ({_top(distance='-' + _DOT.format(a='embedding', b='p'))})")
def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return ranked(knn.top_k(rows, vector_of(rows, PROBE), K, "dot"), "label")


_NEG = f"(SELECT list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) - 0.5 * CAST(b.embedding[i] AS DOUBLE)) AS p FROM embeddings a, embeddings b WHERE a.vec_id = {PROBE} AND b.vec_id = {NEGATIVE})"


@query(f"SELECT vec_id, {_SCORE} FROM (SELECT vec_id, {_L2} AS d FROM embeddings, {_NEG}) ORDER BY d, vec_id LIMIT 25")
def knn_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(asked(spark, sf_dir, SearchOptions(25), NEGATIVE))


@query(f"SELECT vec_id, label, {_SCORE} FROM ({_top(k=25)}) WHERE 1 - d >= -0.5")
def knn_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(asked(spark, sf_dir, SearchOptions(25, min_score=-0.5)), "label")


@query(f"SELECT vec_id, label, {_SCORE} FROM ({_top('EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id AND doc_id % 2 = 0)')})")
def knn_branch_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    manifest = searchable(vectors(spark, sf_dir)).join(even, "id", "left_semi").select("filePath", "fileHash")
    return ranked(asked(spark, sf_dir, SearchOptions(K), manifest=manifest), "label")


@query(f"SELECT vec_id, project, {_SCORE} FROM (SELECT * FROM (SELECT *, 'even' AS project FROM ({_top('label % 2 = 0')})) UNION ALL SELECT * FROM (SELECT *, 'odd' AS project FROM ({_top('label % 2 = 1')}))) ORDER BY d, vec_id LIMIT {K}")
def knn_multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    probe = vector_of(rows, PROBE)
    parts = [knn.top_k(rows.where(F.col("label") % 2 == side), probe, K).withColumn("project", F.lit(name)) for side, name in ((0, "even"), (1, "odd"))]
    return ranked(knn.merge(parts, K), "project")


@query(f"SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, {_SCORE} FROM (SELECT q.vec_id AS query_id, e.vec_id, d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, e.vec_id) AS rank FROM (SELECT *, embedding AS p FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e, LATERAL (SELECT {_SQUARES.format(x='e.embedding')} AS d)) WHERE rank <= {K}")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    found = knn.batch_top_k(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), K)
    return ranked(found, "query_id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT vec_id, label, {_SCORE} FROM ({_top(k=25)}) WHERE label IN (1, 2, 3)")
def knn_postfilter_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(asked(spark, sf_dir, SearchOptions(25, language=["1", "2", "3"], compat=True)), "label")


# ---- files, hashes, chunks ---------------------------------------------------------------------------------------

_FILES = "(SELECT source || '/' || doc_id || '.' || lang AS filePath, substr(sha256(text), 1, 16) AS fileHash, * FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("filePath"), T.short_hash(F.col("text")).alias("fileHash"), *docs.columns)


@query(f"SELECT filePath, fileHash FROM {_FILES}")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("filePath", "fileHash")


_CUT = f"(SELECT filePath, lang, row, least(row + 50, len(lines)) AS last, array_to_string(lines[row + 1 : row + 50], chr(10)) AS content FROM (SELECT *, string_split(text, chr(10)) AS lines FROM {_FILES}), LATERAL (SELECT unnest(generate_series(0, len(lines) - 1, 25)) AS row))"
_CHUNKS = f"(SELECT filePath || ':' || row || ':' || hash AS id, filePath, CAST(row + 1 AS INTEGER) AS startLine, CAST(last AS INTEGER) AS endLine, 'block' AS type, 'lines_' || (row + 1) || '_' || last AS name, content, '[file: ' || filePath || ']' AS context, hash, lang FROM (SELECT *, substr(sha256(content), 1, 16) AS hash FROM {_CUT} WHERE regexp_matches(content, '\\S')))"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.window_chunks(files(spark, sf_dir).select("filePath", "text", "lang"))


@query(f"SELECT * FROM {_CHUNKS}")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@query(f"SELECT id, context || chr(10) || '[role: ' || CASE WHEN startLine = 1 THEN 'definition' ELSE 'implementation' END || ']' || CASE WHEN startLine > 1 THEN chr(10) || '[scope: ' || lang || ' ' || name || ']' ELSE '' END AS context FROM {_CHUNKS}")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("startLine") == 1, "class_definition").otherwise("block")
    scope = F.when(F.col("startLine") > 1, F.concat_ws(" ", T.scope_kind(F.col("lang")), "name"))
    return chunks(spark, sf_dir).select("id", T.context_header(F.col("filePath"), T.role(kind), scope, F.lit(None).cast("string")).alias("context"))


@query(f"SELECT id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM {_CHUNKS}")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("id", T.token_estimate(F.col("content"), exact=True).alias("tokens"))


@query(f"SELECT id FROM {_CHUNKS} WHERE ceil((length(context) + length(content)) / 4.0) <= 512")
def oversize_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.within_size(chunks(spark, sf_dir), 512).select("id")


@query(f"SELECT id, context || chr(10) || content AS embed_text FROM {_CHUNKS}")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("id", T.embed_text(F.col("context"), F.col("content")).alias("embed_text"))


_SIDES = f"old AS (SELECT * FROM {_FILES} WHERE doc_id % 2 = 0), new AS (SELECT * FROM {_FILES} WHERE doc_id % 2 = 1)"


@query(f"WITH c AS (SELECT * FROM {_CHUNKS}) SELECT id, hash FROM c WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = 'en' AND b.hash = c.hash)")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return changes.new_chunks(rows.where("lang <> 'en'"), rows.where("lang = 'en'")).select("id", "hash")


@query(f"WITH {_SIDES} SELECT filePath, EXISTS (SELECT 1 FROM old WHERE old.fileHash = new.fileHash) AS known FROM new")
def known_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    known, novel = changes.known_content(rows.where("doc_id % 2 = 1").select("filePath", "fileHash"), rows.where("doc_id % 2 = 0"))
    return known.select("filePath", F.lit(True).alias("known")).unionByName(novel.select("filePath", F.lit(False).alias("known")))


@query(f"SELECT count(*) AS chunks, count(DISTINCT hash) AS hashes, count(*) - count(DISTINCT hash) AS repeats FROM {_CHUNKS}")
def intra_batch_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.repeats(chunks(spark, sf_dir))


# ---- change detection, maintenance, repair -----------------------------------------------------------------------

_THEN = f"(SELECT filePath, fileHash, doc_id, lang FROM {_FILES} WHERE doc_id % 10 <> 0)"
_NOW = f"(SELECT filePath, substr(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END), 1, 16) AS fileHash, doc_id, lang FROM {_FILES} WHERE doc_id % 7 <> 0)"


def then(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("doc_id % 10 <> 0").select("filePath", "fileHash", "doc_id", "lang")


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return files(spark, sf_dir).where("doc_id % 7 <> 0").select("filePath", T.short_hash(edited).alias("fileHash"), "doc_id", "lang")


_DIFF = f"(SELECT coalesce(n.filePath, t.filePath) AS filePath, CASE WHEN t.filePath IS NULL THEN 'added' WHEN n.filePath IS NULL THEN 'deleted' WHEN n.fileHash <> t.fileHash THEN 'modified' END AS kind FROM {_NOW} n FULL JOIN {_THEN} t ON n.filePath = t.filePath)"


@query(f"SELECT * FROM {_DIFF} WHERE kind IS NOT NULL")
def changes_added_modified_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.working_tree(now(spark, sf_dir), then(spark, sf_dir))


@query(f"SELECT kind, count(*) AS n, (SELECT string_agg(filePath, ',' ORDER BY filePath) FROM (SELECT filePath FROM {_DIFF} i WHERE i.kind = o.kind ORDER BY filePath LIMIT 10)) AS first, greatest(count(*) - 10, 0) AS more FROM {_DIFF} o WHERE kind IS NOT NULL GROUP BY kind")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.change_summary(changes.working_tree(now(spark, sf_dir), then(spark, sf_dir)))


@query(f"SELECT n.filePath, n.fileHash FROM {_NOW} n LEFT JOIN {_THEN} t ON n.filePath = t.filePath WHERE n.fileHash IS DISTINCT FROM t.fileHash")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed(now(spark, sf_dir).select("filePath", "fileHash"), then(spark, sf_dir))


@query(f"SELECT filePath, fileHash FROM {_NOW}")
def change_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed(now(spark, sf_dir).select("filePath", "fileHash"), then(spark, sf_dir), force=True)


def branched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest: every document on ``main``, every third also on ``work``."""
    rows = files(spark, sf_dir).select("filePath", "fileHash", "doc_id")
    return rows.withColumn("branch", F.lit("main")).unionByName(rows.where("doc_id % 3 = 0").withColumn("branch", F.lit("work")))


_BRANCHED = f"(SELECT filePath, fileHash, doc_id, 'main' AS branch FROM {_FILES} UNION ALL SELECT filePath, fileHash, doc_id, 'work' FROM {_FILES} WHERE doc_id % 3 = 0)"


@query(f"WITH c AS (SELECT DISTINCT filePath FROM {_CHUNKS} UNION SELECT filePath FROM {_THEN}) SELECT filePath FROM c WHERE NOT EXISTS (SELECT 1 FROM {_NOW} n WHERE n.filePath = c.filePath)")
def repair_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.orphans(chunks(spark, sf_dir), then(spark, sf_dir), now(spark, sf_dir))


@query(f"SELECT t.filePath FROM {_THEN} t JOIN {_NOW} n ON t.filePath = n.filePath WHERE t.fileHash <> n.fileHash")
def repair_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.stale(then(spark, sf_dir).withColumn("branch", F.lit("main")), now(spark, sf_dir), "main")


@query(f"WITH c AS (SELECT * FROM {_CHUNKS}), a AS (SELECT DISTINCT filePath, hash FROM c), b AS (SELECT DISTINCT filePath, CASE WHEN startLine > 1 THEN substr(sha256(content || '!'), 1, 16) ELSE hash END AS hash FROM c) SELECT DISTINCT coalesce(a.filePath, b.filePath) AS filePath FROM a FULL JOIN b ON a.filePath = b.filePath AND a.hash = b.hash WHERE a.hash IS NULL OR b.hash IS NULL")
def repair_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = chunks(spark, sf_dir)
    fresh = stored.withColumn("hash", F.when(F.col("startLine") > 1, T.short_hash(F.concat("content", F.lit("!")))).otherwise(F.col("hash")))
    return changes.mismatched(stored, fresh)


@query(f"SELECT id FROM {_CHUNKS} c WHERE filePath NOT IN (SELECT filePath FROM {_FILES} WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0)")
def delete_branch_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = files(spark, sf_dir).where("doc_id % 2 = 0").select("filePath")
    return changes.delete_chunks(chunks(spark, sf_dir), gone, branched(spark, sf_dir), "main").select("id")


@query(f"SELECT filePath, fileHash, branch FROM {_BRANCHED} m WHERE NOT EXISTS (SELECT 1 FROM {_NOW} n WHERE n.filePath = m.filePath AND m.branch = 'work') UNION ALL SELECT filePath, fileHash, 'work' FROM {_NOW}")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.upsert(branched(spark, sf_dir), now(spark, sf_dir).withColumn("branch", F.lit("work")))


@query(f"SELECT filePath, fileHash, branch FROM {_BRANCHED} UNION ALL SELECT filePath, fileHash, 'next' FROM {_BRANCHED} WHERE branch = 'work'")
def manifest_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.copy_branch(branched(spark, sf_dir), "work", "next")


@query(f"SELECT filePath, fileHash, branch FROM {_BRANCHED} m WHERE NOT (branch = 'main' AND EXISTS (SELECT 1 FROM {_NOW} n WHERE n.filePath = m.filePath))")
def manifest_delete_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.delete_entries(branched(spark, sf_dir), "main", now(spark, sf_dir))


@query(f"SELECT filePath, fileHash, branch FROM {_BRANCHED} WHERE branch IN ('main')")
def branch_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.sweep(branched(spark, sf_dir), spark.createDataFrame([("main",)], "branch string"))


@query(f"SELECT filePath, fileHash FROM {_BRANCHED} WHERE branch <> 'work'")
def branch_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.delete_branch(branched(spark, sf_dir), "work").select("filePath", "fileHash")


@query("SELECT branch FROM (SELECT source AS branch, count(*) % 5 AS commits FROM documents WHERE source IS NOT NULL GROUP BY source) ORDER BY commits, branch LIMIT 1")
def bootstrap_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as branches, as many commits away as their documents leave by five."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("branch")).agg((F.count("*") % 5).alias("commits"))
    return changes.nearest_branch(rows)


@query(f"SELECT filePath FROM {_FILES} f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 0)")
def failed_file_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    failed = rows.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi").select("filePath", F.lit(None).cast("array<float>").alias("vector"))
    return changes.complete_files(rows.select("filePath"), failed)


@query("SELECT 'p' || doc_id AS source, 't' || (doc_id % 400) AS target, CASE WHEN doc_id % 400 < 40 THEN 'exists' WHEN row_number() OVER (PARTITION BY doc_id % 400 ORDER BY 'p' || doc_id) > 1 THEN 'conflict' ELSE 'move' END AS outcome FROM documents")
def migrate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id").alias("source"), F.concat(F.lit("t"), F.col("doc_id") % 400).alias("target"))
    return changes.move_targets(moves, spark.range(40).select(F.concat(F.lit("t"), "id").alias("target")))


# ---- statistics --------------------------------------------------------------------------------------------------


@query(f"SELECT (SELECT count(DISTINCT filePath) FROM {_FILES}) AS files, count(*) AS chunks, count(DISTINCT hash) AS unique_hashes, count(*) - count(DISTINCT hash) AS duplicates FROM {_CHUNKS}")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.index_stats(chunks(spark, sf_dir), files(spark, sf_dir))


@query(f"SELECT filePath, string_agg(hash, ',' ORDER BY hash) AS hashes, count(*) AS chunks FROM {_CHUNKS} GROUP BY filePath")
def files_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hashes_by_file(chunks(spark, sf_dir))


@query(f"SELECT DISTINCT branch FROM {_BRANCHED}")
def branch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.branches(branched(spark, sf_dir))


@query(f"SELECT DISTINCT hash FROM {_CHUNKS}")
def distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hashes(chunks(spark, sf_dir))


@query(f"SELECT filePath, min(startLine) AS rank FROM {_CHUNKS} GROUP BY filePath")
def compact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_seen_files(chunks(spark, sf_dir).withColumnRenamed("startLine", "rank"))


@query(f"SELECT count(*) FILTER (t <= 400 AND lang = 'en') AS succeeded, count(*) FILTER (t <= 400 AND lang <> 'en') AS failed, count(*) FILTER (t > 400) AS oversize FROM (SELECT ceil(length(content) / 4.0) AS t, lang FROM {_CHUNKS})")
def build_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select(T.token_estimate(F.col("content")).alias("tokens"), F.when(F.col("lang") == "en", F.array(F.lit(1.0))).alias("vector"))
    return stats.build_totals(rows, 400)


# ---- filters and scalar functions --------------------------------------------------------------------------------


@query(f"SELECT filePath FROM {_FILES} WHERE starts_with(filePath, 'src1')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(files(spark, sf_dir), SearchOptions(), "src1").select("filePath")


@query(f"SELECT filePath FROM {_FILES} WHERE regexp_extract(filePath, '(\\.[^.]*)$', 1) IN ('.de', '.fr')")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import in_languages

    return in_languages(files(spark, sf_dir).select("filePath"), ["de", ".fr"])


@query(f"SELECT filePath, length(text) + 2 AS n, text || chr(65533) || '!' AS text FROM {_FILES}")
def read_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with a byte that is no UTF-8, read as a build reads them."""
    content = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF21")))
    text = T.utf8(content)
    return files(spark, sf_dir).select("filePath", F.length(text).alias("n"), text.alias("text"))


@query(f"SELECT CAST(floor(k / 100) AS BIGINT) AS batch, count(*) AS texts, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS k, ceil(length(content) / 4.0) AS tokens FROM (SELECT DISTINCT id, content FROM {_CHUNKS})) GROUP BY ALL")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_totals(chunks(spark, sf_dir).dropDuplicates(["id"]), 100, "content")


@query(f"WITH old AS {_THEN}, new AS {_NOW} SELECT filePath, fileHash, 'main' AS branch, 'add' AS change FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.filePath = new.filePath AND old.fileHash = new.fileHash) UNION ALL SELECT filePath, NULL, 'main', 'go' FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE old.filePath = new.filePath AND old.fileHash = new.fileHash)")
def manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a commit writes of a manifest that becomes another: rows to add and keys that go."""
    named = lambda df: df.select("filePath", "fileHash", F.lit("main").alias("branch"))
    add, go = changes.manifest_change(named(then(spark, sf_dir)), named(now(spark, sf_dir)))
    return add.select("filePath", "fileHash", "branch", F.lit("add").alias("change")).unionByName(go.select("filePath", F.lit(None).cast("string").alias("fileHash"), "branch", F.lit("go").alias("change")))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def mtime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files, by their time in UTC, within ten days of the 30th."""
    since_epoch = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    listed = table(spark, sf_dir, "events").withColumn("modificationTime", F.timestamp_micros(since_epoch))
    return tree.modified_since(listed, 1_706_572_800_000, 10 * 86_400_000).select("event_id")


@query("SELECT page_id, slug || '-' || substr(sha256(url), 1, 8) AS slug FROM (SELECT page_id, url, regexp_replace(array_to_string(list_slice(p, greatest(len(p) - 1, 1), len(p)), '-'), '[^A-Za-z0-9_-]', '_', 'g') AS slug FROM (SELECT *, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/'), lambda x: x <> '') AS p FROM pages))")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def of_place(key: str, *values: str) -> Column:
    """One of some strings by a number, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _in_turn(key: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


_PROVIDERS, _TAGS = ("", "openai:", "ollama:"), ("", ":latest", ":Q4_K_M", ":v2", ":GGUF", ":fp16", ":q8_0")
_MODELS = f"(SELECT doc_id, p || n || t AS model, CASE WHEN p = '' AND t = '' THEN n WHEN p = '' THEN substr(t, 2) WHEN t IN ('', ':v2') THEN n || t ELSE n END AS family FROM (SELECT doc_id, {_in_turn('doc_id', *_PROVIDERS)} AS p, source || '-' || lang AS n, {_in_turn('doc_id', *_TAGS)} AS t FROM documents))"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model name for each document: with or without a provider and a tag."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(of_place("doc_id", *_PROVIDERS), "source", F.lit("-"), "lang", of_place("doc_id", *_TAGS)).alias("model"))


@query(f"SELECT doc_id, model, family FROM {_MODELS}")
def model_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).select("doc_id", "model", T.model_family(F.col("model")).alias("family"))


@query(f"SELECT doc_id, model FROM {_MODELS} WHERE family = 'src1-en'")
def compatible_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.same_family(models(spark, sf_dir), F.lit("other:src1-en:gguf"))


@query(f"SELECT doc_id, n_chars % 90 || {_in_turn('doc_id', '', ' ', '  ')} || u AS duration, CAST(n_chars % 90 * CASE u WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 86400000 END AS BIGINT) AS ms FROM (SELECT *, {_in_turn('doc_id', 's', 'm', 'h', 'd')} AS u FROM documents)")
def duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duration for each document: its length by ninety, in one of four units."""
    text = F.concat((F.col("n_chars") % 90).cast("string"), of_place("doc_id", "", " ", "  "), of_place("doc_id", "s", "m", "h", "d"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("duration")).select("doc_id", "duration", T.duration_ms(F.col("duration")).alias("ms"))


@query("SELECT page_id, regexp_extract(url, '[^/](\\.[^./]*)$', 1) AS ext, CASE WHEN contains(url, '.') THEN regexp_extract(url, '(\\.[^.]*)$', 1) ELSE right(url, 1) END AS tail FROM pages")
def extname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("ext"), T.after_last_dot(F.col("url")).alias("tail"))


@query("SELECT doc_id, source || ':' || doc_id || '-' || n_chars || ' [' || lang || '] d' AS location, printf('%.3f', doc_id / 7.0) AS score FROM documents")
def result_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.location(F.col("source"), F.col("doc_id"), F.col("n_chars"), F.col("lang"), F.lit("d")).alias("location"), T.fixed_score(F.col("doc_id") / 7.0).alias("score"))


@query("SELECT page_id, page_id % 5 IN (0, 1, 3) AS local FROM pages")
def local_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as services: most at a host of their own made local, some as they are, some no URL at all."""
    host = of_place("page_id", "http://localhost:11434/", "http://127.0.0.1/", "nonsense ", "http://[::1]:80/", "")
    return table(spark, sf_dir, "pages").select("page_id", T.is_local_url(F.concat(host, F.when(F.col("page_id") % 5 == 4, F.col("url")).otherwise(F.col("page_id").cast("string")))).alias("local"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 4 = 1 THEN 'mcp' WHEN doc_id % 4 = 2 THEN 'serve' ELSE 'cli' END AS kind FROM documents")
def process_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process for each document: its name and command line."""
    rows = table(spark, sf_dir, "documents").select("doc_id", of_place("doc_id", "tessera-mcp", *["node"] * 6).alias("name"), F.concat("source", of_place("doc_id", " run", " run mcp", " run serve", " index")).alias("command"))
    return rows.select("doc_id", T.process_kind(F.col("name"), F.col("command")).alias("kind"))


@query("SELECT doc_id, lang || ' , ' || source AS list, len(string_split(lang || ',' || source, ',')) AS n, lang || '|' || source AS items FROM documents")
def comma_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.comma_list(F.col("list"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" , ", "lang", "source").alias("list")).select("doc_id", "list", F.size(items).cast("long").alias("n"), F.array_join(items, "|").alias("items"))


@query(f"SELECT filePath, fileHash FROM {_FILES} ORDER BY filePath LIMIT 50 OFFSET 100")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a scan in a total order."""
    return snapshots.page(files(spark, sf_dir).select("filePath", "fileHash"), ["filePath"], 50, 100)


@query(f"SELECT filePath, fileHash, CASE WHEN doc_id % 4 = 0 THEN 'main' ELSE lang END AS branch FROM {_FILES}")
def null_branch_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of before there were branches belong to the current one."""
    rows = files(spark, sf_dir).withColumn("branch", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    return snapshots.with_branch(rows, "main").select("filePath", "fileHash", "branch")


@query(f"SELECT filePath, fileHash FROM {_BRANCHED} WHERE branch <> 'main' AND filePath IN (SELECT filePath FROM {_NOW})")
def other_branches_have(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.elsewhere(now(spark, sf_dir), branched(spark, sf_dir), "main").select("filePath", "fileHash")


@query(f"SELECT filePath FROM {_CHUNKS} UNION SELECT filePath FROM {_THEN}")
def union_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.indexed_paths(chunks(spark, sf_dir), then(spark, sf_dir))


@query("SELECT CAST(max(len(embedding)) AS INTEGER) AS dimensions FROM embeddings")
def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dimension(vectors(spark, sf_dir))


@query(f"SELECT '/srv/other/' || filePath AS filePath FROM {_FILES}")
def project_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(files(spark, sf_dir), "/srv/other").select("filePath")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'anonymous_' || doc_id END AS name FROM documents")
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.node_name(named, F.col("doc_id")).alias("name"))


_KINDS = {"class_definition": ("definition", "class"), "impl_item": ("implementation", "impl"), "export_statement": ("orchestration", "export_statement"), "ContainerDecl": ("definition", "container"), "pair": ("implementation", "pair")}


@query("SELECT doc_id, type, role, scope FROM documents JOIN (VALUES " + ", ".join(repr((n, k, *v)) for n, (k, v) in enumerate(_KINDS.items())) + f") t(n, type, role, scope) ON doc_id % {len(_KINDS)} = n")
def roles_and_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", of_place("doc_id", *_KINDS).alias("type"))
    return rows.select("doc_id", "type", T.role(F.col("type")).alias("role"), T.scope_kind(F.col("type")).alias("scope"))


_ENDS = {".py": "python", ".tsx": "tsx", ".hpp": "cpp", ".sql": None, "": None}


@query("SELECT doc_id, source || '/' || doc_id || e AS filePath, language FROM documents JOIN (VALUES " + ", ".join(f"({n}, {e!r}, {'NULL' if x is None else repr(x)})" for n, (e, x) in enumerate(_ENDS.items())) + f") t(n, e, language) ON doc_id % {len(_ENDS)} = n")
def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", of_place("doc_id", *_ENDS)).alias("filePath"))
    return rows.select("doc_id", "filePath", T.language(F.col("filePath")).alias("language"))


@query(f"SELECT doc_id, {_in_turn('doc_id', 'tesseraamber', 'tessera', 'amber', 'tesseraAmber')} || substr(sha256(text), 1, 10) AS code, doc_id % 4 = 0 AS valid FROM documents")
def share_code_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code for each document: a quarter of them well formed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(of_place("doc_id", "tesseraamber", "tessera", "amber", "tesseraAmber"), F.substring(F.sha2("text", 256), 1, 10)).alias("code"))
    return rows.select("doc_id", "code", secrets.is_share_code(F.col("code")).alias("valid"))


@query(f"WITH c AS (SELECT id, lang FROM {_CHUNKS}) SELECT id FROM c WHERE lang IN ('en', 'de') UNION SELECT id FROM c WHERE lang IN ('de', 'fr')")
def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported chunks join the stored ones but for ids that are there."""
    rows = chunks(spark, sf_dir).withColumn("fileHash", F.col("hash"))
    stored, brought = rows.where("lang IN ('en', 'de')"), rows.where("lang IN ('de', 'fr')")
    return stored.unionByName(exchange.new_rows(brought, stored)).select("id")


# ---- text search -------------------------------------------------------------------------------------------------

DIMENSIONS = 64
_TOKENS = "SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS tok FROM documents"
_BUCKETS = f"(SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {DIMENSIONS} AS bucket, count(*) AS tf FROM ({_TOKENS}) WHERE tok <> '' GROUP BY ALL)"


def buckets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Hashed term frequencies as Catalyst has them: (key, bucket, tf)."""
    tokens = F.explode(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " "))
    return rows.select(key, tokens.alias("tok")).where("tok <> ''").groupBy(key, (F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("long") % DIMENSIONS).alias("bucket")).agg(F.count("*").alias("tf"))


@query(f"SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tokens, round(sqrt(sum(tf * tf)), 6) AS norm FROM {_BUCKETS} GROUP BY doc_id")
def text_embed_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.round(F.sqrt(F.sum(F.col("tf") * F.col("tf"))), 6).alias("norm"))


_QUERY_DOC = 3


@query(f"WITH b AS (SELECT * FROM {_BUCKETS}), n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM b GROUP BY doc_id) SELECT b.doc_id, round(sum(b.tf * q.tf) / max(n.norm) / max(m.norm), 6) AS cosine FROM b JOIN b q ON q.doc_id = {_QUERY_DOC} AND q.bucket = b.bucket JOIN n ON n.doc_id = b.doc_id JOIN n m ON m.doc_id = {_QUERY_DOC} GROUP BY b.doc_id ORDER BY sum(b.tf * q.tf) / max(n.norm) / max(m.norm) DESC, b.doc_id LIMIT 20")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text as the query: embed, then the nearest documents by cosine."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("embedText"))
    model = HashEmbedder(DIMENSIONS)
    probe = model.embed_query(docs.where(F.col("id") == _QUERY_DOC).first()["embedText"])
    near = knn.top_k(embedded(docs, model).select("id", F.col("vector").cast("array<double>").alias("vector")), probe, 20, "cosine")
    return near.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("cosine"))


@query()
def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, embedded and searched with prefix, language and negative text; rows only, as vectors come from Python."""
    model = HashEmbedder(DIMENSIONS)
    rows = chunks(spark, sf_dir).join(files(spark, sf_dir).select("filePath", "fileHash"), "filePath")
    ready = embedded(rows.withColumn("embedText", T.embed_text(F.col("context"), F.col("content"))), model)
    asked = table(spark, sf_dir, "conversations").where("conv_id = 2 AND turn = 0").first()["text"]
    return search([Target(ready, None, "src")], model.embed_query(asked), SearchOptions(limit=10, language=["en"]), model.embed_query("license"))


# ---- change streams, parsers, exchange ---------------------------------------------------------------------------


@query("WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM marked) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM numbered GROUP BY user_id, session")
def watch_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounced(table(spark, sf_dir, "events"), "user_id", gap="30 minutes")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, counted by the kind of change, run until it has caught up."""
    schema = table(spark, sf_dir, "events").schema
    name = f"tessera_events_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    running = stream.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@query()
def chunk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at their elements; rows only, as a parser decides."""
    return chunking.syntax_chunks(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("filePath"), F.col("html").alias("text")))


#: What can't stand as it is in a string of Python source, and how it is written: fixed values.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\0", "\\x00"))


@query()
def chunk_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each document, whose whole text is in a method, cut at its definitions; rows only, as a parser decides."""
    text = F.coalesce("text", F.lit(""))
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    body = F.concat(F.lit("import os\n\n\nclass A"), "doc_id", F.lit(':\n    def run(self):\n        """'), text, F.lit('"""\n        return 1\n'))
    return chunking.syntax_chunks(table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), "doc_id", F.lit(".py")).alias("filePath"), body.alias("text")))


@query("SELECT doc_id, text FROM documents")
def sealed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "tesseraamberbirch0123456789"
    sealed = table(spark, sf_dir, "documents").select("doc_id", secrets.sealed(F.encode("text", "UTF-8"), code).alias("payload"))
    return sealed.select("doc_id", F.decode(secrets.opened(F.col("payload"), code), "UTF-8").alias("text"))
