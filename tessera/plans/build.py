"""From a source tree to an index: scan, diff, chunk, reuse, embed, commit.

Chunks and the vectors made for them are written once, to a folder of the store that goes after the commit, so a lost
executor costs no text a second embedding and what is counted is what is stored; two tables then change in one commit.
Files whose content any branch has are not read again: their rows are made from stored ones. What is stored meets
what is new by a semi-join on keys: neither file contents nor stored vectors are shuffled while the new keys are few.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_id, duration_ms, embed_text, utf8
from ..operators import changes
from ..operators.chunking import syntax_chunks, within_size
from ..operators.embedding import Embedder, embedded
from ..sources import files as source
from ..sources.snapshots import Store
from ..types import BuildOptions, BuildResult


def known_vectors(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """(embedKey, vector) of stored rows, once for each of the new keys that has one."""
    held = stored.where("vector IS NOT NULL").select(embed_key().alias("embedKey"), "vector")
    return held.join(source.few(keys), "embedKey", "left_semi").dropDuplicates(["embedKey"])


def embed_key() -> F.Column:
    """Vectors are reused where header and content are equal."""
    return F.sha2(F.concat_ws("\n", "context", "content"), 256)


def build(spark: SparkSession, root: str, store: Store, embedder: Embedder, branch: str = "_default", config: object | None = None, options: BuildOptions | None = None, chunker: Callable[[DataFrame], DataFrame] = syntax_chunks, alive_branches: list[str] | None = None, nearest: list[tuple[str, int]] | None = None) -> BuildResult:
    """nearest: (branch, commits away) of stored branches, for a branch that has no manifest yet."""
    options, out = options or BuildOptions(), BuildResult()
    say = options.on_progress or (lambda phase, current, total: None)
    ignore, include, exclude = (config.ignore, config.extensions.include, config.extensions.exclude) if config else ((), (), ())
    if options.reset and not options.dry:
        store.reset()
    if not options.dry:
        store.folder.delete("staging")  # of a build that didn't end
        store.migrate(branch)
    manifest, stored = store.files(branch).cache(), store.chunks()
    if options.reset:
        manifest, stored = manifest.limit(0), stored.limit(0)
    if nearest and manifest.where(F.col("branch") == branch).isEmpty():
        best = changes.nearest_branch(spark.createDataFrame(nearest, "branch string, commits int")).first()["branch"]
        manifest = changes.copy_branch(manifest, best, branch)
    own = manifest.where(F.col("branch") == branch)

    say("scan", 0, 1)
    tree = source.scan(spark, root, ignore, include, exclude, options.files)
    if options.since:
        span = spark.range(1).select(duration_ms(F.lit(options.since))).first()[0]
        tree = source.modified_since(tree, int(time.time() * 1000), span)
    disk = source.hashed(tree).cache()
    todo = changes.changed(disk, own, options.force).cache()
    full = options.files is None and not options.since
    listed = source.listed(spark, options.files)
    gone = (own.select("filePath") if full else own.select("filePath").join(listed, "filePath", "left_semi")).join(disk.select("filePath"), "filePath", "left_anti").cache()
    held = [manifest, disk, todo, gone]
    if options.dry:
        out.planned = [r[0] for r in todo.select("filePath").unionByName(gone).orderBy("filePath").toLocalIterator()]
        for df in held:
            df.unpersist()
        return out

    old = stored.select("id", "filePath", "fileHash").cache()
    has_rows = old.select("fileHash").distinct()
    known, fresh = (todo.limit(0), todo) if options.force else (todo.join(has_rows, "fileHash", "left_semi"), todo.join(has_rows, "fileHash", "left_anti"))
    out.already_indexed, out.deleted = known.count(), gone.count()
    # A copied or renamed file: the rows of one file of equal content, under the new path.
    model_rows = stored.join(old.groupBy("fileHash").agg(F.min("filePath").alias("filePath")), ["fileHash", "filePath"], "left_semi").drop("filePath")
    moved = known.join(model_rows, "fileHash")
    moved = moved.withColumn("context", F.regexp_replace("context", r"^\[file: [^\n]*\]", F.concat(F.lit("[file: "), F.regexp_replace("filePath", r"([\\$])", r"\\$1"), F.lit("]")))).withColumn("id", chunk_id(F.col("filePath"), F.col("startLine") - 1, F.col("hash")))

    staging = f"staging/{uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{store.folder.path}/{staging}/{name}")
        return spark.read.schema(df.schema).parquet(f"{store.folder.path}/{staging}/{name}")

    say("chunk", 0, 1)
    fresh = source.few(fresh)
    texts = tree.join(fresh, "filePath").select("filePath", utf8(F.col("content")).alias("text"))
    chunks = staged(chunker(texts).join(fresh, "filePath"), "chunks")
    sized = within_size(chunks, config.max_tokens if config else None)
    # Chunks of equal header and content as stored ones keep their vectors.
    keyed = sized.withColumn("embedKey", embed_key())
    vectors = staged(known_vectors(stored.limit(0) if options.force else stored, keyed.select("embedKey").distinct()), "known")
    distinct = keyed.join(vectors, "embedKey", "left_anti").select("embedKey", embed_text(F.col("context"), F.col("content")).alias("embedText")).dropDuplicates(["embedKey"])
    batch, total = config.batch_size if config else 100, distinct.count()
    say("embed", 0, total)
    expected = store.metadata().get("dimensions") or getattr(config, "dimensions", None)
    if total and not expected:  # a first build: the model itself tells, if it answers
        with contextlib.suppress(Exception):
            expected = len(embedder.embed_query("dimensions"))
    made = staged(embedded(distinct, embedder, dimensions=expected, batch=batch, pause_s=getattr(embedder, "pause_s", 0.0)), "made")
    rows = keyed.join(vectors.unionByName(made.select("embedKey", "vector")), "embedKey").select(*sized.columns, "vector")
    counts = rows.agg(F.count_if(F.col("vector").isNotNull()), F.count_if(F.col("vector").isNull())).first()
    out.succeeded, out.failed = counts[0], counts[1]
    out.oversize = chunks.count() - out.succeeded - out.failed

    say("store", 0, out.succeeded)
    complete = changes.complete_files(todo, rows)
    replaced = todo.select("filePath").unionByName(gone)
    # Another branch may have the old content of a path: its rows stay while a manifest row of that path and hash does.
    others = changes.delete_entries(manifest, branch, replaced)
    fresh_rows = rows.where("vector IS NOT NULL").select(stored.columns).unionByName(moved.select(stored.columns))
    superseded = old.join(others.select("filePath", "fileHash").distinct(), ["filePath", "fileHash"], "left_anti").select("id", "fileHash").unionByName(fresh_rows.select("id", "fileHash").join(old, ["id", "fileHash"], "left_semi"))
    entries = complete.select("filePath", "fileHash", F.lit(branch).alias("branch"))
    manifest_after = changes.upsert(others, entries)
    if alive_branches is not None:
        manifest_after = changes.sweep(manifest_after, spark.createDataFrame([(b,) for b in {*alive_branches, branch}], "branch string"))
    store.change(chunks=(fresh_rows, superseded), files=changes.manifest_change(store.files(), manifest_after))
    first = store.chunks().select(F.size("vector")).limit(1).first()
    store.write_metadata(root, branch, getattr(config, "model", None), first[0] if first else None)
    say("store", out.succeeded, out.succeeded)
    for df in (*held, old):
        df.unpersist()
    store.folder.delete(staging)
    return out
