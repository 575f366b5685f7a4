"""Consistency of an index with the tree: orphans, stale files and chunk mismatches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utf8
from ..operators import changes
from ..operators.chunking import syntax_chunks, within_size
from ..sources import files as source
from ..sources.snapshots import Store
from ..types import RepairResult


def issues(chunks: DataFrame, manifest: DataFrame, tree: DataFrame, branch: str, chunker: Callable[[DataFrame], DataFrame] = syntax_chunks, max_tokens: int | None = None) -> DataFrame:
    """(filePath, issue)."""
    disk = source.hashed(tree)
    own = manifest.where(F.col("branch") == branch)
    gone = changes.orphans(chunks, own, disk)
    old = changes.stale(manifest, disk, branch)
    settled = own.join(disk, ["filePath", "fileHash"], "left_semi")
    stored = chunks.join(settled.select("filePath", "fileHash"), ["filePath", "fileHash"], "left_semi")
    texts = tree.join(settled.select("filePath"), "filePath", "left_semi").select("filePath", utf8(F.col("content")).alias("text"))
    wrong = changes.mismatched(stored, within_size(chunker(texts), max_tokens))
    tag = lambda df, issue: df.select("filePath", F.lit(issue).alias("issue"))
    return tag(gone, "orphaned").unionByName(tag(old, "stale")).unionByName(tag(wrong, "mismatch"))


def repair(spark: SparkSession, root: str, store: Store, branch: str = "_default", config: object | None = None, dry: bool = False, chunker: Callable[[DataFrame], DataFrame] = syntax_chunks) -> RepairResult:
    """Removes what is wrong; the next build makes it anew. dry: only reports."""
    ignore, include, exclude = (config.ignore, config.extensions.include, config.extensions.exclude) if config else ((), (), ())
    tree = source.scan(spark, root, ignore, include, exclude)
    chunks, manifest = store.chunks(), store.files(branch)
    found = issues(chunks, manifest, tree, branch, chunker, config.max_tokens if config else None).cache()
    listed = {name: [r[0] for r in found.where(F.col("issue") == name).select("filePath").orderBy("filePath").toLocalIterator()] for name in ("orphaned", "stale", "mismatch")}
    removed = 0
    if not dry and any(listed.values()):
        others = changes.delete_entries(manifest, branch, found)
        gone = chunks.join(others.select("filePath", "fileHash").distinct(), ["filePath", "fileHash"], "left_anti").select("id", "fileHash").cache()
        removed = gone.count()
        store.migrate(branch)
        store.change(chunks=(None, gone), files=changes.manifest_change(store.files(), others))
        gone.unpersist()
    found.unpersist()
    return RepairResult(listed["orphaned"], listed["stale"], listed["mismatch"], removed)
