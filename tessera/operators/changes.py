"""Change detection, maintenance of manifests and consistency checks: set operations as joins.

No key list comes to the driver. Sides are left to adaptive execution, which broadcasts only what it has measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def changed(disk: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files (filePath, fileHash) that the manifest lacks or has with another hash; force: all."""
    if force:
        return disk
    known = manifest.select("filePath", F.col("fileHash").alias("known"))
    return disk.join(known, "filePath", "left").where(differs(F.col("fileHash"), F.col("known"))).drop("known")


def working_tree(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filePath, kind): added, modified, deleted."""
    both = disk.select("filePath", F.col("fileHash").alias("now")).join(manifest.select("filePath", F.col("fileHash").alias("then")), "filePath", "full_outer")
    kind = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified")
    return both.select("filePath", kind.alias("kind")).where("kind IS NOT NULL")


def known_content(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose content some branch has, and the others."""
    hashes = manifest.select("fileHash").distinct()
    return files.join(hashes, "fileHash", "left_semi"), files.join(hashes, "fileHash", "left_anti")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose hash isn't stored. Equal chunks within the batch all stay."""
    return chunks.join(stored.select("hash").distinct(), "hash", "left_anti")


def elsewhere(paths: DataFrame, manifest: DataFrame, branch: str) -> DataFrame:
    """The manifest rows that other branches have of the paths."""
    return manifest.where(F.col("branch") != branch).join(paths.select("filePath").distinct(), "filePath", "left_semi")


def unreferenced(paths: DataFrame, manifest: DataFrame, branch: str) -> DataFrame:
    """Paths that no other branch has."""
    return paths.join(manifest.where(F.col("branch") != branch).select("filePath").distinct(), "filePath", "left_anti")


def without_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("filePath").distinct(), "filePath", "left_anti")


def delete_chunks(chunks: DataFrame, paths: DataFrame, manifest: DataFrame, branch: str) -> DataFrame:
    """Chunks left once those of the paths are deleted that no other branch references."""
    return without_paths(chunks, unreferenced(paths, manifest, branch))


def upsert(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest with entries (filePath, fileHash, branch) instead of those of equal branch and path."""
    return manifest.join(entries.select("branch", "filePath").distinct(), ["branch", "filePath"], "left_anti").select("filePath", "fileHash", "branch").unionByName(entries.select("filePath", "fileHash", "branch"))


def delete_entries(manifest: DataFrame, branch: str, paths: DataFrame) -> DataFrame:
    gone = paths.select("filePath", F.lit(branch).alias("branch")).distinct()
    return manifest.join(gone, ["branch", "filePath"], "left_anti").select("filePath", "fileHash", "branch")


def manifest_change(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, keys that go) from one manifest to the other; both with branches (see ``Store.migrate``)."""
    columns = ["branch", "filePath", "fileHash"]
    return after.select(columns).join(before, columns, "left_anti"), before.select(columns).join(after, columns, "left_anti").select("branch", "filePath")


def copy_branch(manifest: DataFrame, source: str, target: str) -> DataFrame:
    return upsert(manifest, manifest.where(F.col("branch") == source).withColumn("branch", F.lit(target)))


def delete_branch(manifest: DataFrame, branch: str) -> DataFrame:
    return manifest.where(F.col("branch") != branch)


def stale_branches(manifest: DataFrame, alive: DataFrame) -> DataFrame:
    """Stored branches that exist no more; ``_default`` and a detached ``HEAD`` never count."""
    return manifest.select("branch").distinct().where(~F.col("branch").isin("_default", "HEAD")).join(alive.select("branch").distinct(), "branch", "left_anti")


def sweep(manifest: DataFrame, alive: DataFrame) -> DataFrame:
    return manifest.join(stale_branches(manifest, alive), "branch", "left_anti").select("filePath", "fileHash", "branch")


def nearest_branch(distances: DataFrame) -> DataFrame:
    """The branch of the fewest commits away; the first by name at ties."""
    return distances.agg(F.min(F.struct("commits", "branch"))["branch"].alias("branch"))


def indexed_paths(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """All paths that an index knows of."""
    return chunks.select("filePath").union(manifest.select("filePath")).distinct()


def orphans(chunks: DataFrame, manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """Indexed paths that are gone."""
    return indexed_paths(chunks, manifest).join(disk.select("filePath"), "filePath", "left_anti")


def stale(manifest: DataFrame, disk: DataFrame, branch: str) -> DataFrame:
    """Paths whose content on disk differs from the branch's manifest."""
    now = disk.select("filePath", F.col("fileHash").alias("now"))
    return manifest.where(F.col("branch") == branch).join(now, "filePath").where(F.col("fileHash") != F.col("now")).select("filePath")


def mismatched(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Paths whose sets of chunk hashes differ; stored and fresh: (filePath, hash)."""
    side = lambda df, name: df.select("filePath", "hash").distinct().withColumn(name, F.lit(True))
    both = side(stored, "a").join(side(fresh, "b"), ["filePath", "hash"], "full_outer")
    return both.groupBy("filePath").agg(F.bool_or(F.col("a").isNull() | F.col("b").isNull()).alias("differs")).where("differs").select("filePath")


def complete_files(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """Files none of whose chunks failed to get a vector."""
    return files.join(vectors.where("vector IS NULL").select("filePath").distinct(), "filePath", "left_anti")


def move_targets(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, target, outcome): the first source by name gets a target that doesn't exist yet; the others conflict."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    taken = existing.select("target").distinct().withColumn("taken", F.lit(True))
    outcome = F.when(F.col("source") == F.col("target"), "same").when(F.col("taken").isNotNull(), "exists").when(F.col("rank") > 1, "conflict").otherwise("move")
    return moves.withColumn("rank", rank).join(taken, "target", "left").select("source", "target", outcome.alias("outcome"))


def same_family(models: DataFrame, index_model: Column) -> DataFrame:
    """Models of the family of an index."""
    from ..functions.text import model_family

    return models.where(model_family(F.col("model")) == model_family(index_model))
