"""Statistics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: files, chunks, unique_hashes, duplicates."""
    counted = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("hash").alias("unique_hashes"))
    files = manifest.agg(F.countDistinct("filePath").alias("files"))
    return files.join(counted, how="cross").select("files", "chunks", "unique_hashes", (F.col("chunks") - F.col("unique_hashes")).alias("duplicates"))


def hashes(chunks: DataFrame) -> DataFrame:
    """The distinct chunk hashes."""
    return chunks.select("hash").distinct()


def repeats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, hashes, and chunks beyond the first of each hash."""
    n, distinct = F.count("*"), F.countDistinct("hash")
    return chunks.agg(n.alias("chunks"), distinct.alias("hashes"), (n - distinct).alias("repeats"))


def hashes_by_file(chunks: DataFrame) -> DataFrame:
    """A file's chunk hashes in order, joined by commas; a file is one row, as large as its chunks."""
    return chunks.groupBy("filePath").agg(F.array_join(F.sort_array(F.collect_list("hash")), ",").alias("hashes"), F.count("*").alias("chunks"))


def branches(manifest: DataFrame) -> DataFrame:
    return manifest.select("branch").distinct()


def change_summary(changes: DataFrame, listed: int = 10) -> DataFrame:
    """For each kind: how many, the first ``listed`` paths, and how many more. Ranked before they are gathered, so no group is collected whole."""
    from pyspark.sql import Window

    ranked = changes.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("filePath"))).where(F.col("k") <= listed)
    first = ranked.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("filePath")), ",").alias("first"))
    return changes.groupBy("kind").agg(F.count("*").alias("n")).join(first, "kind").select("kind", "n", "first", F.greatest(F.col("n") - listed, F.lit(0)).alias("more"))


def first_seen_files(results: DataFrame, rank: str = "rank") -> DataFrame:
    """Distinct files in the order of their first result."""
    return results.groupBy("filePath").agg(F.min(rank).alias("rank"))


def build_totals(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """One pass: succeeded, failed, oversize."""
    large = F.col("tokens") > max_tokens
    return chunks.agg(F.count_if(~large & F.col("vector").isNotNull()).alias("succeeded"), F.count_if(~large & F.col("vector").isNull()).alias("failed"), F.count_if(large).alias("oversize"))


def dimension(vectors: DataFrame) -> DataFrame:
    """The size of the first vector there is."""
    return vectors.where("vector IS NOT NULL").select(F.size("vector").alias("dimensions")).limit(1)


def rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, files, chunks, tokens) for every combination of the keys and the whole, in one pass over (keys, filePath, tokens).

    A key that a row of a level doesn't group by is null; ``level`` has one bit for each such key, the first key's highest.
    The rows are first counted by all keys and file, so that what the sets multiply is a row a file and not a chunk.
    """
    by_file = rows.groupBy(*keys, "filePath").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    sums = (F.countDistinct("filePath").alias("files"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))
    return by_file.cube(*keys).agg(F.grouping_id().alias("level"), *sums)


#: Bits of the counting sketch's size and parameter of the quantile sketch: errors of about 1.04 / sqrt(2 ** 12) and 1.33 % of the ranks.
HLL_BITS, KLL_K = 12, 200


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, files, hashes, tokens, n): mergeable sketches of the distinct files and hashes and of the sizes of (keys, filePath, hash, tokens). They add up: rows of later versions need no look at earlier ones."""
    files, hashes = F.hll_sketch_agg("filePath", HLL_BITS).alias("files"), F.hll_sketch_agg("hash", HLL_BITS).alias("hashes")
    return rows.groupBy(*keys).agg(files, hashes, F.kll_sketch_agg_bigint(F.col("tokens").cast("long"), KLL_K).alias("tokens"), F.count("*").alias("n"))


def merged_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the union, by fewer keys or over versions."""
    return parts.groupBy(*keys).agg(F.hll_union_agg("files").alias("files"), F.hll_union_agg("hashes").alias("hashes"), F.kll_merge_agg_bigint("tokens").alias("tokens"), F.sum("n").alias("n"))


def estimates(parts: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(keys, chunks, files, hashes, q50, q90, q99): what sketches tell; chunks is exact."""
    ranks = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("tokens", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    return parts.select(*keys, F.col("n").alias("chunks"), F.hll_sketch_estimate("files").alias("files"), F.hll_sketch_estimate("hashes").alias("hashes"), *ranks)
