"""Exact dedup by deterministic block naming; DataFrame functions only.

A normalised text is cut into blocks of ``BLOCK`` bytes. The distinct blocks are sorted and get integer names; then adjacent
names of a document are paired, the distinct pairs sorted and named, and so on until each document has one name. Two
documents have the same name at the same level just when their texts are equal: no hash decides, so nothing can collide.

A block's name comes back to its documents by a 64-bit hash, once it is known that all blocks with that hash are equal; blocks
of a hash that several have (``clashing``) are brought together by their bytes. So the text is shuffled once, as distinct
blocks of each task; all else is integers, and later levels have only documents longer than a block.

Copies, be they a third of all rows, meet by partial aggregates that name their blocks, and by sort-merge joins that bring
the names back, whose large partitions adaptive execution splits (their keys are turned over, so that the names are dealt
anew: Spark splits no partition that an aggregate has just made). A level is checkpointed, as names may not be minted twice.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, where null is smaller
than any number, and of rows that repeat with the same doc_id one stays; ``keep_id`` is null if all their ids are; other
columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents

#: Bytes of a block.
BLOCK = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def names_of(keys: DataFrame) -> DataFrame:
    """The distinct rows of ``keys``, each with an integer name of its own: its place in the order of its partition."""
    return keys.distinct().sortWithinPartitions(*keys.columns).withColumn("name", F.monotonically_increasing_id())


def _turned(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("turned", F.bitwise_not(key)).drop(key)


def blocks_of(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, doc, k, n, hash, block): the n blocks of each row's normalised text; doc has its id and digest, beside its first block."""
    texts = docs.select("doc_id", lowered(F.col("text")).cast("binary").alias("bytes")).withColumn("row", F.monotonically_increasing_id())
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("bytes", k * size + 1, F.lit(size)))
    held = texts.select("row", F.struct("doc_id", F.sha2("bytes", 256).alias("digest")).alias("doc"), n.alias("n"), F.posexplode(cut).alias("k", "block"))
    return held.select("row", F.when(F.col("k") == 0, F.col("doc")).alias("doc"), "k", "n", F.xxhash64("block").alias("hash"), "block")


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """(row, doc, k, n, name) of each block; equal names are equal blocks."""
    by_hash = checkpointed(names_of(blocks.select("hash", "block")).groupBy("hash").agg(F.min("name").alias("name"), F.count("*").alias("blocks")))
    plain = _turned(blocks.drop("block"), "hash").join(_turned(by_hash.where("blocks = 1").drop("blocks"), "hash"), "turned").drop("turned")
    clashing = by_hash.where("blocks > 1").select("hash")
    if not clashing.isEmpty():
        held = blocks.join(clashing, "hash", "left_semi")
        plain = plain.unionByName(held.join(names_of(held.select("hash", "block")).withColumn("name", -1 - F.col("name")), ["hash", "block"]).drop("hash", "block"))
    return checkpointed(plain.select("row", "doc", "k", "n", "name"))


def named_documents(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, doc_id, digest, level, name) of each row; level and name are equal just where normalised texts are."""
    named = _named_blocks(blocks_of(docs, size))
    most = named.agg(F.max("n")).first()[0] or 0
    whole = lambda at: named.where("n = 1").select("row", "doc.*", F.lit(at).alias("level"), "name")
    level, done = 0, whole(0)
    while most > 1:
        side = lambda even: F.max(F.when(F.col("k") % 2 == even, F.col("name")))
        pairs = named.where("n > 1").groupBy("row", F.floor(F.col("k") / 2).cast("int").alias("pair"), F.ceil(F.col("n") / 2).cast("int").alias("pairs"))
        pairs = pairs.agg(side(0).alias("left"), side(1).alias("right"), F.max("doc").alias("doc")).withColumn("odd", F.col("right").isNull()).na.fill(0, ["right"])
        joined = _turned(pairs, "left").join(_turned(names_of(pairs.select("left", "right", "odd")), "left"), ["turned", "right", "odd"])
        named = checkpointed(joined.select("row", "doc", F.col("pair").alias("k"), F.col("pairs").alias("n"), "name"))
        level, most = level + 1, (most + 1) // 2
        done = done.unionByName(whole(level))
    return done


def exact_dedup(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    named = named_documents(docs, size)
    groups = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return _turned(named, "name").join(_turned(groups, "name"), ["level", "turned"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM normal
"""
