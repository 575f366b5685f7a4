"""Search over one or several indexes, as one plan for each target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import after_last_dot
from ..operators import knn
from ..operators.fulltext import TextIndex
from ..operators.fusion import fused
from ..types import RESULT_COLUMNS, SearchOptions


@dataclass
class Target:
    chunks: DataFrame
    manifest: DataFrame | None = None  # of the branch that the search is scoped to
    prefix: str | None = None
    root: str | None = None  # of another project: leads its paths


def filtered(rows: DataFrame, options: SearchOptions, prefix: str | None) -> DataFrame:
    """Conditions that the scan can take."""
    if prefix:
        rows = rows.where(F.col("filePath").like(prefix + "%") if options.compat else F.col("filePath").startswith(prefix))
    if options.type:
        rows = rows.where(F.col("type").isin(options.type))
    return rows


def in_languages(rows: DataFrame, languages: list[str]) -> DataFrame:
    wanted = [x if x.startswith(".") else f".{x}" for x in languages]
    return rows.where(after_last_dot(F.col("filePath")).isin(wanted)) if wanted else rows


def tagged(rows: DataFrame, root: str) -> DataFrame:
    """Paths of another project, led by its root."""
    return rows.withColumn("filePath", F.concat(F.lit(root.rstrip("/") + "/"), F.col("filePath")))


def allowed(target: Target, options: SearchOptions) -> DataFrame:
    """The rows of a target that a search may find; in compat mode languages are looked at later."""
    rows = filtered(target.chunks, options, target.prefix)
    rows = rows if options.compat else in_languages(rows, options.language)
    if target.manifest is not None:  # the branch's own versions, before the limit
        rows = rows.join(target.manifest.select("filePath", "fileHash").distinct(), ["filePath", "fileHash"], "left_semi")
    return rows


#: Results of each kind that are looked at for one that is asked for, and at least.
DEEPER, DEEP = 10, 200


def chunk_key() -> Column:
    """Names a stored chunk in a text index."""
    return F.concat_ws("|", "id", "fileHash")


def worded(target: Target, index: TextIndex, query: str, options: SearchOptions, vector: list[float] | None = None) -> DataFrame:
    """Result columns and score by BM25; with a vector by BM25 and distance, fused by their ranks (the score is the fused one).

    What the index still holds of chunks that are gone, or of other branches, drops out by a join, so each list is taken
    deeper than asked for.
    """
    depth = max(DEEP, DEEPER * options.limit)
    rows = allowed(target, options).withColumn("key", chunk_key())
    asked = rows.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    lexical = index.top_k(asked, depth).join(rows.select(F.col("key").alias("id")), "id", "left_semi").select("query_id", "id", "score", place.alias("rank"))
    if vector is None:
        best = lexical.where(F.col("rank") <= options.limit)
    else:
        near = knn.top_k(rows.select(F.col("key").alias("id"), "vector"), vector, depth, options.metric)
        nearest = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        best = fused([lexical, near.withColumn("query_id", F.lit(0)).select("query_id", "id", nearest.alias("rank"))], options.limit)
    if options.min_score is not None:
        best = best.where(F.col("score") >= options.min_score)
    found = rows.select("key", *RESULT_COLUMNS).join(F.broadcast(best.select(F.col("id").alias("key"), "score")), "key")  # limit rows
    found = in_languages(found, options.language) if options.compat else found
    return found.orderBy(F.desc("score"), "key").select(*RESULT_COLUMNS, "score")


def search(targets: list[Target], query: list[float], options: SearchOptions, negative: list[float] | None = None) -> DataFrame:
    """Result columns and score, best first."""
    if negative is not None:
        query = [q - 0.5 * n for q, n in zip(query, negative, strict=True)]
    parts = []
    for target in targets:
        rows = allowed(target, options)
        if options.min_score is not None and not options.compat:
            rows = rows.where(knn.score(knn.distance(F.col("vector"), knn.literal(query), options.metric)) >= options.min_score)
        wide = [c for c in RESULT_COLUMNS if c not in ("filePath", "startLine")]
        best = knn.top_k(rows.select("id", "vector", *RESULT_COLUMNS), query, options.limit, options.metric, wide=wide)
        if target.root:
            best = tagged(best, target.root)
        parts.append(best.select("id", *RESULT_COLUMNS, "score"))
    out = knn.merge(parts, options.limit)
    if options.compat:
        out = in_languages(out, options.language)
        out = out if options.min_score is None else out.where(F.col("score") >= options.min_score)
    return out.orderBy(F.desc("score"), "id").select(*RESULT_COLUMNS, "score")
