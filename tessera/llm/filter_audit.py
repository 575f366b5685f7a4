"""Filter interaction audit: what each filter removes in every order of the filters, from one pass over the documents.

A document's failures are a mask of bits. Documents are counted by part and mask (partial aggregates, so no part or mask
gathers in a task), at most 2^filters cells a part. One walk a part then visits all orders by single swaps of neighbours
(Steinhaus-Johnson-Trotter): only the survivors between the two swapped filters change, so only their two steps are counted
anew, from cells summed over the masks that avoid a set of filters. A filter's removals count towards its Shapley sum for as
many orders as they stand unchanged.

Failures that depend on other documents (copies of a smaller doc_id) are found over the whole table by SHA-256 of the text; the
smallest id of each is a partial aggregate and comes back by a join that adaptive execution splits where copies are many.

Defined results: a null text is empty, a null part the empty string; a null doc_id counts as larger than every number, and
rows that repeat have the same doc_id, so none of them fails by the others; labels that repeat count where any row has the
value; a document without labels has neither; other columns play no part; an empty table has no parts, so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents

_SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D on a text that isn't null."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * distinct.cast("long") < 80 * n, "C": 100 * capitals.cast("long") > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each document: bit k stands for the k-th of ABCDE."""
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(text).values())), F.lit(0))
    facts = checkpointed(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return facts.join(firsts, "digest").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def cells_of(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each mask of a part the number of documents, of good and of toxic ones."""
    told = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    cells = failed.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """The place of each swap of neighbours that leads through all orders of n things: all but the first order."""
    order, way = list(range(n)), [-1] * n
    while True:
        at = {x: k for k, x in enumerate(order)}
        movable = [x for x in order if 0 <= at[x] + way[x] < n and order[at[x] + way[x]] < x]
        if not movable:
            return
        x = max(movable)
        left = min(at[x], at[x] + way[x])
        order[left], order[left + 1] = order[left + 1], order[left]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield left


def audit(cells: list[tuple[int, int, int, int]], filters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    n = len(filters)
    left: dict[int, tuple[int, ...]] = {}  # by set of filters: documents, good and toxic ones that fail none of it
    for size in range(n + 1):
        for chosen in combinations(range(n), size):
            gone = sum(1 << k for k in chosen)
            left[gone] = tuple(sum(c[j] for c in cells if not c[0] & gone) for j in (1, 2, 3))
    fails = [left[0][0] - left[1 << k][0] for k in range(n)]
    unique = [sum(c[1] for c in cells if c[0] == 1 << k) for k in range(n)]
    order = list(range(n))
    gone = [sum(1 << f for f in order[:k]) for k in range(n + 1)]  # filters before each step, and all
    removed = [tuple(a - b for a, b in zip(left[gone[k]], left[gone[k + 1]], strict=True)) for k in range(n)]
    since, sums, visits, seen = [0] * n, [0] * n, 0, []

    def settle(f: int, count: int) -> None:
        sums[f] += count * (visits - since[f])
        since[f] = visits

    def visit() -> None:
        seen.extend(("".join(filters[f] for f in order), k + 1, left[gone[k + 1]][0], removed[k], f) for k, f in enumerate(order))

    visit()
    visits = 1
    for k in swaps(n):
        for step in (k, k + 1):
            settle(order[step], removed[step][0])
        order[k], order[k + 1] = order[k + 1], order[k]
        gone[k + 1] = gone[k] | 1 << order[k]
        for step in (k, k + 1):
            removed[step] = tuple(a - b for a, b in zip(left[gone[step]], left[gone[step + 1]], strict=True))
        visit()
        visits += 1
    for k, f in enumerate(order):
        settle(f, removed[k][0])
    return [(name, step, kept, lost[0], fails[f] - lost[0], unique[f], lost[1], lost[2], sums[f]) for name, step, kept, lost, f in seen]


def filter_audit(cells: DataFrame, filters: str) -> DataFrame:
    """The audit of each part; a part's cells are at most 2^filters."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, held in zip(batch["part"], batch["cells"], strict=True):
                rows = audit([(c["mask"], c["n"], c["good"], c["toxic"]) for c in held], filters)
                yield pd.DataFrame(rows, columns=["filter_order", "step", *_COUNTS]).assign(part=part)

    return cells.mapInPandas(walk, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in _COUNTS)}")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(cells_of(failures(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet")), "ABCDE")


SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
told AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(words.doc_id > min(words.doc_id) OVER (PARTITION BY t) AS INT) AS mask
  FROM words LEFT JOIN told USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bit, (SELECT coalesce(sum(g.bit), 0) FROM filters g WHERE strpos(substr(filter_order, 1, step - 1), g.f) > 0) AS before
  FROM orders, generate_series(1, 5) s(step), filters WHERE f = substr(filter_order, step, 1)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before::INT > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, cells GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
