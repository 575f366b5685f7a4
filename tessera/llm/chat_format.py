"""Chat formatting after cumulative-snapshot collapse; DataFrame functions only.

A chat service may log a conversation again after every turn. The turns of a
conversation, in order, have rolling prefix hashes: the hash after a turn covers
the hash before it, the role and the text. A conversation whose last hash is a
proper prefix hash of another one is a snapshot of it and goes by an anti-join;
of conversations with equal turns, the one with the smallest conv_id stays. Only
the maximal conversations are rendered.

Hot prefixes (one first turn in a third of all conversations) are pre-aggregated
by ``distinct`` before they are shuffled; a conversation is one row.

Defined results: rows with a null conv_id belong to no conversation and go; a
null turn sorts first; a null role renders as "unknown" and a null text as
empty, but both differ from those strings in the hashes; turns of equal number
are ordered by role, then text, nulls first; rows that repeat are turns of their
own; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _hash(before: Column, turn: Column) -> Column:
    """Covers the hash before, and role and text with marks that no text can imitate."""
    field = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(before, F.lit("|"), field(turn["role"]), F.lit("|"), field(turn["text"])), 256)


def conversations_of(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its turns in order and the hash after each turn."""
    turn = F.struct("turn", "role", "text")
    ordered = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rolled = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda hashes, t: F.concat(hashes, F.array(_hash(F.coalesce(F.try_element_at(hashes, F.lit(-1)), F.lit("")), t))),
    )
    return ordered.withColumn("prefixes", rolled)


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, whole and n_copies of the conversations that no other one extends."""
    ends = conversations.select("conv_id", F.element_at("prefixes", -1).alias("whole"), "prefixes")
    distinct = ends.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = ends.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("whole")).distinct()
    return distinct.join(proper, "whole", "left_anti")


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered chat of each maximal conversation."""
    conversations = conversations_of(turns)
    said = F.transform("turns", lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END), F.lit("\n")))
    return (
        conversations.select("conv_id", "turns")
        .join(maximal(conversations).select("conv_id", "n_copies"), "conv_id")
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), F.array_join(said, "").alias("chat"))
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Prefixes are compared as md5 of the joined turns, each with its lengths.
SQL = """
WITH numbered AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), rolled AS (
  SELECT conv_id, k, n,
         md5(string_agg(coalesce(length(role) || ':' || role, '-') || '|' || coalesce(length(text) || ':' || text, '-'), '|') OVER w) AS h
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT h, min(conv_id) AS conv_id, count(*) AS n_copies FROM rolled WHERE k = n GROUP BY h
), kept AS (
  SELECT * FROM whole WHERE h NOT IN (SELECT h FROM rolled WHERE k < n)
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns, CAST(max(n_copies) AS BIGINT) AS n_copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat
FROM kept JOIN numbered USING (conv_id) GROUP BY conv_id
"""
