"""A training-data pipeline over ``documents``: quality rules, line dedup, near-duplicate join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Between stages the rows are written as Parquet to the shared
folder and read again, so that a lost executor costs one stage's tasks at most.

Defined results: an empty ``documents`` gives no rows; a null or empty text fails
the quality rules; without trusted labels the base rules alone decide; rows that
repeat are copies like others; a null doc_id counts as larger than all numbers.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import blocks
from tessera.llm.common import shared_folder
from tessera.llm.line_dedup import line_dedup
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality import judged
from tessera.llm.suffix_dedup import suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and reach the log-likelihood ratio's threshold."""
    kept = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    return blocks.restored(kept, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that a document with a smaller doc_id has, and without documents of which no word is left."""
    return line_dedup(docs, documents_out=True, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more."""
    return one_of_each(docs, size=5, percent=80)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 50 words or more that a document with a smaller doc_id has."""
    return suffix_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 4096 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("ngram_join", near_duplicates), ("suffix_dedup", suffixes), ("best_fit_packing", packing)]

#: Hashed counts, suffixes and packing have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
