"""Files to chunks: sliding windows of lines as plain Catalyst, syntax-aware chunks through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, context_header, extension, short_hash, token_estimate
from ..types import CHUNK_COLUMNS
from . import syntax
from .batches import bounded_batches

WINDOW_LINES, STRIDE_LINES = 50, 25
#: Characters of chunks that a task hands on at once.
CHARS_AT_ONCE = 4 << 20
COLUMNS = ["id", "filePath", "startLine", "endLine", "type", "name", "content", "context", "hash"]


def window_chunks(files: DataFrame, size: int = WINDOW_LINES, stride: int = STRIDE_LINES) -> DataFrame:
    """Overlapping windows of lines; windows of nothing but white space are left out. files: filePath, text and other columns, which stay."""
    others = [c for c in files.columns if c not in ("filePath", "text")]
    lines = files.select("filePath", *others, F.split("text", "\n", -1).alias("lines")).where(F.size("lines") > 0)
    row = F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(stride)))
    cut = lines.select("filePath", *others, "lines", row.alias("row"))
    end = F.least(F.col("row") + size, F.size("lines")).cast("int")
    content = F.array_join(F.slice("lines", F.col("row") + 1, F.lit(size)), "\n")
    chunks = cut.select("filePath", *others, "row", end.alias("endLine"), content.alias("content")).where(F.col("content").rlike(r"\S"))
    hash_ = short_hash(F.col("content"))
    return chunks.select(
        chunk_id(F.col("filePath"), F.col("row"), hash_).alias("id"),
        "filePath",
        (F.col("row") + 1).cast("int").alias("startLine"),
        "endLine",
        F.lit("block").alias("type"),
        F.format_string("lines_%d_%d", F.col("row") + 1, F.col("endLine")).alias("name"),
        "content",
        context_header(F.col("filePath"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("context"),
        hash_.alias("hash"),
        *others,
    )


def syntax_chunks(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """Chunks at definitions for languages that a parser is known for; windows for the others and where a parser finds nothing.

    files: filePath and text. Each file is chunked apart from the others, with no shuffle.
    """
    known = syntax.PARSERS | (parsers or {})

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, chars = [], 0
            for path, text in zip(batch["filePath"], batch["text"], strict=True):
                found = syntax.chunk_file(path, text or "", known)
                rows += found
                chars += sum(len(row[6]) for row in found)
                if chars >= CHARS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)

    bounded_batches(files.sparkSession)
    handled = extension(F.col("filePath")).isin([e for name in known for e in syntax.extensions_of(name)])
    parsed = files.where(handled).select("filePath", "text").mapInPandas(of_task, CHUNK_COLUMNS)
    return parsed.unionByName(window_chunks(files.where(~handled).select("filePath", "text")).select(COLUMNS))


def within_size(chunks: DataFrame, max_tokens: int | None) -> DataFrame:
    """Without chunks whose header and content are estimated above ``max_tokens``."""
    return chunks if max_tokens is None else chunks.where(token_estimate(F.concat("context", "content"), exact=True) <= max_tokens)
