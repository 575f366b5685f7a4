"""What the training-data operators share: reading whole texts, words and hashes.

Null texts count as empty. A null ``doc_id`` counts as larger than every
number. Rows that repeat are rows of one document when their ids are equal.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk, and so one Python task step, holds on average, and for each bucket of the block exchange.
#: A Python worker needs about 20 times a chunk and 12 times a bucket. The exchange has chunks x buckets blocks, so inputs
#: of many TB want larger ones: spark.tessera.chunkBytes and spark.tessera.bucketBytes set them (268435456 each at 100 TB).
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
#: Bytes of an Arrow batch handed to Python.
BATCH_BYTES = 8 << 20
#: Word hashes a worker remembers before it starts anew.
WORD_CACHE = 1 << 18
#: Stands for a null doc_id inside the operators.
NO_ID = np.iinfo(np.int64).max


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Python gets batches bounded by bytes, so that long texts don't pile up in one of many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where all of Spark runs in this process, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder that spark.checkpoint.dir names, which outlives executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{_shared(spark).rstrip('/')}/{uuid.uuid4().hex}"


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; null as empty."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def release() -> None:
    """Gives memory that is free in this Python worker back to the machine: workers are kept, and hold what a step needed at most."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def values(strings: pa.Array) -> list[bytes]:
    """The bytes of strings without nulls; quicker than ``to_pylist`` for many short ones."""
    large = strings.cast(pa.large_binary())
    if not len(large):
        return []
    edges = np.frombuffer(large.buffers()[1], np.int64, len(large) + 1, 8 * large.offset).tolist()
    raw = (large.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` for each bounded Arrow batch, with no shuffle."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        release()

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word. ``bytes.split()`` splits at exactly ``[\\x20\\x09-\\x0D]+``."""
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``size`` consecutive words, from their hashes; order counts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    scale = (0x9E3779B97F4A7C15 + 2 * seed * 0xD1B54A32D192ED03) % (1 << 64) | 1
    source = mix(words + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))) if seed else words
    # Windows of a power of two of words first, then their sums: a few passes instead of one a word.
    power, width, total, done = source, 1, None, 0
    left = size
    while left:
        if left & 1:
            part = power[done : done + n]
            total = part.copy() if total is None else total * np.uint64(scale) + part
            done += width
        left >>= 1
        if left:
            power = power[:-width] * np.uint64(scale) + power[width:]
            scale = scale * scale % (1 << 64)
            width *= 2
    return mix(total)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words the windows of ``size`` words at ``starts`` (a mask over windows) cover."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def document_chunk(doc_id: Column, text: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text)), F.lit(chunks)).cast("int")


def sizes(df: DataFrame, text: str = "text", spread: int = 2) -> tuple[int, int]:
    """(chunks, buckets) for the texts of ``df``: they follow its bytes and the cluster's shuffle partitions. spread: chunks for each partition at least."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    conf = df.sparkSession.conf
    partitions = int(conf.get("spark.sql.shuffle.partitions"))
    chunk, bucket = (int(conf.get(f"spark.tessera.{name}", str(size))) for name, size in (("chunkBytes", CHUNK_BYTES), ("bucketBytes", BUCKET_BYTES)))
    return max(spread * partitions, -(-total // chunk)), max(partitions, -(-total // bucket))
