"""Block exchange: sorted runs of 64-bit keys meet by key range, and answers go back to where the texts are.

Documents are dealt into chunks of a few MB by a hash of their id. A chunk
makes one sorted run of distinct keys and cuts it by ranges of the key
("buckets"); a run travels as one binary value, so that a key costs a few
bytes instead of a row. In a bucket the runs of all chunks are merged. Each
run gets back one small answer for each key, in the order of the run, so that
neither the keys nor any link between documents travel back.

A key that a third of all documents hold counts once for each chunk: the run is
the pre-aggregation. The texts are shuffled once; the later steps reuse it.

Chunks and buckets both grow with the input, and so the blocks would grow with its
square. Where they would be more than ``spark.tessera.mostBlocks``, runs are cut into
coarse buckets first, the runs of as many chunks as there are coarse buckets are
joined into one, which is as large as a chunk's, and only that is cut finely. Answers
take the same way back. Blocks then grow as the input to the power 1.5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NO_ID, bounded_batches, document_chunk, release, sizes, text_bytes

RUNS = "bucket int, chunk int, run binary"
ANSWERS = "chunk int, bucket int, phase int, answer binary"


#: Blocks of an exchange without a coarse level, at most.
MOST_BLOCKS = 1 << 22


class Buckets(int):
    """A number of key ranges, each made up of ``finer`` ranges in which keys are merged."""

    finer = 1

    @classmethod
    def of(cls, chunks: int, buckets: int, most: int) -> "Buckets":
        if chunks * buckets <= most or buckets < 4:
            return cls(buckets)
        coarse = cls(math.isqrt(buckets - 1) + 1)
        coarse.finer = -(-buckets // coarse)
        return coarse


class Texts:
    """The documents of one chunk."""

    def __init__(self, table: pa.Table):
        self.table = table
        ids = table.column("doc_id")
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(int(NO_ID)), np.int64)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        return zip(self.ids.tolist(), text_bytes(self.table.column("text")), strict=True)

    def replaced(self, texts: list[bytes]) -> pa.Table:
        """The documents with other texts."""
        table = self.table.drop_columns(["chunk"])
        return table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))


class Run:
    """Distinct keys in ascending order, each with the smallest id of its documents."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.keys, self.ids = keys, ids

    @classmethod
    def of(cls, keys: list[np.ndarray], ids: np.ndarray) -> "Run":
        """keys: an array for each document, whose id is in ``ids``."""
        flat = np.concatenate([*keys, np.empty(0, np.uint64)])
        owner = np.repeat(ids, [len(k) for k in keys])
        return cls.merged(flat, owner)

    @classmethod
    def merged(cls, keys: np.ndarray, ids: np.ndarray) -> "Run":
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return cls(keys[first], np.minimum.reduceat(ids, first) if len(first) else ids)

    @classmethod
    def joined(cls, runs: list["Run"]) -> "Run":
        return cls.merged(np.concatenate([r.keys for r in runs]), np.concatenate([r.ids for r in runs]))

    def cut(self, buckets: int) -> Iterator[tuple[int, slice]]:
        """Its parts by bucket; empty ones are left out."""
        at = (self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
        return ((int(b), slice(int(edges[b]), int(edges[b + 1]))) for b in np.flatnonzero(np.diff(edges)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that the run is known to hold."""
        return np.searchsorted(self.keys, keys)

    def pack(self, part: slice) -> bytes:
        """The upper 48 bits as differences, the lower 16 as a tag, and each id as a place in the list of ids, if there is more than one."""
        keys, (ids, place) = self.keys[part], np.unique(self.ids[part], return_inverse=True)
        upper = keys >> np.uint64(16)
        steps = np.diff(upper)
        small = not len(steps) or int(steps.max()) < 1 << 32
        few = len(ids) <= 1 << 16
        head = np.array([len(keys), len(ids), small, few, upper[0]], np.uint64)
        place = place[:0] if len(ids) == 1 else place
        return b"".join(x.tobytes() for x in (head, ids, steps.astype(np.uint32 if small else np.uint64), keys.astype(np.uint16), place.astype(np.uint16 if few else np.uint32)))

    @classmethod
    def unpack(cls, blob: bytes) -> "Run":
        n, m, small, few, first = (int(x) for x in np.frombuffer(blob, np.uint64, 5))
        at, parts = 40, []
        for kind, size in ((np.int64, m), (np.uint32 if small else np.uint64, n - 1), (np.uint16, n), (np.uint16 if few else np.uint32, n if m > 1 else 0)):
            parts.append(np.frombuffer(blob, kind, size, at))
            at += np.dtype(kind).itemsize * size
        ids, steps, tag, place = parts
        upper = np.cumsum(np.append(np.uint64(first), steps.astype(np.uint64)), dtype=np.uint64)
        return cls(upper << np.uint64(16) | tag.astype(np.uint64), ids[place] if m > 1 else np.repeat(ids, n))


def chunked(docs: DataFrame, keep_rest: bool = False, counts: tuple[int, int] | None = None) -> tuple[DataFrame, int, Buckets]:
    """(documents with their chunk, chunks, buckets). keep_rest: other columns go along in the struct ``rest``. counts: chunks and buckets, if known."""
    bounded_batches(docs.sparkSession)
    chunks, buckets = counts or sizes(docs)
    buckets = Buckets.of(chunks, buckets, int(docs.sparkSession.conf.get("spark.tessera.mostBlocks", str(MOST_BLOCKS))))
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("rest")] if keep_rest and len(docs.columns) > 2 else []
    return docs.select(document_chunk(F.col("doc_id"), F.col("text"), chunks).alias("chunk"), "doc_id", "text", *rest), chunks, buckets


def replaced_schema(rows: DataFrame) -> StructType:
    return StructType([f for f in rows.schema.fields if f.name != "chunk"])


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from doc_id, text and rest; n_chars follows the text."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def emit(docs: DataFrame, buckets: int, run: Callable[[Texts], Run]) -> DataFrame:
    """A run for each chunk, cut by bucket."""

    def of_chunk(key: tuple, table: pa.Table) -> pa.Table:
        out = packed(run(Texts(table)), buckets, key[0].as_py())
        release()
        return out

    return docs.groupBy("chunk").applyInArrow(of_chunk, RUNS)


def emit_again(docs: DataFrame, answers: DataFrame, buckets: int, run: Callable[[Texts, np.ndarray], Run]) -> DataFrame:
    """A further run for each chunk, which depends on the answers to the first."""

    def of_chunk(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        out = packed(run(Texts(table), answer(back)), buckets, key[0].as_py())
        release()
        return out

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(of_chunk, RUNS)


def packed(run: Run, buckets: int, chunk: int) -> pa.Table:
    parts = [(b, run.pack(part)) for b, part in run.cut(buckets)]
    return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int32()), "run": pa.array([r for _, r in parts], pa.binary())})


def resolve(runs: DataFrame, merge: Callable[[list[Run]], list[bytes]], phase: int = 1, buckets: int = 1, within: Callable[[list[Run]], list[bytes]] | None = None, join: Callable[[list[Run]], Run] = Run.joined) -> DataFrame:
    """``merge`` gets the runs of a bucket and gives the answer to each.

    buckets: as the runs were cut by. With a coarse level, ``join`` makes one run of several, and ``within`` (``merge``, if not
    given) says what they answer to each other; bits of that and of the joined run's answer are put together.
    """
    finer = getattr(buckets, "finer", 1)
    if finer == 1:
        return _resolved(runs, merge, phase)
    within = within or merge

    def of_group(key: tuple, table: pa.Table) -> pa.Table:
        return packed(join([Run.unpack(x.as_py()) for x in table.column("run")]), buckets * finer, key[1].as_py())

    def back(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunks, own = np.asarray(table.column("chunk")), [Run.unpack(x.as_py()) for x in table.column("run")]
        live = [k for k, c in enumerate(chunks) if c >= 0]
        if not live:
            return pa.table({"chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "phase": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
        whole, flags, here = join(own), answer(answers, phase), within(own)
        said = [(np.frombuffer(here[k], np.uint8) | flags[whole.find(own[k].keys)]).tobytes() for k in live]
        return pa.table({"chunk": pa.array(chunks[live], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(live), pa.int32()), "phase": pa.array([phase] * len(live), pa.int32()), "answer": pa.array(said, pa.binary())})

    grouped = runs.withColumn("set", F.floor(F.col("chunk") / int(buckets)).cast("int"))
    joined = grouped.groupBy("bucket", "set").applyInArrow(of_group, RUNS)
    answers = _resolved(joined, merge, phase).withColumnRenamed("chunk", "set").withColumn("coarse", F.floor(F.col("bucket") / finer).cast("int"))
    return grouped.groupBy("bucket", "set").cogroup(answers.groupBy("coarse", "set")).applyInArrow(back, ANSWERS)


def _resolved(runs: DataFrame, merge: Callable[[list[Run]], list[bytes]], phase: int) -> DataFrame:
    def of_bucket(key: tuple, table: pa.Table) -> pa.Table:
        chunks = np.asarray(table.column("chunk"))
        back = merge([Run.unpack(x.as_py()) for x in table.column("run")])
        release()
        live = [k for k, c in enumerate(chunks) if c >= 0]
        return pa.table({"chunk": pa.array(chunks[live], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(live), pa.int32()), "phase": pa.array([phase] * len(live), pa.int32()), "answer": pa.array([back[k] for k in live], pa.binary())})

    return runs.groupBy("bucket").applyInArrow(of_bucket, ANSWERS)


def by_chunk(answers: DataFrame) -> DataFrame:
    """Dealt to chunks once, for steps that read the same answers."""
    return answers.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")


def answer(table: pa.Table, phase: int = 1) -> np.ndarray:
    """The bytes of a chunk's answers in the order of its run."""
    rows = sorted((b, a) for b, p, a in zip(table.column("bucket").to_pylist(), table.column("phase").to_pylist(), table.column("answer").to_pylist(), strict=True) if p == phase)
    return np.frombuffer(b"".join(a for _, a in rows), np.uint8)


def finish(docs: DataFrame, answers: DataFrame, apply: Callable[[Texts, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """Each chunk with the answers to its runs."""

    def of_chunk(table: pa.Table, back: pa.Table) -> pa.Table:
        out = apply(Texts(table), back)
        release()
        return out

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(of_chunk, schema)


def not_first(runs: list[Run]) -> list[bytes]:
    """For each key of each run: 1 if another run has it with a smaller id. The runs are sorted, so the stable sort merges them."""
    keys, ids = np.concatenate([r.keys for r in runs]), np.concatenate([r.ids for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.append(True, keys[1:] != keys[:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    flags = np.empty(len(keys), np.uint8)
    flags[order] = ids[order] > least
    return [x.tobytes() for x in np.split(flags, np.cumsum([len(r.keys) for r in runs])[:-1])]
