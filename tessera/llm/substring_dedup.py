"""Substring dedup by a log-structured index of window hashes.

Every window of ``window`` consecutive words has a 64-bit fingerprint. The
fingerprints of a chunk of documents form a sorted immutable run, each with the
smallest doc_id that holds it. Per key range, the runs of history and of the
new batch are merge-joined; a match in the sorted upper bits is verified by the
tag in the lower ones. A window is a repeat if a document with a smaller
doc_id has it, and the words it covers go. ``index_of`` gives the runs of a
batch and ``compact`` merges runs into one for each key range, for the next batch.
Runs carry their window and the number of key ranges ("buckets") they were cut
by: another window is an error, and runs of another number are cut anew, so that
equal fingerprints meet however large a batch was.

The registered query takes the table in ``BATCHES`` batches of ascending ids, each
against the compacted runs of those before it.

Defined results: a null or empty text has no words and loses none; a text of
fewer words than a window loses none; a null doc_id counts as larger than all
numbers, and rows of equal doc_id don't take words from each other; other
columns of the input play no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import Run, Texts
from .common import covered, documents, sizes, window_hashes, word_hashes

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
#: Batches that the registered query takes the table in.
BATCHES = 2


def _keys(texts: Texts, window: int) -> list[np.ndarray]:
    return [window_hashes(word_hashes(text.split()), window) for _, text in texts]


def _runs(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    return blocks.emit(rows, buckets, lambda texts: Run.of(_keys(texts, window), texts.ids))


def _stamped(runs: DataFrame, window: int, buckets: int) -> DataFrame:
    return runs.select(F.lit(window).alias("window"), F.lit(buckets).alias("buckets"), "bucket", "chunk", "run")


def index_of(docs: DataFrame, window: int = 13, buckets: int | None = None) -> DataFrame:
    """The sorted runs (window, buckets, bucket, chunk, run) of a batch."""
    rows, _, own = blocks.chunked(docs)
    return _stamped(_runs(rows, window, buckets or own), window, buckets or own)


def recut(index: DataFrame, buckets: int, window: int) -> DataFrame:
    """The runs (bucket, chunk, run) of an index as history, with chunk -1, cut by this number of buckets; fails at runs of another window."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for had, cut, bucket, blob in zip(*(batch.column(c) for c in ("window", "buckets", "bucket", "run")), strict=True):
                if had.as_py() != window:
                    raise ValueError(f"the index has windows of {had} words, not {window}")
                if cut.as_py() == buckets:
                    parts = [(bucket.as_py(), blob.as_py())]
                else:
                    run = Run.unpack(blob.as_py())
                    parts = [(b, run.pack(part)) for b, part in run.cut(buckets)]
                for b, part in parts:
                    yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "chunk": pa.array([-1], pa.int32()), "run": pa.array([part], pa.binary())})

    blocks.bounded_batches(index.sparkSession)
    return index.select("window", "buckets", "bucket", "run").mapInArrow(of_task, blocks.RUNS)


def _shape(index: DataFrame) -> tuple[int | None, int | None]:
    """(window, most buckets) of an index; one of several windows is an error."""
    low, high, most = index.agg(F.min("window"), F.max("window"), F.max("buckets")).first()
    if low != high:
        raise ValueError(f"the index has windows of {low} and of {high} words")
    return low, most


def compact(index: DataFrame) -> DataFrame:
    """One run for each bucket, with chunk -1 as history has. Runs of several numbers of buckets are cut by the largest."""
    window, buckets = _shape(index)
    return index.limit(0) if window is None else _compacted(recut(index, buckets, window), window, buckets)


def _compacted(runs: DataFrame, window: int, buckets: int, older: bool = False) -> DataFrame:
    """older: for batches of larger ids only, so that no id need be kept: each counts as the smallest number."""

    def of_bucket(key: tuple, table: pa.Table) -> pa.Table:
        parts = [Run.unpack(x.as_py()) for x in table.column("run")]
        if older:
            keys = np.unique(np.concatenate([r.keys for r in parts]))
            whole = Run(keys, np.full(len(keys), np.iinfo(np.int64).min))
        else:
            whole = Run.merged(np.concatenate([r.keys for r in parts]), np.concatenate([r.ids for r in parts]))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([-1], pa.int32()), "run": pa.array([whole.pack(slice(None))], pa.binary())})

    return _stamped(runs.groupBy("bucket").applyInArrow(of_bucket, blocks.RUNS), window, buckets)


def substring_dedup(docs: DataFrame, window: int = 13, history: DataFrame | None = None, buckets: int | None = None, texts_out: bool = True) -> DataFrame:
    """A row for each document with what is left of it.

    history: the runs of earlier batches with the same window, of any number of buckets; best stored, as it is looked at once more.
    """
    rows, _, own = blocks.chunked(docs)
    had, most = _shape(history) if history is not None else (None, None)
    if had not in (None, window):
        raise ValueError(f"the index has windows of {had} words, not {window}")
    buckets = buckets or (own if own >= (most or 0) else most)
    runs = _runs(rows, window, buckets)
    return _left(rows, runs if history is None else runs.unionByName(recut(history, buckets, window)), window, buckets, texts_out)


def batched_dedup(docs: DataFrame, window: int = 13, batches: int = BATCHES, texts_out: bool = True) -> DataFrame:
    """As ``substring_dedup`` of all documents, in batches of ascending ids with compaction between them."""
    (chunks, ranges), doc_id = sizes(docs, spread=1), F.col("doc_id")
    # The batches' first steps run side by side, so a batch needs its share of the chunks; runs of few keys travel in more bytes a key.
    counts = -(-chunks // batches), ranges
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
    edges, out, history = [*sorted(set(cuts)), None], [], None
    for low, high in zip([None, *edges[:-1]], edges, strict=True):
        # Rows of one id stay together; null ids, the largest, come last.
        part = docs.where(doc_id < high) if high is not None else docs.where(doc_id.isNull() | (doc_id >= low)) if low is not None else docs
        rows, _, buckets = blocks.chunked(part.where(doc_id >= low) if None not in (low, high) else part, counts=counts)
        runs = _runs(rows, window, buckets)
        runs = runs if history is None else runs.unionByName(history.select("bucket", "chunk", "run"))
        out.append(_left(rows, runs, window, buckets, texts_out))
        history = _compacted(runs, window, buckets, older=True)
    return functools.reduce(DataFrame.unionByName, out)


def _left(rows: DataFrame, runs: DataFrame, window: int, buckets: int, texts_out: bool) -> DataFrame:
    """What is left of the documents that ``runs`` has the runs of."""

    def apply(texts: Texts, back: pa.Table) -> pa.Table:
        keys = _keys(texts, window)
        run, flags = Run.of(keys, texts.ids), blocks.answer(back)
        out = []
        for own_keys, (doc_id, text) in zip(keys, texts, strict=True):
            words, at = text.split(), run.find(own_keys)
            gone = covered((flags[at] > 0) | (run.ids[at] < doc_id), window, len(words)) if len(at) else np.zeros(len(words), bool)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept if texts_out else None))
        n_words, n_removed, sha, kept_text = zip(*out, strict=True) if out else ((),) * 4
        return pa.table({"doc_id": texts.table.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept_text, pa.binary()).cast(pa.string())})

    return blocks.finish(rows, blocks.resolve(runs, blocks.not_first, buckets=buckets), apply, SCHEMA)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched_dedup(documents(spark, sf_dir), texts_out=False).drop("kept_text")
