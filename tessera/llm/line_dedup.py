"""Line dedup with sharded minimal perfect hashes.

A line's key is the line stripped of ASCII white space, A-Z in lower case. Per
shard (a range of 64-bit key hashes), a minimal perfect hash over the distinct
keys indexes three compact arrays: a 32-bit fingerprint, a saturating count of
the runs that hold the key, and the smallest doc_id. The documents' sorted key
runs are routed to their shards and probe the arrays there; one byte a key
comes back. No line is joined and no shard is broadcast. The hash gives a foreign
key the index of another one, which the fingerprint tells apart; the query's own
runs hold no foreign key, as a shard is built from all keys of its range.

A key of at least ``min_chars`` code points that a document with a smaller
doc_id has loses all its lines. Defined results: a null or empty text is one
empty line; a null doc_id counts as larger than all numbers; rows of equal
doc_id are one document and don't take lines from each other; a document all
of whose lines go keeps an empty text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import blocks
from .blocks import Run, Texts
from .common import documents, mix

_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class PerfectHash:
    """Minimal and perfect over distinct 64-bit keys: in each level, keys that are alone in their slot set its bit and the others go on."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0, deepest: int = 40):
        self.levels: list[tuple[np.uint64, int, np.ndarray, np.ndarray]] = []
        base = 0
        while len(keys) and len(self.levels) < deepest:
            seed, slots = np.uint64((len(self.levels) + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), max(8, int(spread * len(keys)))
            at = (mix(keys + seed) % np.uint64(slots)).astype(np.int64)
            alone = np.bincount(at, minlength=slots) == 1
            bits = np.packbits(alone, bitorder="little")
            ranks = np.cumsum(_ONES[bits], dtype=np.int64) - _ONES[bits] + base
            self.levels.append((seed, slots, bits, ranks))
            base += int(alone.sum())
            keys = keys[~alone[at]]
        self.rest, self.base = np.sort(keys), base

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; any index for a foreign one."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for seed, slots, bits, ranks in self.levels:
            at = (mix(keys[left] + seed) % np.uint64(slots)).astype(np.int64)
            byte, bit = at >> 3, at & 7
            hit = (bits[byte] >> bit) & 1 > 0
            below = _ONES[bits[byte] & ((1 << bit) - 1).astype(np.uint8)]
            out[left[hit]] = (ranks[byte] + below)[hit]
            left = left[~hit]
        out[left] = self.base + np.searchsorted(self.rest, keys[left])
        return out


class Shard:
    """The arrays of one range of keys."""

    def __init__(self, runs: list[Run]):
        flat, ids = np.concatenate([r.keys for r in runs]), np.concatenate([r.ids for r in runs])
        distinct = np.unique(flat)
        self.place = PerfectHash(distinct)
        at = self.place(flat)
        self.fingerprint = np.zeros(len(distinct), np.uint32)
        self.fingerprint[at] = flat.astype(np.uint32)
        self.count = np.minimum(np.bincount(at, minlength=len(distinct)), 255).astype(np.uint8)
        self.least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.least, at, ids)

    def probe(self, run: Run) -> np.ndarray:
        """1 for each key of the run that a smaller doc_id holds; 0 for foreign keys."""
        at = np.minimum(self.place(run.keys), len(self.count) - 1)
        return ((self.fingerprint[at] == run.keys.astype(np.uint32)) & (self.least[at] < run.ids)).astype(np.uint8)


def probe_all(runs: list[Run]) -> list[bytes]:
    shard = Shard(runs)
    return [shard.probe(r).tobytes() for r in runs]


def _keys(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the keys that are long enough, and the places of their lines."""
    keys, at = [], []
    for k, line in enumerate(lines):
        key = line.strip().lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            keys.append(xxhash.xxh3_64_intdigest(key))
            at.append(k)
    return np.array(keys, np.uint64), np.array(at, np.int64)


def line_dedup(docs: DataFrame, min_chars: int = 10, documents_out: bool = False, drop_emptied: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, kept_sha256; or, with documents_out, its columns with the text that is left.

    drop_emptied: with documents_out, documents that lost lines and have no word left go as well: all of their text stands in earlier ones.
    """
    rows, _, buckets = blocks.chunked(docs, keep_rest=documents_out)

    def run(texts: Texts) -> Run:
        return Run.of([_keys(text.split(b"\n"), min_chars)[0] for _, text in texts], texts.ids)

    def apply(texts: Texts, back: pa.Table) -> pa.Table:
        split = [text.split(b"\n") for _, text in texts]
        found = [_keys(lines, min_chars) for lines in split]
        own, flags = Run.of([k for k, _ in found], texts.ids), blocks.answer(back)
        n_lines, n_dropped, kept = [], [], []
        for doc_id, lines, (keys, where) in zip(texts.ids, split, found, strict=True):
            at = own.find(keys)
            gone = set(where[(flags[at] > 0) | (own.ids[at] < doc_id)].tolist()) if len(keys) else ()
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            kept.append(b"\n".join([x for k, x in enumerate(lines) if k not in gone] if gone else lines))
        if documents_out:
            out = texts.replaced(kept)
            return out.filter(pa.array([not lost or bool(text.strip()) for lost, text in zip(n_dropped, kept, strict=True)], pa.bool_())) if drop_emptied else out
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table({"doc_id": texts.table.column("doc_id").cast(pa.int64()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    answers = blocks.resolve(blocks.emit(rows, buckets, run), probe_all, buckets=buckets)
    if documents_out:
        return blocks.restored(blocks.finish(rows, answers, apply, blocks.replaced_schema(rows)), docs)
    return blocks.finish(rows, answers, apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))
