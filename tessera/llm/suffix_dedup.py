"""Suffix-array dedup over a sparse suffix array.

Suffixes are retained only at minimiser positions: in each ``spread`` consecutive
places, the one whose ``depth`` words hash lowest. Any ``window`` = spread + depth - 1
consecutive words hold such a place, at the same distance from their start
wherever they stand, so a repeated passage of that length has a retained suffix
in each copy. The suffixes are sorted by their first ``depth`` words; equal
neighbours in the sorted order mark suffixes that several documents share.
From those only, matches are extended left and right to every window of
``window`` words that the place anchors, and the extensions are compared through
their hashes. A window is a repeat if a document with a smaller doc_id has
it; the words it covers go, so the first document keeps the passage.

Defined results: a null or empty text loses nothing, nor does one shorter than
a window; a null doc_id counts as larger than all numbers; rows of equal doc_id
are one document and don't take words from each other; a document that loses
words keeps the white space between those that stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import blocks
from .blocks import Run, Texts
from .common import covered, documents, window_hashes, word_hashes

WINDOW, DEPTH = 50, 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors(hashes: np.ndarray, spread: int) -> np.ndarray:
    """For each ``spread`` consecutive values, the place of the least; the leftmost of equal ones."""
    n = len(hashes) - spread + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # Sliding minimum over blocks of ``spread`` values: the least of a block's end and of the next one's start.
    at = np.arange(len(hashes) + -len(hashes) % spread)
    padded = np.append(hashes, np.full(len(at) - len(hashes), np.iinfo(np.uint64).max))
    grid, place = padded.reshape(-1, spread), at.reshape(-1, spread)

    def running(values: np.ndarray, keep_left: bool) -> np.ndarray:
        """Column of the least so far."""
        low = np.minimum.accumulate(values, axis=1)
        new = np.empty(values.shape, bool)
        new[:, 0] = True
        new[:, 1:] = values[:, 1:] < low[:, :-1] if keep_left else values[:, 1:] <= low[:, :-1]
        return np.maximum.accumulate(np.where(new, np.arange(spread), 0), axis=1)

    ahead = np.take_along_axis(place, running(grid, True), 1).ravel()  # from the block's start
    behind = np.take_along_axis(place[:, ::-1], running(grid[:, ::-1], False), 1)[:, ::-1].ravel()  # to the block's end
    left, right = behind[:n], ahead[spread - 1 : spread - 1 + n]
    return np.where(padded[right] < padded[left], right, left)


def _suffixes(words: np.ndarray, window: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the suffix's first words at each place, place that anchors each window)."""
    heads = window_hashes(words, depth)
    return heads, anchors(heads, window - depth + 1)


class Found:
    """What one chunk's passes share."""

    def __init__(self, texts: Texts, window: int, depth: int):
        self.texts, self.window = texts, window
        self.words = [word_hashes(text.split()) for _, text in texts]
        self.parts = [_suffixes(w, window, depth) for w in self.words]
        self.keys = [heads[np.unique(at)] for heads, at in self.parts]

    def suffixes(self) -> Run:
        return Run.of(self.keys, self.texts.ids)

    def windows(self, shared: np.ndarray, run: Run) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document: which windows a shared suffix anchors, and their hashes."""
        out = []
        for words, (heads, at) in zip(self.words, self.parts, strict=True):
            alive = shared[run.find(heads[at])] > 0
            out.append((alive, window_hashes(words, self.window, 1)[alive] if alive.any() else np.empty(0, np.uint64)))
        return out

    def extended(self, shared: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], Run]:
        run = self.suffixes()
        alive = self.windows(self.shared_here(run) | shared, run)
        return alive, Run.of([h for _, h in alive], self.texts.ids)

    def shared_here(self, run: Run) -> np.ndarray:
        """Suffixes that several documents of this chunk hold."""
        flat = np.concatenate([*(np.unique(k) for k in self.keys), np.empty(0, np.uint64)])
        _, often = np.unique(flat, return_counts=True)
        return (often > 1).astype(np.uint8)


def equal_neighbours(runs: list[Run]) -> list[bytes]:
    """For each suffix of each run: 1 if its neighbour in the sorted suffixes of all runs is equal."""
    keys = np.concatenate([r.keys for r in runs])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), np.uint8)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return [x.tobytes() for x in np.split(flags, np.cumsum([len(r.keys) for r in runs])[:-1])]


def _gone(found: Found, back: pa.Table) -> list[np.ndarray]:
    """Which words of each document go."""
    alive, run = found.extended(blocks.answer(back, 1))
    flags = blocks.answer(back, 2)
    out = []
    for doc_id, words, (mask, hashes) in zip(found.texts.ids, found.words, alive, strict=True):
        starts = np.zeros(len(mask), bool)
        if len(hashes):
            at = run.find(hashes)
            starts[np.flatnonzero(mask)] = (flags[at] > 0) | (run.ids[at] < doc_id)
        out.append(covered(starts, found.window, len(words)) if starts.any() else np.zeros(len(words), bool))
    return out


def _steps(docs: DataFrame, window: int, depth: int, keep_rest: bool) -> tuple[DataFrame, DataFrame]:
    rows, _, buckets = blocks.chunked(docs, keep_rest)
    first = blocks.by_chunk(blocks.resolve(blocks.emit(rows, buckets, lambda texts: Found(texts, window, depth).suffixes()), equal_neighbours, 1, buckets))
    again = blocks.emit_again(rows, first, buckets, lambda texts, shared: Found(texts, window, depth).extended(shared)[1])
    return rows, first.unionByName(blocks.resolve(again, blocks.not_first, 2, buckets))


def spans(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the runs of words that go; each is cut up to the next word that stays."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, at = [], 0
    for a, b in spans(gone):
        kept.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*kept, text[at:]])


def repeated_passages(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """A row for each passage that a document repeats from earlier ones: doc_id, start_word, end_word (past the last), n_words, passage_words."""
    rows, answers = _steps(docs, window, depth, False)

    def apply(texts: Texts, back: pa.Table) -> pa.Table:
        found = Found(texts, window, depth)
        out = [(k, a, b, len(words)) for k, (words, gone) in enumerate(zip(found.words, _gone(found, back), strict=True)) for a, b in spans(gone)]
        k, a, b, n = zip(*out, strict=True) if out else ((),) * 4
        ids = texts.table.column("doc_id").cast(pa.int64()).take(pa.array(k, pa.int64()))
        return pa.table({"doc_id": ids, "start_word": pa.array(a, pa.int64()), "end_word": pa.array(b, pa.int64()), "n_words": pa.array(n, pa.int64())})

    return blocks.finish(rows, answers, apply, "doc_id long, start_word long, end_word long, n_words long")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """The documents without the passages that earlier ones hold."""
    rows, answers = _steps(docs, window, depth, True)

    def apply(texts: Texts, back: pa.Table) -> pa.Table:
        found = Found(texts, window, depth)
        return texts.replaced([cut(text, gone) if gone.any() else text for (_, text), gone in zip(texts, _gone(found, back), strict=True)])

    return blocks.restored(blocks.finish(rows, answers, apply, blocks.replaced_schema(rows)), docs)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
