"""Best-fit packing with bounded space.

Texts become token ids, end with an end token and, where longer than a
sequence, are cut into pieces. Each piece goes to the open bin with the least
free space that holds it; the open bins are a bitset keyed by free space, so the
search is a shift and a lowest-bit test. At most ``OPEN_BINS`` are open at once; the
fullest closes first. Groups of ``GROUP_TOKENS`` tokens are packed apart, so that no
task holds more than a group. In a group, pieces arrive by doc_id and piece, and the
packer looks ahead at ``LOOK_AHEAD`` of them, of which the largest goes first.

Defined results: a null or empty text is the end token alone; rows of equal
doc_id are packed each, and so are those with a null doc_id, which come last; only
texts longer than a sequence are cut.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import checkpointed, documents, map_rows, values

SEQUENCE, END_ID = 4096, 1
#: Bins that are open at once, and pieces that are looked ahead at.
OPEN_BINS, LOOK_AHEAD = 256, 1024
#: Tokens of a group, most and least, and rows of it at most.
GROUP_TOKENS, LEAST_TOKENS, GROUP_ROWS = 8 << 20, 1 << 20, 200_000
#: Lower-case pieces that a worker remembers the ids of, of so many characters at most; and how many are encoded at once.
CACHED, CACHED_CHARS, ENCODED_AT_ONCE = 1 << 19, 64, 16384

#: Characters that all versions of Unicode lower, normalise and class alike.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+").fullmatch
#: The vocabulary's pattern: a fixed value.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


#: Marks that mostly stand alone behind a word, and a word of letters of the plain characters.
_STOPS, _WORD = ".,;:!?", r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+[.,;:!?]*$"


class Tokens:
    """Ids of texts, as little-endian unsigned 32-bit values, by the ids of their stretches between blanks: this vocabulary drops white space and never joins across it.

    Arrow splits a batch, finds its distinct stretches and takes plain words with at most one mark behind them apart; other
    stretches are cut by the vocabulary's pattern. A worker remembers the ids of a bounded number of lower-case pieces, and
    encodes new ones many at a time by the vocabulary's merges alone; the last token of each is one that ends a word.
    Stretches with other characters than Latin ones, or that may hold a special token, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = Tokenizer(self.tokenizer.model)  # neither normalises nor cuts, but at blanks
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in enumerate(byte_letters()) if b != 32}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces: dict[bytes, bytes] = {}
        self.stops = pa.array([*self.learnt([c.encode() for c in _STOPS]), b""], pa.large_binary())

    def learnt(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct lower-case pieces."""
        known = self.pieces
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > CACHED:
            known.clear()
            new = pieces
        for a in range(0, len(new), ENCODED_AT_ONCE):
            part = new[a : a + ENCODED_AT_ONCE]
            line = b" ".join(part).decode("latin-1").translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            raw, last = ids.tobytes(), np.flatnonzero(self.ends[ids]) * 4 + 4
            known.update((p, raw[x:y]) for p, x, y in zip(part, [0, *last.tolist()], last.tolist(), strict=False))
        ids = list(map(known.__getitem__, pieces))
        if len(known) > CACHED:
            known.clear()
        for p in new if known else ():
            if len(p) > CACHED_CHARS:
                del known[p]
        return ids

    def whole(self, stretch: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([stretch], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def others(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches that aren't plain words."""
        cut = [[p.encode() for p in _PIECES(s.lower())] if _PLAIN(s) and "<|" not in s else None for s in stretches]
        pieces = list({p for c in cut if c for p in c})
        ids = dict(zip(pieces, self.learnt(pieces), strict=True))
        return [(self.whole(s) if s else b"") if c is None else b"".join(map(ids.__getitem__, c)) for s, c in zip(stretches, cut, strict=True)]

    def ids_of(self, stretches: pa.Array) -> pa.Array:
        """The ids of each of a batch's distinct stretches."""
        bare = pc.utf8_rtrim(stretches, characters=_STOPS)
        marks = pc.subtract(pc.binary_length(stretches), pc.binary_length(bare))
        plain = np.asarray(pc.and_(pc.match_substring_regex(stretches, _WORD), pc.less_equal(marks, 1)))
        coded = pc.utf8_lower(bare).filter(pa.array(plain)).dictionary_encode()
        words = pa.array(self.learnt(values(coded.dictionary)), pa.large_binary()).take(coded.indices)
        behind = pc.index_in(pc.utf8_slice_codeunits(stretches.filter(pa.array(plain)), -1), pa.array(list(_STOPS)))
        words = pc.binary_join_element_wise(words, self.stops.take(behind.fill_null(len(_STOPS))), pa.scalar(b"", pa.large_binary()))
        others = pa.array(self.others(stretches.filter(pa.array(~plain)).to_pylist()), pa.large_binary())
        place = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)
        return pa.concat_arrays([words, others]).take(pa.array(place))

    def of(self, texts: pa.Array) -> Iterator[memoryview]:
        """The ids of each text of a batch."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        flat = self.ids_of(coded.dictionary).take(coded.indices)
        edges = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[np.append(0, np.cumsum(lists.value_lengths()))]
        data = memoryview(flat.buffers()[2] or b"")
        return (data[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


@lru_cache(2)
def loaded(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of at most ``sequence`` tokens."""

    end = np.array([end_id], "<u4").tobytes()

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, width = [], 4 * sequence
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), loaded(path).of(batch.column("text")), strict=True):
            whole = len(ids) + 4
            for k, a in enumerate(range(0, whole, width)):
                crc, b = zlib.crc32(ids[a : a + width]), min(whole, a + width)
                out.append((doc_id, k, a // 4, (b - a) // 4, crc if b < whole else zlib.crc32(end, crc)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_rows(docs.select("doc_id", "text"), of_batch, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, in the order given."""
    free_bits, by_free, n_open, n_bins = 0, [[] for _ in range(sequence + 1)], 0, 0
    bins, offsets = [], []
    for length in lengths:
        if fitting := free_bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            own = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            if n_open >= open_bins:  # the fullest closes
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                n_open -= 1
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
            own, free = n_bins, sequence
            n_bins += 1
            n_open += 1
        bins.append(own)
        offsets.append(sequence - free)
        free -= length
        if free:
            by_free[free].append(own)
            free_bits |= 1 << free
        else:
            n_open -= 1
    return bins, offsets


def looked_ahead(lengths: np.ndarray, width: int | None = None) -> np.ndarray:
    """The order in which pieces go: of each ``width`` in turn, the largest first."""
    return np.lexsort((-lengths, np.arange(len(lengths)) // (width or LOOK_AHEAD)))


def packed(rows: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    tokens, count = rows.agg(F.sum("length"), F.count("*")).first()
    tokens, partitions = tokens or 0, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-tokens // GROUP_TOKENS), -(-count // GROUP_ROWS), min(partitions, tokens // LEAST_TOKENS))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def of_group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["group"]).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "descending"), ("ids_crc32", "ascending")])
        order = looked_ahead(np.asarray(table.column("length")))
        table = table.take(pa.array(order))
        bins, offsets = best_fit(table.column("length").to_pylist(), sequence, open_bins)
        return table.append_column("sequence_id", pa.array(np.array(bins, np.int64) + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets, pa.int64()))

    # Rows that repeat are dealt apart by their place; it is the same each time, as the pieces are stored.
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.select("group", *rows.columns).groupBy("group").applyInArrow(of_group, schema)


def best_fit_packing(docs: DataFrame, path: str) -> DataFrame:
    return packed(checkpointed(pieces(docs, path)))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
