"""Byte-level BPE encoding and decoding.

A text is cut at the special tokens it holds, then into pieces by the
tokenizer's pattern. A piece's bytes are the symbols of a doubly linked list;
a priority queue holds (merge rank, place) of neighbours. The lowest rank
merges first, the leftmost at equal ranks; entries whose symbols have changed
since are skipped. Decoding concatenates the vocabulary's strings.

Pieces repeat, so a worker keeps the ids of a bounded number of short ones, and a
batch is taken by its distinct units: a blank or line feed with what stands up to
the next one. No piece of the pattern spans two units but where three white
spaces stand in a row or two end a text. Such texts, those with special tokens or
with code points beyond U+0557, where Unicode tables of different years disagree,
are encoded one by one, the latter cut by the tokenizer file's own splitter.

Defined results: a null or empty text has no tokens, and decodes to ""; a null
doc_id stays null, and rows that repeat are encoded each; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_rows, values

#: The pattern that the vocabulary's merges were made for: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of at most so many bytes are remembered, so many of them.
CACHED_BYTES, CACHED_PIECES = 64, 1 << 19
#: White space of the pattern below U+0558; and the mark that units are parted at.
_WHITE, _CUT = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]", "\0"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        code = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(code[c] for c in s) for s, i in vocab.items()}
        self.byte_id = [vocab[c] for c in letters]
        #: Pair of symbols, as one number, to the rank of its merge; and the parts and the result of each rank.
        self.ranks: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.strings = pa.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], pa.large_binary())
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut = regex.compile(PATTERN).findall
        self.wide = regex.compile("[՘-\U0010ffff]").search
        self.apart = "|".join([_WHITE + "{3}", _WHITE + r"{2}\z", r"\x00", r"[^\x00-\x{557}]", *(regex.escape(s) for s in self.special)])
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. An entry of the queue is the rank, then the place of the left symbol."""
        symbol = [self.byte_id[b] for b in piece]
        n = len(symbol)
        if n < 2:
            return symbol
        ranks, rules, shift = self.ranks.get, self.rules, n.bit_length()
        at = (1 << shift) - 1
        queue = [rank << shift | k for k, (a, b) in enumerate(pairwise(symbol)) if (rank := ranks(a << 32 | b)) is not None]
        if not queue:
            return symbol
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            k, (a, b, both) = entry & at, rules[entry >> shift]
            right = after[k]
            if symbol[k] != a or right >= n or symbol[right] != b:
                continue  # stale: one of the two has been merged since
            symbol[k], symbol[right] = both, -1
            after[k] = follow = after[right]
            if follow < n:
                before[follow] = k
                if (rank := ranks(both << 32 | symbol[follow])) is not None:
                    heappush(queue, rank << shift | k)
            if (left := before[k]) >= 0 and (rank := ranks(symbol[left] << 32 | both)) is not None:
                heappush(queue, rank << shift | left)
        return [s for s in symbol if s >= 0]

    def piece(self, raw: bytes) -> bytes:
        if (got := self.known.get(raw)) is None:
            got = array("I", self.merge(raw)).tobytes()
            if len(raw) <= CACHED_BYTES:
                if len(self.known) >= CACHED_PIECES:
                    self.known.clear()
                self.known[raw] = got
        return got

    def pieces(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)] if self.wide(text) else self.cut(text)

    def encode(self, text: str) -> bytes:
        """The ids of one text, as little-endian unsigned 32-bit values."""
        out = []
        for part in self.at_special.split(text) if self.at_special else (text,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out += [self.piece(p.encode()) for p in self.pieces(part)]
        return b"".join(out)

    def unit(self, raw: bytes) -> bytes:
        if raw[:1] == b" " and raw[1:].isalpha():
            return self.piece(raw)
        if raw[:1] == b" " and raw[-1:] in b".,;:!?" and raw[1:-1].isalpha():
            return self.piece(raw[:-1]) + self.piece(raw[-1:])
        return b"".join([self.piece(p.encode()) for p in self.cut(raw.decode())])

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as large binary values."""
        texts = texts.fill_null("")
        apart = pc.match_substring_regex(texts, self.apart)
        whole = pc.if_else(apart, "", texts)
        for white in (" ", "\n"):
            whole = pc.replace_substring(whole, white, _CUT + white)
        lists = pc.split_pattern(whole, _CUT)
        coded = lists.flatten().dictionary_encode()
        flat = pa.array([self.unit(u) for u in values(coded.dictionary)], pa.large_binary()).take(coded.indices)
        edges = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[np.append(0, np.cumsum(lists.value_lengths()))]
        ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(edges)), flat.buffers()[2]])
        slow = [self.encode(t) for t in texts.filter(apart).to_pylist()]
        return pc.replace_with_mask(ids, apart, pa.array(slow, pa.large_binary())) if slow else ids

    def decode_batch(self, ids: pa.Array) -> list[bytes]:
        """The UTF-8 of each decoded text: the vocabulary's strings, concatenated."""
        edges = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) // 4
        taken = self.strings.take(pa.array(np.frombuffer(ids.buffers()[2] or b"", "<u4")[edges[0] : edges[-1]]))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[edges - edges[0]].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [str(data[a:b], "utf-8", "replace").encode() for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path)
        ids = bpe.encode_batch(batch.column("text"))
        a = [hashlib.sha256(x).hexdigest() for x in values(ids)]
        b = [hashlib.sha256(x).hexdigest() for x in bpe.decode_batch(ids)]
        return pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pc.divide(pc.binary_length(ids), 4), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return map_rows(docs.select("doc_id", "text"), of_batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of each text."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in values(loaded(path).encode_batch(batch.column("text")))]
        return pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return map_rows(docs.select("doc_id", "text"), of_batch, "doc_id long, ids array<long>")


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
