"""Media columns: signature sniffing and carving.

One Aho-Corasick automaton finds the magic bytes of all known formats in one
pass over a blob. A validator of the format then reads its structure and
lengths at each place found; only what holds together counts. The media that
starts at byte 0 corrects the declared type; media that starts later is
embedded and gets carved.

Texts become media here as 8-bit mono sound: the UTF-8 bytes, padded with bytes
0 up to a positive multiple of 64, are the samples of a WAV file.

Defined results: a null or empty text is 64 samples of 0; a null or empty blob has
no type (application/octet-stream) and nothing embedded; a null doc_id stays null,
and every row is a medium of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_rows, text_bytes

BLOCK = 64
UNKNOWN = "application/octet-stream"
#: Magic bytes, how many bytes stand before them, and the validator's name: fixed values of the formats' public descriptions.
MAGIC = {
    b"RIFF": (0, "riff"),
    b"\x89PNG\r\n\x1a\n": (0, "png"),
    b"\xff\xd8\xff": (0, "jpeg"),
    b"GIF87a": (0, "gif"),
    b"GIF89a": (0, "gif"),
    b"BM": (0, "bmp"),
    b"%PDF-": (0, "pdf"),
    b"PK\x03\x04": (0, "zip"),
    b"\x1f\x8b\x08": (0, "gzip"),
    b"fLaC": (0, "flac"),
    b"OggS": (0, "ogg"),
    b"ftyp": (4, "mp4"),
    b"\x1aE\xdf\xa3": (0, "matroska"),
    b"II*\0": (0, "tiff"),
    b"MM\0*": (0, "tiff"),
    b"ID3": (0, "mp3"),
    b"\xff\xfb": (0, "mp3"),
    b"\xff\xfa": (0, "mp3"),
    b"\xff\xf3": (0, "mp3"),
    b"\xff\xf2": (0, "mp3"),
}
TYPES = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "flac": "audio/flac", "ogg": "audio/ogg", "tiff": "image/tiff", "mp3": "audio/mpeg"}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
#: Main brands of files of boxes; others count as video/mp4.
BRANDS = {b"qt  ": "video/quicktime", b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"heic": "image/heic", b"heix": "image/heic", b"mif1": "image/heif", b"avif": "image/avif", b"3gp4": "video/3gpp", b"3gp5": "video/3gpp"}
#: Kilobits a second by index, of layer III of version 1 and of versions 2 and 2.5, and samples a second of version 1.
MP3_RATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_SAMPLES = (44100, 48000, 32000)


class Blob:
    """Bytes, and the places of marks in them, each found by one pass however many media ask for it."""

    def __init__(self, raw: bytes):
        self.raw, self.marks = raw, {}
        self.archives: dict[int, int] | None = None
        self.chains: dict[int, int] = {}
        self.gif_ends: dict[int, int | None] = {}

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.marks:
            found, at = [], self.raw.find(mark)
            while at >= 0:
                found.append(at)
                at = self.raw.find(mark, at + len(mark))
            self.marks[mark] = found
        return self.marks[mark]

    def after_chain(self, at: int) -> int:
        """The place after a chain of sub-blocks, each led by its length, and its last, empty one; a byte that chains share is walked once."""
        walked = []
        while at not in self.chains and at < len(self.raw) and self.raw[at]:
            walked.append(at)
            at += 1 + self.raw[at]
        end = self.chains.get(at, at + 1)
        self.chains.update(dict.fromkeys(walked, end))
        return end

    def next(self, mark: bytes, at: int) -> int | None:
        own = self.places(mark)
        k = bisect_left(own, at)
        return own[k] if k < len(own) else None

    def last(self, mark: bytes, start: int, end: int) -> int | None:
        own = self.places(mark)
        k = bisect_left(own, end) - 1
        return own[k] if k >= 0 and own[k] >= start else None


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples with their RIFF header."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def riff_chunks(blob: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, length) of the chunks from ``start``; stops where lengths don't fit."""
    while start + 8 <= end:
        name, size = struct.unpack_from("<4sI", blob, start)
        if start + 8 + size > end:
            return
        yield name, start + 8, size
        start += 8 + size + (size & 1)


def from_wav(blob: bytes) -> bytes:
    """The samples that a WAV file stores."""
    end = valid_wav(blob, 0)
    if end is None:
        raise ValueError("not a WAV file")
    return next(blob[a : a + n] for name, a, n in riff_chunks(blob, 12, end) if name == b"data")


def valid_wav(b: bytes, at: int) -> int | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    parts = {name: (a, n) for name, a, n in riff_chunks(b, at + 12, end)}
    if b"fmt " not in parts or b"data" not in parts or parts[b"fmt "][1] < 16:
        return None
    kind, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", b, parts[b"fmt "][0])
    fits = kind != 1 or (align == channels * -(-bits // 8) and per_second == rate * align and align and parts[b"data"][1] % align == 0)
    return end if channels and rate and fits else None


def valid_riff(b: bytes, at: int) -> tuple[str, int] | None:
    """Sound, or images and films by their first chunks."""
    name = RIFF_TYPES.get(b[at + 8 : at + 12])
    if name == "audio/wav":
        return (name, end) if (end := valid_wav(b, at)) else None
    if name is None or len(b) < at + 20:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    first, start, size = next(riff_chunks(b, at + 12, end), (b"", 0, 0))
    fits = first in (b"VP8 ", b"VP8L", b"VP8X") if name == "image/webp" else first == b"LIST" and size >= 4 and b[start : start + 4] == b"hdrl"
    return (name, end) if fits else None


def valid_mp4(b: bytes, at: int) -> tuple[str, int] | None:
    """A file type box, then boxes whose lengths fit, with media or its index among them."""
    brand, start, seen = b[at + 8 : at + 12], at, set()
    while at + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, at)
        head = 8
        if size == 1 and at + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, at + 8)[0], 16
        if size == 0 and seen:  # up to the end
            size = len(b) - at
        if size < head or at + size > len(b) or not all(32 <= c < 127 or c == 169 for c in name) or (not seen and size < 16):
            break
        seen.add(name)
        at += size
    return (BRANDS.get(brand, "video/mp4"), at) if at > start and seen & {b"moov", b"moof", b"meta", b"mdat"} else None


def _vint(b: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """(value, bytes) of a number whose leading zeros tell its length; None for "unknown"."""
    if at >= len(b) or not b[at]:
        return None, 0
    n = 9 - b[at].bit_length()
    raw = int.from_bytes(b[at : at + n], "big")
    if len(b) < at + n:
        return None, 0
    ones = (1 << 7 * n) - 1
    return (raw if keep else None if raw & ones == ones else raw & ones), n


def valid_matroska(b: bytes, at: int) -> tuple[str, int] | None:
    """An EBML header that names the document type, then a segment."""
    size, n = _vint(b, at + 4)
    if not n or size is None or at + 4 + n + size > len(b):
        return None
    head, after = b[at + 4 + n : at + 4 + n + size], at + 4 + n + size
    place = head.find(b"\x42\x82")
    length, m = _vint(head, place + 2) if place >= 0 else (None, 0)
    kind = {b"webm": "video/webm", b"matroska": "video/x-matroska"}.get(head[place + 2 + m : place + 2 + m + (length or 0)].rstrip(b"\0"))
    if kind is None or b[after : after + 4] != b"\x18\x53\x80\x67":
        return None
    size, n = _vint(b, after + 4)
    end = len(b) if n and size is None else after + 4 + n + (size or 0)
    return (kind, end) if n and end <= len(b) else None


def valid_tiff(b: bytes, at: int) -> int | None:
    """Directories and strips that lie within the bytes; the end is that of the last of them."""
    order, size = "<" if b[at : at + 2] == b"II" else ">", len(b) - at
    if size < 8:
        return None
    place, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], 8, set()
    widths = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

    def numbers(kind: int, count: int, where: int) -> list[int]:
        letter = {3: "H", 4: "I"}.get(kind)
        return list(struct.unpack_from(f"{order}{count}{letter}", b, at + where)) if letter else []

    while place:
        if place in seen or place < 8 or place + 6 > size:
            return None
        seen.add(place)
        n = struct.unpack_from(order + "H", b, at + place)[0]
        if not n or place + 6 + 12 * n > size:
            return None
        found = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", b, at + place + 2 + 12 * k)
            width = widths.get(kind, 0) * count
            where = place + 10 + 12 * k if width <= 4 else struct.unpack_from(order + "I", b, at + place + 10 + 12 * k)[0]
            if not width or where + width > size:
                return None
            end = max(end, where + width)
            if tag in (273, 279, 324, 325):
                found[tag] = numbers(kind, count, where)
        if not found:
            return None
        for offsets, lengths in ((273, 279), (324, 325)):
            for start, length in zip(found.get(offsets, []), found.get(lengths, []), strict=False):
                if start + length > size:
                    return None
                end = max(end, start + length)
        end = max(end, place + 6 + 12 * n)
        place = struct.unpack_from(order + "I", b, at + place + 2 + 12 * n)[0]
    return at + end if seen else None


def _mp3_frame(b: bytes, at: int) -> int:
    """The length of the frame of layer III that starts here, or 0."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE6 != 0xE2:
        return 0
    version, rate, samples = b[at + 1] >> 3 & 3, b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or not 0 < rate < 15 or samples == 3:
        return 0
    per_second = MP3_SAMPLES[samples] >> {3: 0, 2: 1, 0: 2}[version]
    return (144 if version == 3 else 72) * 1000 * MP3_RATES[3 if version == 3 else 2][rate] // per_second + (b[at + 2] >> 1 & 1)


def valid_mp3(b: bytes, at: int) -> int | None:
    """At least three whole frames in a row, after a tag if there is one."""
    if b[at : at + 3] == b"ID3":
        size = b[at + 6 : at + 10]
        if len(size) < 4 or max(size) > 127:
            return None
        at += 10 + (size[0] << 21 | size[1] << 14 | size[2] << 7 | size[3]) + 10 * (b[at + 5] >> 4 & 1)
    frames = 0
    while (n := _mp3_frame(b, at)) and at + n <= len(b):
        at, frames = at + n, frames + 1
    return at if frames >= 3 else None


def valid_png(b: bytes, at: int) -> int | None:
    at, first = at + 8, True
    while at + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, at)
        if at + 12 + size > len(b) or first and (name, size) != (b"IHDR", 13) or zlib.crc32(b[at + 4 : at + 8 + size]) != struct.unpack_from(">I", b, at + 8 + size)[0]:
            return None
        at, first = at + 12 + size, False
        if name == b"IEND":
            return at
    return None


def valid_jpeg(b: bytes, at: int) -> int | None:
    at += 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark, size = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if size < 2:
            return None
        at += 2 + size
        if mark == 0xDA:
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b):
                if b[at + 1] == 0xD9:
                    return at + 2
                if b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7:
                    break
                at += 2
            if at < 0:
                return None
    return None


def valid_gif(blob: Blob, at: int) -> int | None:
    b = blob.raw
    if len(b) < at + 13 or not any(b[at + 6 : at + 10]):
        return None
    flags, at = b[at + 10], at + 13
    at += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    walked, end = [], None
    while at < len(b):
        if at in blob.gif_ends:  # images that share their last blocks share their end
            end = blob.gif_ends[at]
            break
        walked.append(at)
        kind = b[at]
        if kind == 0x3B:
            end = at + 1
            break
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 <= len(b):
            flags, at = b[at + 9], at + 10
            at += (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1
        else:
            break
        at = blob.after_chain(at)
    blob.gif_ends.update(dict.fromkeys(walked, end))
    return end


def valid_bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    return at + size if not zero and 54 <= offset < size <= len(b) - at and head in (40, 108, 124) and struct.unpack_from("<H", b, at + 26)[0] == 1 else None


def valid_pdf(blob: Blob, at: int) -> int | None:
    """Up to the last end mark before the next document: a file that was added to has several."""
    b = blob.raw
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    end = blob.last(b"%%EOF", at, blob.next(b"%PDF-", at + 1) or len(b))
    return end + 5 if end is not None and blob.last(b"startxref", at, end) is not None else None


def valid_zip(blob: Blob, at: int) -> int | None:
    """An archive starts where an end record's lengths say so; all end records are read once."""
    b = blob.raw
    if blob.archives is None:
        blob.archives = {}
        for end in blob.places(b"PK\x05\x06"):
            if end + 22 <= len(b):
                count, size, offset, note = struct.unpack_from("<HIIH", b, end + 10)
                start = end - offset - size
                if start >= 0 and end + 22 + note <= len(b) and (not count or b[start + offset : start + offset + 4] == b"PK\x01\x02"):
                    blob.archives.setdefault(start, end + 22 + note)
    return blob.archives.get(at)


def valid_gzip(b: bytes, at: int) -> int | None:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    unpacker = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        unpacker.decompress(rest, 1 << 16)
        while not unpacker.eof and unpacker.unconsumed_tail:
            unpacker.decompress(unpacker.unconsumed_tail, 1 << 16)
    except zlib.error:
        return None
    return len(b) - len(unpacker.unused_data) if unpacker.eof else None


def valid_flac(b: bytes, at: int) -> int | None:
    at, first = at + 4, True
    while at + 4 <= len(b):
        head = struct.unpack_from(">I", b, at)[0]
        kind, size = head >> 24 & 0x7F, head & 0xFFFFFF
        if first and (kind, size) != (0, 34) or at + 4 + size > len(b):
            return None
        at, first = at + 4 + size, False
        if head >> 31:
            return at if b[at : at + 1] in (b"", b"\xff") else None
    return None


def valid_ogg(b: bytes, at: int) -> int | None:
    end = None
    while len(b) >= at + 27 and b[at : at + 5] == b"OggS\0":
        n = b[at + 26]
        at += 27 + n + sum(b[at + 27 : at + 27 + n])
        if at > len(b):
            return end
        end = at
    return end


VALID = {"riff": valid_riff, "mp4": valid_mp4, "matroska": valid_matroska, "png": valid_png, "jpeg": valid_jpeg, "gif": valid_gif, "bmp": valid_bmp, "pdf": valid_pdf, "zip": valid_zip, "gzip": valid_gzip, "flac": valid_flac, "ogg": valid_ogg, "tiff": valid_tiff, "mp3": valid_mp3}
_OF_BLOB = ("gif", "pdf", "zip")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (before, name) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic) + before, name))
    found.make_automaton()
    return found


def validated(blob: Blob, name: str, start: int) -> tuple[str, int] | None:
    """(type, end) of the medium that starts here, if its structure holds."""
    found = VALID[name](blob if name in _OF_BLOB else blob.raw, start)
    return (TYPES[name], found) if isinstance(found, int) else found


def sniff(raw: bytes | None) -> tuple[str, list[tuple[str, int, int]]]:
    """(type of the whole, [(type, start, end) of each medium embedded in it]). Media found inside a carved one are not carved again."""
    blob, kind, inside, past = Blob(raw or b""), UNKNOWN, [], 0
    for last, (size, name) in automaton().iter(blob.raw.decode("latin-1")):
        start = last - size + 1
        if start < 0 or start and start < past or (found := validated(blob, name, start)) is None:
            continue
        if start == 0:
            kind = found[0] if kind == UNKNOWN else kind
        else:
            inside.append((found[0], start, found[1]))
            past = found[1]
    return kind, inside


def carve(df: DataFrame, id_column: str = "id", blob: str = "content", declared: str = "declared") -> DataFrame:
    """A row for each blob (part 0, with its corrected type) and each medium embedded in it."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, value, said in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            kind, inside = sniff(value)
            rows.append((key, 0, said, kind, said != kind, 0, len(value or b""), value))
            rows += [(key, k, None, name, False, a, b, value[a:b]) for k, (name, a, b) in enumerate(inside, 1)]
        names = ("id", "part", "declared", "detected", "corrected", "start", "end", "media")
        kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kind = df.schema[id_column].dataType.simpleString()
    return map_rows(df.select(id_column, blob, declared), of_batch, f"id {kind}, part int, declared string, detected string, corrected boolean, start long, end long, media binary")


def texts_as_media(docs: DataFrame, declared: str = UNKNOWN) -> DataFrame:
    """Each text as a WAV file, with digests of what is read back from it."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw in text_bytes(batch.column("text")):
            media = to_wav(raw + b"\0" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0))
            kind, inside = sniff(media)
            payload = from_wav(media)
            feature = f"{kind};corrected={int(kind != declared)};embedded={len(inside)};" + ",".join(f"{name}@{a - 44}-{b - 44}" for name, a, b in inside)
            out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return map_rows(docs.select("doc_id", "text"), of_batch, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_as_media(documents(spark, sf_dir))
