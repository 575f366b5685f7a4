import hashlib
import random
import struct
import time
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import media
from tessera.llm.bpe import Bpe, bpe_ids, bpe_round_trip
from tessera.llm.chat_format import SQL, chat_format
from tessera.llm.license_scan import TEMPLATES, LicenseIndex, license_scan, vocabulary
from tessera.llm.packing import Tokens, best_fit, best_fit_packing, looked_ahead, packed
from tessera.llm.quality import BUCKETS, distinct_texts, judged, multinomials, quantile, trusted_texts

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def byte_path():
    return vocabularies.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_path():
    return vocabularies.path("word_bpe_49k.json")


#: Texts with every kind of white space, marks, letters beyond ASCII and special tokens.
MIXED = st.lists(st.sampled_from([" ", " ", "\n", "  ", "\t", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "\u00a0", "\u2003", "the", "Word", "Ⱥ", "İ", "ſ", "é", "e\u0301", "ß", "漢", "'s", "'S", "it's", ",", ".", "...", "?!", "12", "-", "<|endoftext|>", "<|", "\0", "A", "K", "Å"]), max_size=12).map("".join)


def packed_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


# ---- media


def test_media_columns(frame, docs):
    want = []
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = media.to_wav(payload)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    rows = media.texts_as_media(frame).collect()
    assert sorted(tuple(r)[:7] for r in rows) == sorted(want)
    assert {r.feature.split(";")[0] for r in rows} == {"audio/wav"}


@given(st.binary(max_size=300))
def test_wav_round_trip(payload):
    assert media.from_wav(media.to_wav(payload)) == payload


def png():
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def test_sniffing_corrects_and_carves(spark):
    import gzip

    blobs = [(1, png(), "image/jpeg"), (2, b"x" + GIF + b"yy" + gzip.compress(b"hello") + b"tail", "text/plain"), (3, b"GIF89a but no image", "image/gif"), (4, None, None), (5, b"", "audio/wav"), (6, media.to_wav(b"\1\2" + png()), "audio/wav"), (7, png()[:-5], "image/png")]
    rows = {(r.id, r.part): (r.detected, r.corrected, r.start, r.end) for r in media.carve(spark.createDataFrame(blobs, "id long, content binary, declared string")).collect()}
    assert rows[1, 0][:2] == ("image/png", True)
    assert rows[2, 1] == ("image/gif", False, 1, 1 + len(GIF)) and rows[2, 2][0] == "application/gzip" and (2, 3) not in rows
    assert rows[3, 0][:2] == (media.UNKNOWN, True) and (3, 1) not in rows
    assert rows[4, 0][0] == rows[5, 0][0] == rows[7, 0][0] == media.UNKNOWN
    assert rows[6, 0][:2] == ("audio/wav", False) and rows[6, 1][0] == "image/png"


def box(name, body=b""):
    return struct.pack(">I4s", 8 + len(body), name) + body


def more_media():
    """One small file of each of the other formats, with its type."""
    import gzip
    import io
    import zipfile

    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("a.txt", "text")
        z.writestr("b.txt", "more")
    riff = lambda kind, body: b"RIFF" + struct.pack("<I", 4 + len(body)) + kind + body
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    ebml = b"\x42\x82\x84webm"
    tags = [(256, 3, 1, 1), (257, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 4)]
    tiff = b"II*\0" + struct.pack("<I", 12) + b"abcd" + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    frame = b"\xff\xfb\x90\x00" + b"\0" * 413
    pdf = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF\nmore\nstartxref\n30\n%%EOF"
    return [
        ("image/webp", riff(b"WEBP", chunk(b"VP8L", b"\x2f\0\0\0"))),
        ("video/x-msvideo", riff(b"AVI ", chunk(b"LIST", b"hdrlxxxx"))),
        ("video/mp4", box(b"ftyp", b"isom\0\0\0\1") + box(b"moov", box(b"mvhd")) + box(b"mdat", b"film")),
        ("audio/mp4", box(b"ftyp", b"M4A \0\0\0\0") + box(b"mdat", b"song")),
        ("video/webm", b"\x1aE\xdf\xa3" + bytes([0x80 | len(ebml)]) + ebml + b"\x18\x53\x80\x67\x84abcd"),
        ("image/tiff", tiff),
        ("audio/mpeg", frame * 3),
        ("audio/mpeg", b"ID3\3\0\0\0\0\0\x05hello" + frame * 4),
        ("application/pdf", pdf),
        ("application/zip", archive.getvalue()),
        ("application/gzip", gzip.compress(b"hello" * 9)),
        ("image/png", png()),
        ("image/gif", GIF),
    ]


@pytest.mark.parametrize("kind, raw", more_media())
def test_every_format(kind, raw):
    assert media.sniff(raw)[0] == kind
    assert media.sniff(b"~" + raw + b"~~~")[1][0] == (kind, 1, 1 + len(raw))
    assert kind not in (media.sniff(raw[:-4])[0], *(x[0] for x in media.sniff(b"~" + raw[:-4])[1])) or kind in ("audio/mpeg", "application/pdf", "video/mp4")


@given(st.lists(st.one_of(st.sampled_from([m for m in media.MAGIC] + [b"%%EOF", b"startxref", b"PK\x05\x06", b"1.4"]), st.binary(max_size=20)), max_size=20).map(b"".join))
def test_sniffing_any_bytes(raw):
    kind, inside = media.sniff(raw)
    edges = [0, *(x for _, a, b in inside for x in (a, b)), len(raw)]
    assert edges == sorted(edges) and isinstance(kind, str)


def test_sniffing_takes_linear_time():
    """Many magic bytes without ends, and an archive of many files: as long as 16 times the bytes of a sixteenth."""
    import io
    import time
    import zipfile

    def archive(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k in range(n):
                z.writestr(f"{k}.txt", "x")
        return out.getvalue()

    for small, large in ((b"%PDF-1.4 " * 4000, b"%PDF-1.4 " * 64000), (archive(200), archive(3200)), (b"GIF89a1234abc!" * 2000, b"GIF89a1234abc!" * 32000)):
        took = []
        for raw in (small, large):
            began = time.process_time()
            media.sniff(raw)
            took.append(time.process_time() - began)
        assert took[1] < 60 * max(took[0], 0.005)


# ---- BPE


def test_bpe_equals_the_library(frame, docs, byte_path):
    library, want = tokenizers.Tokenizer.from_file(byte_path), []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(packed_ids(ids)).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe_round_trip(frame, byte_path).collect()) == sorted(want)
    assert {r.doc_id: len(r.ids) for r in bpe_ids(frame, byte_path).collect()} == {i: n for i, n, _, _ in want}


def test_bpe_on_any_text(byte_path):
    library, own = tokenizers.Tokenizer.from_file(byte_path), Bpe(byte_path)

    @given(st.text(max_size=60))
    def equal(text):
        ids = own.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text

    @settings(max_examples=60, deadline=None)
    @given(st.lists(MIXED, max_size=8))
    def batches_equal(texts):
        ids = own.encode_batch(pa.array([*texts, None], pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
        assert own.decode_batch(ids) == [t.encode() for t in [*texts, ""]]

    equal()
    batches_equal()
    long = "aaaa" * 5000 + "b" * 3000
    assert list(np.frombuffer(own.encode(long), "<u4")) == library.encode(long, add_special_tokens=False).ids


# ---- packing


def test_packing(frame, docs, word_path):
    library, want = tokenizers.Tokenizer.from_file(word_path), []
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(packed_ids(ids[a : a + 4096]))) for k, a in enumerate(range(0, len(ids), 4096))]
    rows = best_fit_packing(frame, word_path).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_tokens_on_any_text(word_path):
    library, own = tokenizers.Tokenizer.from_file(word_path), Tokens(word_path)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(MIXED, st.text(max_size=30)), max_size=8))
    def equal(texts):
        ids = own.of(pa.array([*texts, None], pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]

    equal()


def test_packing_in_groups_wastes_little(spark, monkeypatch):
    from tessera.llm import packing

    monkeypatch.setattr(packing, "GROUP_TOKENS", 400_000)
    rng = np.random.default_rng(3)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 3000, 2000))]
    out = packed(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    total = sum(r[3] for r in rows)
    assert out.select("sequence_id").distinct().count() <= 1.02 * total / 4096
    assert out.agg(F.sum("length")).first()[0] == total


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 20))
def test_best_fit_bounds(lengths, open_bins):
    bins, offsets = best_fit(lengths, 50, open_bins)
    fill = defaultdict(int)
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        assert fill[b] == o and o + n <= 50
        fill[b] += n


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 20))
def test_best_fit_equals_a_search(lengths, open_bins):
    """Against looking at every open bin: the fullest that holds the piece; with too many open, the fullest closes."""
    opened, want, n_bins = [], [], 0  # [free, bin], the last one touched at the end
    for length in lengths:
        fits = [b for b in opened if b[0] >= length]
        if fits:
            least = min(b[0] for b in fits)
            own = [b for b in fits if b[0] == least][-1]
            opened.remove(own)
        else:
            if len(opened) >= open_bins:
                least = min(b[0] for b in opened)
                opened.remove([b for b in opened if b[0] == least][-1])
            own, n_bins = [50, n_bins], n_bins + 1
        want.append((own[1], 50 - own[0]))
        own = [own[0] - length, own[1]]
        if own[0]:
            opened.append(own)
    assert list(zip(*best_fit(lengths, 50, open_bins), strict=True)) == want


@given(st.lists(st.integers(1, 9), max_size=40), st.integers(1, 12))
def test_looking_ahead(lengths, width):
    order = looked_ahead(np.array(lengths, np.int64), width)
    want = [sorted(range(a, min(a + width, len(lengths))), key=lambda k: (-lengths[k], k)) for a in range(0, len(lengths), width)]
    assert order.tolist() == [k for part in want for k in part]


def test_the_bound_binds(spark, monkeypatch):
    """More bins would be open than may be: some close early, and the waste stays small."""
    from tessera.llm import packing

    rows = [(k, 0, 0, 2049 + k % 1000, 0) for k in range(3000)] + [(5000 + k, 0, 0, 900, 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "GROUP_ROWS", 10_000)
    few, many = (packed(df, open_bins=n).select("sequence_id").distinct().count() for n in (64, 4096))
    assert many <= few and many >= 3000


# ---- quality


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, 0) for k in range(10, 30)] + [(None, 1, 0), (31, None, None), (32, 0, 0)], "doc_id long, quality int, toxic int")


def test_quality_base_figures(frame, docs, labels):
    rows = judged(frame, labels).collect()
    have = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert have == sorted((i, *brute.op4_base(t)) for i, t in docs)
    assert all(not (r.base_failed and r.kept) for r in rows)


def test_quality_counts_every_document(frame, docs, labels):
    raw, target = multinomials(frame, np.array([10, 11]))
    grams = lambda t: max(0, 2 * len(brute.WORDS.findall(t or "")) - 1)
    assert raw.sum() == sum(grams(t) for _, t in docs) and target.sum() == sum(grams(t) for i, t in docs if i in (10, 11))
    assert len(raw) == BUCKETS


def test_quality_without_labels(frame, labels, empty):
    assert judged(empty, labels).count() == 0
    rows = judged(frame, labels.where("quality = 7")).collect()
    assert {r.score for r in rows} == {0.0} and all(r.kept != r.base_failed for r in rows)


def test_quality_held_out(spark):
    """Fitted on half of the labels, judged on the other half."""
    from pathlib import Path

    data = "/root/testdata/sf0.1"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    known = spark.read.parquet(f"{data}/labels.parquet")
    fitted = judged(spark.read.parquet(f"{data}/documents.parquet"), known.where("doc_id % 2 = 0"))
    out = fitted.join(known.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed AND coalesce(toxic, 0) = 0")
    kept = {r.quality: (r.n, r.k) for r in out.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1][1] >= 0.995 * kept[1][0] and kept[0][1] <= 0.1 * kept[0][0]


def test_quality_takes_every_trusted_label(spark):
    """More than 20,000 of them: each text is fitted on or sets the threshold, and all that are fitted on count."""
    texts = spark.range(0, 21_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 20_500).alias("text"))
    known = texts.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    marks = trusted_texts(texts, known).cache()
    fitted = marks.where("fitted").count()
    raw, target = multinomials(distinct_texts(texts, marks))
    assert marks.count() == raw.sum() == 20_500 and target.sum() == fitted and 9_500 < fitted < 11_500


@pytest.mark.parametrize("scores", [[3.0], [2.0] * 50, [1.0, 1.0 + 2**-52, 7.0], [float(k * k % 997) / 7 for k in range(5000)]])
def test_quantile_is_exact(spark, scores):
    rows = spark.createDataFrame([(s,) for s in scores], "score double").repartition(3)
    for share in (0.0, 0.002, 0.5, 1.0):
        assert quantile(rows, share) == pytest.approx(np.quantile(scores, share), rel=1e-15)
    assert quantile(rows.where("score < 0"), 0.5) is None


def test_quality_keeps_texts_with_copies(spark, frame, labels):
    """Copies that no label covers don't speak against a text, and all of them are judged alike."""
    kept = {r.doc_id: (r.kept, r.score) for r in judged(frame, labels).collect()}
    assert kept[12][0] and {kept[k] for k in range(60, 80)} == {kept[12]}
    clean = frame.where("doc_id BETWEEN 10 AND 39").select("doc_id", "text")
    many = clean.unionByName(clean.where("doc_id = 35").crossJoin(spark.range(1000, 1300)).select(F.col("id").alias("doc_id"), "text"))
    once, often = ({r.doc_id: (r.kept, r.score) for r in judged(df, labels).collect()} for df in (clean, many))
    assert {k: v for k, v in often.items() if k < 1000} == once and {v for k, v in often.items() if k >= 1000} == {once[35]}


# ---- licences


def test_license_scan(frame, docs):
    rows = license_scan(frame).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in rows) == sorted((i, a, b, str(c), str(d), e) for i, t in docs for a, b, c, d, e in [brute.op10_base(t)])
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_license_templates(spark):
    texts = [(1, "/* Redistribution and use in source and binary forms, with or without modification, are permitted */"), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (3, "the permission of this person to copy software is free"), (4, None)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1][0] == "bsd" and got[1][1] > 0.5 and got[2][0] == "mit" and got[3] == got[4] == ("", 0.0)


def test_license_keys_alone(spark):
    """A key phrase is found with nothing else of its template beside it, whatever words the corpus lacks."""
    texts = [(k, f"see {key} here") for k, (_, _, keys) in enumerate(TEMPLATES) for key in keys]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(TEMPLATES[k][0] in got[k][0] and got[k][1] > 0 for k, _ in texts)


def test_every_key_phrase_is_in_its_notice():
    for _, template, keys in LicenseIndex({}).templates:
        assert keys and all(any(template[i : i + len(key)] == key for i in range(len(template))) for key in keys)


def test_license_scan_equals_every_place():
    """Whatever words are rare: a label for each key phrase that stands, and the best share of a notice laid out around one."""
    rng = random.Random(5)
    every = vocabulary()
    for _ in range(120):
        index = LicenseIndex({b"": 1000, **{w: rng.choice([0, 3, 500, 1000]) for w in every}})
        words = []
        for _ in range(6):
            _, template, keys = rng.choice(index.templates)
            words += rng.choice([template, rng.choice(keys), template[: rng.randint(1, len(template))], [w for w in template if rng.random() < 0.8], [rng.choice(every), b"other"]])
        labels, best = set(), 0.0
        for label, template, keys in index.templates:
            for key in keys:
                for inside in (i for i in range(len(template)) if template[i : i + len(key)] == key):
                    for at in (i for i in range(len(words)) if words[i : i + len(key)] == key):
                        start = at - inside
                        labels.add(label)
                        best = max(best, sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template)) / len(template))
        assert index.scan(words) == (labels, best)


def test_license_scan_looks_up_rare_words_only():
    """A common word of every notice, a million times, costs no postings."""
    index = LicenseIndex({b"": 1000, b"license": 1000, b"the": 1000, b"of": 1000})
    began = time.process_time()
    assert index.scan([b"the", b"license", b"of"] * 300_000 + b"released under the mit license".split()) == ({"mit"}, 1.0)
    assert index.looked_up < 200 and time.process_time() - began < 20


@pytest.mark.parametrize(
    "notice, label",
    [
        ("BSD 3-Clause License", "bsd-3-clause"),
        ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("under the GNU Affero General Public License version 3", "agpl"),
        ("available under the terms of the Eclipse Public License v2.0", "epl"),
        ("you may copy it under GPL version 2 only", "gpl-2.0"),
        ("modify it under its terms, either version 3 of the License, or (at your option) any later version", "gpl"),
        ("the Mozilla Public Licence, v. 2.0", "mpl"),
        ("Creative Commons Attribution-Share Alike 4.0", "cc-by-sa"),
    ],
)
def test_license_names(spark, notice, label):
    got = license_scan(spark.createDataFrame([(None, f"some words before\n{notice} and after")], "doc_id long, text string")).first()
    assert label in got.labels.split(",") and got.score > 0 and got.doc_id is None


def test_maps_of_empty_tables(empty, byte_path, word_path):
    for df in (media.texts_as_media(empty), bpe_round_trip(empty, byte_path), license_scan(empty), best_fit_packing(empty, word_path)):
        assert df.count() == 0


# ---- chats

TURNS = "conv_id long, turn long, role string, text string, turns string, prefixes string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "bye")]
    rows = [(conv, k, *talk[k]) for conv, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for k in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (None, 0, "user", "lost"), (6, None, "user", "x"), (7, 0, "user", "hi|"), (8, 0, "unknown", "bye"), (9, 0, None, "bye"), (10, 0, "user", ""), (10, 0, "user", "")]
    got = {r.conv_id: r for r in chat_format(chats(spark, rows)).collect()}
    assert sorted(got) == [2, 5, 6, 7, 8, 9, 10]
    assert (got[2].n_turns, got[2].n_copies) == (4, 2)
    assert got[2].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nbye<|im_end|>\n"
    assert chat_format(chats(spark, [])).count() == 0


def test_chats_equal_sql(spark):
    import duckdb
    import pandas as pd

    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"t{(c % 5) * (k > 1)}{k}") for c in range(60) for k in range(c % 7 + 1)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = sorted(con.execute(SQL).fetchall())
    assert sorted(tuple(r) for r in chat_format(chats(spark, rows)).collect()) == want


def test_chats_run_no_python(spark):
    text = chat_format(chats(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
