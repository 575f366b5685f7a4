"""Quality rules: hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` slots. One multinomial comes
from the texts of trusted labelled documents (the target), the other from all
texts (the raw corpus). A document's score is the mean over its n-grams of
log p_target - log p_raw. Every trusted labelled row is used, for the target or for
the threshold; the raw counts cover every distinct text. Copies
count once in either, so that how often a text stands says nothing of its quality.

Documents that the target was fitted on score higher than others like them. So
one half of the trusted rows, by a hash of the id, is fitted on and the other half, but for copies of
fitted texts and each distinct text once, sets the threshold:
``MARGIN`` below the score that all but ``LOWEST`` of them reach. Every document
is held against this one number; it is kept if it reaches it and no base rule fails.

Base rules: under 50 words, or more than half of the words in 3-word windows
that the text holds twice or more.

Defined results: a null or empty text has no words and fails the base rules; rows
of ``labels`` with nulls are not trusted; with no trusted text at all the score
is 0 for every document, which is kept if the base rules hold; a row with a null
doc_id is judged like others and never trusted; other columns of the input go
along in ``rest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, covered, documents, map_rows, mix, shared_folder, text_bytes, window_hashes, word_hashes

#: Slots of the hashed multinomials, and the pieces they travel in.
BUCKETS, SLICES = 1 << 16, 64
#: Bins that scores are counted in at once.
BINS = 4096
#: Added to each slot's count.
SMOOTHING = 1.0
#: The threshold stands so far below the score that all but this share of the held-out trusted documents reach.
MARGIN, LOWEST = 0.1, 0.002

_WHITE, _SYMBOLS = bytes([32, *range(9, 14)]), b"#*$%&|<>"


def features(words: np.ndarray) -> np.ndarray:
    """The slots of a text's words and word pairs."""
    return np.concatenate([mix(words), window_hashes(words, 2)]) >> np.uint64(64 - BUCKETS.bit_length() + 1)


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, fitted) of every trusted row: half of the ids, and the one of the least hash, are fitted on, the others set the threshold."""
    rows = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    place = F.xxhash64("doc_id")
    least = rows.agg(F.min(place)).first()[0]
    return rows.withColumn("fitted", (F.pmod(place, F.lit(2)) == 0) | (place == F.lit(least)))


def text_key() -> list[Column]:
    """128 bits that stand for a text; null as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("high"), F.xxhash64(F.lit(1), text).alias("low")]


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(high, low, fitted) of every text that a trusted row has; fitted on if one of its copies is. Keys meet the labels, texts stay."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key()).join(trusted(labels), "doc_id")
    return own.groupBy("high", "low").agg(F.max("fitted").alias("fitted"))


def distinct_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, fitted) of each distinct text once. Copies of a task merge before the shuffle, and the marks come to the texts by the same keys."""
    once = docs.select("text", *text_key()).groupBy("high", "low").agg(F.first("text").alias("text"))
    return once.join(marks, ["high", "low"], "left").select("text", F.coalesce("fitted", F.lit(False)).alias("fitted"))


def multinomials(docs: DataFrame, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each slot in all texts and in those that are ``fitted``, or in those of some ids."""
    bounded_batches(docs.sparkSession)
    fitted = F.col("fitted") if ids is None else F.coalesce(F.col("doc_id").isin(ids.tolist()), F.lit(False))
    width = BUCKETS // SLICES

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros((2, BUCKETS), np.int64), None
        for batch in batches:
            part = batch.column("part")[0].as_py() if part is None and batch.num_rows else part
            target = batch.column("fitted").to_pylist()
            slots = [features(word_hashes(text.split())).astype(np.int64) for text in text_bytes(batch.column("text"))]
            for row, parts in enumerate((slots, [s for s, good in zip(slots, target, strict=True) if good])):
                counts[row] += np.bincount(np.concatenate([*parts, np.empty(0, np.int64)]), minlength=BUCKETS)
        if part is not None:
            yield pa.record_batch({"part": pa.array([part] * SLICES, pa.int32()), "slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([counts[:, k * width : (k + 1) * width].tobytes() for k in range(SLICES)], pa.binary())})

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"slice": pa.array([key[-1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text", fitted.alias("fitted"), (F.spark_partition_id() % 256).alias("part")).mapInArrow(of_task, "part int, slice int, counts binary")
    sums = parts.groupBy("part", "slice").applyInArrow(added, "slice int, counts binary").groupBy("slice").applyInArrow(added, "slice int, counts binary")
    out = np.zeros((2, BUCKETS), np.int64)
    for r in sums.collect():  # one row a slice
        out[:, r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64).reshape(2, width)
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return share(target) - share(raw)


def base_figures(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    n = len(words)
    chars = len(text.translate(None, _WHITE).decode("utf-8", "replace"))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    windows = window_hashes(hashes, 3)
    _, at, often = np.unique(windows, return_inverse=True, return_counts=True)
    repeat = int(covered(often[at] > 1, 3, n).sum()) if len(windows) else 0
    return n, chars, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat


def scored(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Rows (doc_id, text and maybe rest) with their base figures and score."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)  # one number a slot
    added = StructType.fromDDL("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double")
    kinds = (*(pa.int64(),) * 5, pa.bool_(), pa.float64())

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in text_bytes(batch.column("text")):
            words = text.split()
            hashes = word_hashes(words)
            figures = base_figures(text, words, hashes)
            failed = figures[0] < 50 or 100 * figures[4] > 50 * figures[0]
            out.append((*figures, failed, float(shared.value[features(hashes).astype(np.int64)].mean()) if words else 0.0))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    return map_rows(rows, of_batch, StructType(rows.schema.fields + added.fields))


def at_rank(rows: DataFrame, low: float, high: float, rank: int) -> float:
    """The score at a place, from 0, of the scores in order: counts in bins that narrow, so that no task or driver holds more than ``BINS`` of them."""
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = rows.where(F.col("score").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(bins.collect()):
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def quantile(rows: DataFrame, share: float) -> float | None:
    """The score that this share of all lie below, between two scores in proportion."""
    low, high, n = rows.agg(F.min("score"), F.max("score"), F.count("*")).first()
    if not n:
        return None
    place = share * (n - 1)
    below = at_rank(rows, low, high, int(place))
    above = at_rank(rows, low, high, min(n - 1, int(place) + 1))
    return below + (above - below) * (place - int(place))


def threshold_of(judged: DataFrame, marks: DataFrame) -> float:
    """From all trusted texts that the target wasn't fitted on, each once. judged: scored rows with the keys of their texts."""
    held = judged.where("NOT base_failed").select("high", "low", "score").join(marks.where("NOT fitted"), ["high", "low"])
    low = quantile(written(held.groupBy("high", "low").agg(F.min("score").alias("score")).select("score")), LOWEST)
    return (low or 0.0) - MARGIN


def judged(docs: DataFrame, labels: DataFrame, texts: bool = True) -> DataFrame:
    """A row for each document: figures, score and whether it is kept; other columns go along in ``rest``. texts: with text and rest.

    Rows are scored and written once, from which the threshold and the verdicts come.
    """
    marks = written(trusted_texts(docs, labels))
    ratios = log_ratios(*multinomials(distinct_texts(docs, marks)))
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if texts else []
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if others else []
    rows = scored(docs.select("doc_id", "text", *rest, *text_key()), ratios)
    rows = written(rows if texts else rows.drop("text"))
    threshold = threshold_of(rows, marks)
    return rows.drop("high", "low").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), texts=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
