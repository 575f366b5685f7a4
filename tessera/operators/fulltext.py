"""Full-text search: BM25 over a positional inverted index stored as Parquet.

Building: each task turns its rows into segments of at most ``SEGMENT_DOCS`` documents (and about ``SEGMENT_WORDS`` words),
so texts aren't shuffled. For each term of a segment there is one row of postings: document ordinals as differences and
term frequencies, in bytes of seven bits, in blocks of ``BLOCK`` postings with the greatest frequency and the least length of
each block; positions are a column of their own, which only phrase queries read. A segment's rows are made by array
operations over all its terms at once, as most terms are in few documents. Rows are written in the
order of terms within ranges, so that a search for some terms skips most row groups. A term that all documents have has one row
a segment, and is spread over as many files as its bytes need.

Searching: the postings of the queries' terms meet by segment; a segment's share is bounded by its words. Within it
the terms of a query are taken by their greatest contribution. Once a task has k results for a query, terms that together
can't lift a document above the k-th score are only looked up for documents that the others brought (MaxScore), in the
blocks whose bounds and range may matter; a segment whose terms together can't reach it is skipped. Each task gives k rows a
query, a ranking with a group limit follows.

The score is the sum over the query's distinct terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b +
b * length / mean length)), rounded to 9 digits so that ties go by id whatever the order of the sum.

Defined results: words are runs of letters, digits, underscores and characters beyond ASCII, A-Z in lower case; a null or empty text
has no words and is found by nothing, but counts as a document; a query without known words finds nothing; rows that repeat are
documents of their own; a null key is a document with a null id, after all others at a tie.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshots import Folder
from .batches import bounded_batches
from .knn import arrow_type

#: Bounds of a segment; postings of a block.
SEGMENT_DOCS, SEGMENT_WORDS, BLOCK = 65_536, 2_000_000, 128
#: Bytes of text that are cut into words at once, but for one longer text.
TEXT_AT_ONCE = 1 << 20
#: Queries, and words of them, that are sent to every task at once.
MOST_QUERIES, MOST_WORDS = 4_096, 400_000
K1, B = 1.2, 0.75
_BETWEEN = r"[\x00-\x2F\x3A-\x5E\x60\x7B-\x7F]+"


def cuts(sizes: np.ndarray, most: int, rows: int = 4096) -> list[tuple[int, int]]:
    """(first, number) of runs of at most ``rows`` rows and ``most`` bytes, or of one row."""
    out, a, total = [], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > a and (total + size > most or k - a == rows):
            out.append((a, k - a))
            a, total = k, 0
        total += size
    return [*out, (a, len(sizes) - a)] if len(sizes) else out


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text; empty strings may stand at the ends."""
    return pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_BETWEEN)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, the last of each below 128; and where each number's bytes end."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        long = size > k
        if not long.any():
            break
        out[(ends - size)[long] + k] = values[long] >> 7 * k & 127 | np.where(size[long] > k + 1, 128, 0)
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    size, out = ends - starts + 1, (raw[starts] & 127).astype(np.int64)
    for k in range(1, 5):
        long = size > k
        if not long.any():
            break
        out[long] |= (raw[starts[long] + k] & 127).astype(np.int64) << 7 * k
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of some bytes, by where they end."""
    edges = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


def encoded(of_term: np.ndarray, docs: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(heads, blocks) of each term, from its sorted postings. A block's head: first ordinal, last less first, greatest tf, least length, bytes."""
    term_at = _starts(of_term)
    size = np.diff(term_at, append=len(docs))
    place = np.arange(len(docs)) - np.repeat(term_at, size)
    block_at = np.flatnonzero(place % BLOCK == 0)
    gaps = np.diff(docs, prepend=0)
    gaps[block_at] = 0
    data, ends = pack(np.stack([gaps, tf], axis=1).ravel())
    ends = ends[1::2]  # of each posting
    last = np.append(block_at[1:], len(docs)) - 1
    heads = np.stack([docs[block_at], docs[last] - docs[block_at], np.maximum.reduceat(tf, block_at), np.minimum.reduceat(lengths[docs], block_at), np.diff(ends[last], prepend=0)], axis=1)
    head_data, head_ends = pack(heads.ravel())
    blocks = np.cumsum(-(-size // BLOCK))
    return _binary(head_data, head_ends[5 * blocks - 1]), _binary(data, ends[term_at + size - 1])


class Postings:
    """A term's postings in one segment. heads: for each block first and last ordinal, greatest tf, least length, end of its bytes."""

    def __init__(self, heads: bytes, blocks: bytes):
        self.heads, self.blocks = unpack(heads).reshape(-1, 5), blocks
        self.heads[:, 1] += self.heads[:, 0]
        self.heads[:, 4] = np.cumsum(self.heads[:, 4])
        self.held: tuple[np.ndarray, np.ndarray] | None = None

    def some(self, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, frequencies) of some blocks."""
        ends = self.heads[:, 4]
        pairs = unpack(b"".join(self.blocks[(ends[k - 1] if k else 0) : ends[k]] for k in ks.tolist())).reshape(-1, 2)
        at = np.minimum(np.arange(len(ks)) * BLOCK, len(pairs))  # only a term's last block isn't full
        size = np.diff(at, append=len(pairs))
        run = np.cumsum(pairs[:, 0])
        return run + np.repeat(self.heads[ks, 0] - run[at], size) if len(ks) else run, pairs[:, 1]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All of them; kept for the segment's other queries."""
        if self.held is None:
            self.held = self.some(np.arange(len(self.heads)))
        return self.held


def _segment(ids: list[pa.Array], words: list[pa.Array], counts: np.ndarray, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: its documents under the empty term, then its terms."""
    lengths, _ = pack(counts)
    yield pa.RecordBatch.from_pylist([{"segment": name, "term": "", "docs": len(counts), "words": int(counts.sum()), "lengths": lengths.tobytes(), "ids": pa.concat_arrays(ids).to_pylist()}], schema)
    coded = pa.chunked_array(words, pa.string()).combine_chunks()
    ids.clear(), words.clear()
    coded = coded.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    if not len(code):
        return
    order = np.argsort(code, kind="stable")
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
    position = (np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)[order]
    code = code[order]
    pair = _starts(code, doc)
    tf, of_term, docs = np.diff(pair, append=len(code)), code[pair], doc[pair].astype(np.int64)
    heads, blocks = encoded(of_term, docs, tf, counts)
    steps = np.diff(position, prepend=np.int32(0))
    steps[pair] = position[pair]  # a document's first position stands as it is
    step_data, step_ends = pack(steps.astype(np.int64))
    at, n = _starts(of_term), len(heads)
    columns = [pa.array([name]).take(pa.array(np.zeros(n, np.int32))), coded.dictionary.take(pa.array(of_term[at])), pa.array(np.diff(at, append=len(pair))), pa.nulls(n, pa.int64()), heads, blocks, _binary(step_data, step_ends[np.append(pair[at[1:]], len(code)) - 1]), pa.nulls(n, pa.binary()), pa.nulls(n, schema.field("ids").type)]
    whole = pa.RecordBatch.from_arrays(columns, schema=schema)
    for a in range(0, n, 16_384):
        yield whole.slice(a, 16_384)


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(segment, term, docs, heads, blocks, positions) of all terms; one row a segment with the empty term holds its words, lengths and ids."""
    kind = docs.schema[key].dataType.simpleString()
    id_type = arrow_type(docs, key)
    schema = pa.schema([("segment", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("words", pa.int64()), ("heads", pa.binary()), ("blocks", pa.binary()), ("positions", pa.binary()), ("lengths", pa.binary()), ("ids", pa.list_(id_type))])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        words: list[pa.Array] = []
        counts: list[np.ndarray] = []
        made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            yield from _segment(ids, words, np.concatenate(counts), f"{part:06d}-{made:04d}", schema)
            made += 1
            ids.clear(), words.clear(), counts.clear()

        part = None
        for batch in batches:
            for a, n in cuts(pc.fill_null(pc.binary_length(batch["t"]), 0).to_numpy(zero_copy_only=False), TEXT_AT_ONCE):
                rows = batch.slice(a, n)
                part = rows["part"][0].as_py() if part is None else part
                lists = words_of(rows["t"])
                flat, parents = lists.flatten(), lists.value_parent_indices().to_numpy()
                real = pc.not_equal(flat, "")
                ids.append(rows["id"])
                words.append(flat.filter(real))
                counts.append(np.bincount(parents[real.to_numpy(zero_copy_only=False)], minlength=rows.num_rows))
                if sum(map(len, counts)) >= SEGMENT_DOCS or sum(map(len, words)) >= SEGMENT_WORDS:
                    yield from flush()
        if ids:
            yield from flush()

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.spark_partition_id().alias("part"))
    return source.mapInArrow(of_task, f"segment string, term string, docs long, words long, heads binary, blocks binary, positions binary, lengths binary, ids array<{kind}>")


@dataclass
class _Term:
    held: Postings
    weight: float
    bound: float = 0.0


class _Top:
    """The best k (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0), np.empty(0, object)

    def floor(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, np.round(score, 9)]), np.concatenate([self.ids, ids])
        if len(score) > self.k:
            near = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[near], ids[near]
        order = sorted(range(len(score)), key=lambda j: (-score[j], ids[j] is None, ids[j] if ids[j] is not None else 0))[: self.k]
        self.score, self.ids = score[order], ids[order]


def _saturated(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


#: What rounding may add to a bound.
_SLACK = 1e-8


def score_segment(terms: list[_Term], lengths: np.ndarray, mean: float, floor: float, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ordinals, scores) of the documents that may score ``floor`` or more. seen: counts blocks read."""
    for t in terms:
        t.bound = t.weight * float(_saturated(t.held.heads[:, 2], t.held.heads[:, 3], mean).max())
    terms = sorted(terms, key=lambda t: t.bound)
    below = np.cumsum([t.bound for t in terms])
    if below[-1] + _SLACK < floor:
        return np.empty(0, np.int64), np.empty(0)
    essential = int(np.searchsorted(below + _SLACK, floor))  # terms before it can't reach the floor together
    total = np.zeros(len(lengths))
    hit = np.zeros(len(lengths), bool)
    for t in terms[essential:]:
        docs, tf = t.held.whole()
        total[docs] += t.weight * _saturated(tf, lengths[docs], mean)
        hit[docs] = True
        if seen is not None:
            seen["blocks"] = seen.get("blocks", 0) + len(t.held.heads)
    found = np.flatnonzero(hit)
    for j in range(essential - 1, -1, -1):
        found = found[total[found] + below[j] + _SLACK >= floor]
        heads = terms[j].held.heads
        at = np.searchsorted(heads[:, 1], found)
        inside = np.flatnonzero(at < len(heads))
        inside = inside[heads[at[inside], 0] <= found[inside]]
        reach = terms[j].weight * _saturated(heads[at[inside], 2], heads[at[inside], 3], mean)
        rest = below[j - 1] if j else 0.0
        blocks = np.unique(at[inside[total[found[inside]] + reach + rest + _SLACK >= floor]])  # others' blocks can't lift a document far enough
        docs, tf = terms[j].held.some(blocks)
        if seen is not None:
            seen["blocks"] = seen.get("blocks", 0) + len(blocks)
            seen["skipped"] = seen.get("skipped", 0) + len(heads) - len(blocks)
        wanted = hit[docs]
        total[docs[wanted]] += terms[j].weight * _saturated(tf[wanted], lengths[docs[wanted]], mean)
    return found, total[found]


class TextIndex:
    """An inverted index at a path of any file system that Spark opens."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.meta: dict = json.loads(self.folder.read("CURRENT") or '{"versions": []}')

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "id", text: str = "text") -> TextIndex:
        self = cls(docs.sparkSession, path)
        self.meta = {"versions": []}
        self.add(docs, key, text)
        return self

    def add(self, docs: DataFrame, key: str = "id", text: str = "text", **noted: object) -> None:
        """More documents, as segments of their own; readers see them once the pointer file names them. noted: goes into it beside."""
        version = max(self.meta["versions"], default=0) + 1
        rows = segments(docs, key, text).withColumn("range", F.pmod(F.xxhash64("term"), F.lit(64)))
        rows.hint("rebalance", "range").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.folder.path}/v={version}")
        self.meta["versions"].append(version)
        self.meta |= noted
        self.folder.write("CURRENT", json.dumps(self.meta))

    def ids(self) -> DataFrame:
        """(id) of all documents."""
        return self.rows().where("term = ''").select(F.explode("ids").alias("id"))

    def rows(self) -> DataFrame:
        top = self.folder.path
        return self.spark.read.option("basePath", top).parquet(*(f"{top}/v={v}" for v in self.meta["versions"]))

    def terms(self, wanted: list[str] | None = None) -> DataFrame:
        """(term, df): in how many documents each term is; wanted: of some terms."""
        rows = self.rows().where("term <> ''") if wanted is None else self._of(wanted)
        return rows.groupBy("term").agg(F.sum("docs").alias("df"))

    def size(self) -> tuple[int, float]:
        """Documents, and words a document."""
        n, total = self.rows().where("term = ''").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        return n, total / n if n else 0.0

    def _asked(self, queries: DataFrame, query_key: str, text: str) -> Iterator[list[tuple]]:
        """Parts of the queries, each with the list of its words."""
        part, size = [], 0
        for r in queries.select(F.col(query_key).alias("q"), F.col(text).alias("t")).toLocalIterator():
            words = [w for w in words_of(pa.array([r.t], pa.string()))[0].as_py() if w]
            if part and (len(part) >= MOST_QUERIES or size + len(words) > MOST_WORDS):
                yield part
                part, size = [], 0
            part.append((r.q, words))
            size += len(words)
        if part:
            yield part

    def _of(self, terms: list[str]) -> DataFrame:
        """The rows of some terms, those of one part of the queries: so they are few enough to be sent to every task."""
        if len(terms) <= 8:  # the scan skips what has none of them
            return self.rows().where(F.col("term").isin(*terms))
        return self.rows().join(F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")

    def _segments_of(self, terms: list[str], *columns: str) -> DataFrame:
        """For each segment the rows of some terms that it has, its documents' row among them."""
        bounded_batches(self.spark)
        return self._of([*terms, ""]).groupBy("v", "segment").agg(F.collect_list(F.struct("term", *columns)).alias("held"))

    def top_k(self, queries: DataFrame, k: int, query_key: str = "query_id", text: str = "text") -> DataFrame:
        """(query_id, id, score, rank) of the k best documents of each query by BM25."""
        query_kind, id_kind = queries.schema[query_key].dataType.simpleString(), self.rows().schema["ids"].dataType.elementType.simpleString()
        schema = f"query_id {query_kind}, id {id_kind}, score double"
        n, mean = self.size()
        types = arrow_type(queries, query_key), arrow_type(self.spark.createDataFrame([], f"id {id_kind}"), "id")
        found = self.spark.createDataFrame([], schema)
        for held in self._asked(queries, query_key, text):
            terms = sorted({w for _, ws in held for w in ws})
            df = {r.term: r.df for r in self.terms(terms).collect()}  # one number a query term
            weight = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in df.items()}
            asked = [(q, sorted({w for w in ws if w in weight})) for q, ws in held]
            shared = self.spark.sparkContext.broadcast((asked, weight))
            found = found.unionByName(self._segments_of(sorted(weight), "heads", "blocks", "lengths", "ids").select("held").mapInArrow(_scorer(shared, types, mean, k), schema))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def phrase(self, queries: DataFrame, query_key: str = "query_id", text: str = "text") -> DataFrame:
        """(query_id, id, places) of the documents that hold a query's words consecutively; places counts the starts."""
        query_kind, id_kind = queries.schema[query_key].dataType.simpleString(), self.rows().schema["ids"].dataType.elementType.simpleString()
        schema = f"query_id {query_kind}, id {id_kind}, places long"
        types = arrow_type(queries, query_key), arrow_type(self.spark.createDataFrame([], f"id {id_kind}"), "id")
        found = self.spark.createDataFrame([], schema)
        for held in self._asked(queries, query_key, text):
            asked = [(q, ws) for q, ws in held if ws]
            shared = self.spark.sparkContext.broadcast(asked)
            found = found.unionByName(self._segments_of(sorted({w for _, ws in asked for w in ws}), "heads", "blocks", "positions", "ids").select("held").mapInArrow(_phrases(shared, types), schema))
        return found


def _scorer(shared, types: tuple[pa.DataType, pa.DataType], mean: float, k: int):  # noqa: ANN001, ANN202
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best: dict[int, _Top] = {}
        for batch in batches:
            for held in batch["held"]:
                parts = {r["term"]: r for r in held.as_py()}
                ids, lengths = np.array([*parts[""]["ids"], None], object)[:-1], unpack(parts[""]["lengths"])
                postings = {t: Postings(r["heads"], r["blocks"]) for t, r in parts.items() if t}
                for j, (_, terms) in enumerate(asked):
                    have = [_Term(postings[t], weight[t]) for t in terms if t in postings]
                    if not have:
                        continue
                    top = best.setdefault(j, _Top(k))
                    docs, score = score_segment(have, lengths, mean, top.floor())
                    if len(docs):
                        top.add(score, ids[docs])
        for j, top in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([asked[j][0]] * len(top.ids), types[0]), pa.array(top.ids.tolist(), types[1]), pa.array(top.score.astype(float))], ["query_id", "id", "score"])

    return of_task


def _phrases(shared, types: tuple[pa.DataType, pa.DataType]):  # noqa: ANN001, ANN202
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch["held"]:
                parts = {r["term"]: r for r in held.as_py()}
                ids, reach = parts[""]["ids"], np.int64(1) << 32
                places: dict[str, np.ndarray] = {}  # document and position of each word as one number

                def at(term: str) -> np.ndarray:
                    if term not in places:
                        row = parts[term]
                        docs, tf = Postings(row["heads"], row["blocks"]).whole()
                        steps, starts = unpack(row["positions"]), np.cumsum(tf) - tf
                        run = np.cumsum(steps)
                        places[term] = np.repeat(docs, tf) * reach + run - np.repeat(run[starts] - steps[starts], tf)
                    return places[term]

                for q, words in shared.value:
                    if any(w not in parts for w in words):
                        continue
                    order = sorted(range(len(words)), key=lambda k: len(at(words[k])))
                    starts = at(words[order[0]]) - order[0]
                    for k in order[1:]:
                        starts = starts[np.isin(starts + k, at(words[k]), assume_unique=True)]
                    docs, n = np.unique(starts // reach, return_counts=True)
                    if len(docs):
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(docs), types[0]), pa.array([ids[d] for d in docs], types[1]), pa.array(n)], ["query_id", "id", "places"])

    return of_task
