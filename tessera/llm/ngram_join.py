"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are their distinct word
n-grams; the product of the matrix with its transpose counts overlaps. It is
never formed as a whole:

* Document frequencies of all n-grams come from the block exchange. An n-gram of
  one document overlaps with nothing, so its column is left out.
* Documents with equal sets are one row of the matrix.
* A document's n-grams are ordered by frequency, rarest first. Documents that
  link must share one of their first n - ceil(t n) + 1; a document whose first
  ones are all unique links with nothing.
* Rows that share such an n-gram meet in the group of its leader, the row with the
  fewest unique n-grams among those that share it. Rows that share several meet
  in few groups, since near copies have the same leader.
* The leader's row is multiplied with all rows of the group first. Rows that link
  to it are of one component already; only the others meet the whole group.
* For that, a group is cut into classes by set size, wide enough that rows that link
  are of one class or of two next to each other, and a class into blocks bounded by
  ``BLOCK_ROWS`` rows and about ``BLOCK_BYTES``. Other pairs of blocks are never formed. Each
  pair of blocks is one product: overlap counts are accumulated column by column in
  a small dense matrix, and pairs below the bound t / (1 + t) (n_x + n_y) are
  discarded. Of the links left, a spanning forest is emitted: fewer links than
  rows, and the same components.

Defined results: a null or empty text has an empty set and links with nothing; a
text with fewer words than an n-gram has its whole sequence as one; documents
with a null doc_id link with nothing and have a null component; rows of equal
doc_id are one document; other columns of the input play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import Run, Texts
from .common import checkpointed, documents, window_hashes, word_hashes
from .components import connected_components

#: Rows of a block, and bytes of their sets: what a product holds of each side, but for one longer row.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: The block exchange compares the upper 48 bits; a frequency counted too high by a collision costs time, not results.
_UPPER = ~np.uint64(0xFFFF)
#: Columns with at most so many rows are accumulated together, not one by one.
_NARROW = 12


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams, A-Z in lower case."""
    words = word_hashes(text.lower().split())
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def frequencies(runs: list[Run]) -> list[bytes]:
    """For each n-gram of each run, its document frequency in a byte: as it is below 128, then by powers of two."""
    keys, counts = np.concatenate([r.keys for r in runs]), np.concatenate([r.ids for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.append(True, keys[1:] != keys[:-1])
    total = np.add.reduceat(counts[order], np.flatnonzero(first))
    scaled = np.where(total < 128, total, 128 + np.log2(total).astype(np.int64)).astype(np.uint8)
    flags = np.empty(len(keys), np.uint8)
    flags[order] = scaled[np.cumsum(first) - 1]
    return [x.tobytes() for x in np.split(flags, np.cumsum([len(r.keys) for r in runs])[:-1])]


def _added(runs: list[Run]) -> Run:
    """One run with the sums of the frequencies."""
    keys, counts = np.concatenate([r.keys for r in runs]), np.concatenate([r.ids for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return Run(keys[first], np.add.reduceat(counts[order], first))


def _counted(sets: list[np.ndarray]) -> Run:
    keys, counts = np.unique(np.concatenate([*(np.unique(s & _UPPER) for s in sets), np.empty(0, np.uint64)]), return_counts=True)
    return Run(keys, counts.astype(np.int64))


def incidence(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, signature of the set; for documents that may link: n_unique, the first n-grams that others hold too, and all such n-grams."""
    rows, _, buckets = blocks.chunked(docs.select("doc_id", "text"))

    def run(texts: Texts) -> Run:
        return _counted([shingles(text, size) for _, text in texts])

    def apply(texts: Texts, back: pa.Table) -> pa.Table:
        sets = [shingles(text, size) for _, text in texts]
        own, often = _counted(sets), blocks.answer(back)
        out = []
        for s in sets:
            n, first, shared, unique = len(s), None, None, None
            if n:
                times = often[own.find(s & _UPPER)]
                unique, lead = int((times == 1).sum()), n - -(-percent * n // 100) + 1
                if unique < lead:
                    ordered = s[np.lexsort((s, times))]
                    first, shared = ordered[unique:lead].view(np.int64), s[times > 1].tobytes()
            out.append((n, xxhash.xxh3_128_digest(s.tobytes()) if n else None, unique, first, shared))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        return pa.table([texts.table.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n", "signature", "n_unique", "first", "shared"])

    answers = blocks.resolve(blocks.emit(rows, buckets, run), frequencies, buckets=buckets, within=lambda runs: [bytes(len(r.keys)) for r in runs], join=_added)
    return blocks.finish(rows, answers, apply, "doc_id long, n long, signature binary, n_unique long, first array<long>, shared binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of each left row with each right one, column by column."""
    sets, n, m = left + right, len(left), len(right)
    counts = np.zeros(n * m, np.int32)
    flat, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    widths = np.diff(np.append(starts, len(flat)))
    for width in range(2, _NARROW + 1):
        columns = owner[starts[widths == width][:, None] + np.arange(width)]
        for i in range(width):
            for j in range(width):
                keep = (columns[:, i] < n) & (columns[:, j] >= n)
                np.add.at(counts, columns[keep, i] * m + columns[keep, j] - n, 1)
    counts = counts.reshape(n, m)
    for start, width in zip(starts[widths > _NARROW].tolist(), widths[widths > _NARROW].tolist(), strict=True):
        rows = owner[start : start + width]
        counts[np.ix_(rows[rows < n], rows[rows >= n] - n)] += 1
    return counts


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with this symmetric matrix."""
    new, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not new[start]:
            continue
        new[start], todo = False, [start]
        while todo:
            u = todo.pop()
            found = np.flatnonzero(linked[u] & new)
            new[found] = False
            todo += found.tolist()
            out += [(u, v) for v in found.tolist()]
    return out


def _sets(table: pa.Table, rows: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shared").take(pa.array(rows))]


def _linked(counts: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Pairs at or above the bound that their sizes give."""
    return (counts > 0) & (counts.astype(np.int64) * (100 + percent) >= percent * (n_left[:, None] + n_right[None, :]))


def star(table: pa.Table, percent: int) -> pa.Table:
    """(leader, doc_id, n, bytes, linked): the rows of a part of a group against its leader, one row of the matrix."""
    ids, n = (np.asarray(table.column(c)) for c in ("doc_id", "n"))
    leader = table.column("leader")[0].as_py()
    own, others = np.flatnonzero(ids == leader), np.flatnonzero(ids != leader)
    linked = _linked(overlaps(_sets(table, own), _sets(table, others)), n[own], n[others], percent).any(0) if len(others) else np.empty(0, bool)
    width = np.asarray(pc.binary_length(table.column("shared")))
    return pa.table({"leader": pa.array([leader] * len(others), pa.int64()), "doc_id": pa.array(ids[others], pa.int64()), "n": pa.array(n[others], pa.int64()), "bytes": pa.array(width[others], pa.int64()), "linked": pa.array(linked, pa.bool_())})


def product(table: pa.Table, percent: int) -> pa.Table:
    """Links of one pair of blocks."""
    ids, n, left = (np.asarray(table.column(c)) for c in ("doc_id", "n", "is_left"))
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    edges: list[tuple[int, int]] = []
    if len(x) and len(y):
        linked = _linked(overlaps(_sets(table, x), _sets(table, y)), n[x], n[y], percent) & (ids[x][:, None] != ids[y][None, :])
        whole = np.zeros((len(x) + len(y),) * 2, bool)
        whole[: len(x), len(x) :] = linked
        whole[len(x) :, : len(x)] = linked.T
        both = ids[np.append(x, y)]
        edges = [(int(both[u]), int(both[v])) for u, v in forest(whole)]
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _place(parts: str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(parts)).cast("int")


def _each(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _parts(rows: Column, size: Column) -> Column:
    """Blocks for so many rows and bytes."""
    return F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_BYTES)).cast("int")


def size_class(n: Column, percent: int) -> Column:
    """Sets link only if the smaller has ``percent`` of the larger's size: classes of that ratio, a trifle wider, so that rounding can't part them by two."""
    return F.floor(F.ln(n) / (math.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else n.cast("int")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect all rows (doc_id, n, n_unique, first, shared) of a component."""
    postings = rows.select("doc_id", "n_unique", (F.col("n") - F.col("n_unique")).alias("n_shared"), F.explode("first").alias("gram"))
    leaders = postings.groupBy("gram").agg(F.min(F.struct("n_unique", "doc_id"))["doc_id"].alias("leader"), F.count("*").alias("c")).where("c > 1").select("gram", "leader")
    members = postings.select("gram", "doc_id", "n_shared").join(leaders, "gram").select("leader", "doc_id", "n_shared").distinct()
    sets = rows.select("doc_id", "n", "shared")

    # Each row against its leader: those that link are of one component, and no pair of them needs a look.
    parts = members.groupBy("leader").agg(_parts(F.count("*"), 8 * F.sum("n_shared")).alias("parts"))
    leading = parts.select("leader", F.col("leader").alias("doc_id"), _each("parts").alias("part"))
    following = members.where("doc_id <> leader").join(parts, "leader").select("leader", "doc_id", _place("parts").alias("part"))
    against = leading.unionByName(following).join(sets, "doc_id").groupBy("leader", "part")
    seen = checkpointed(against.applyInArrow(lambda table: star(table, percent), "leader long, doc_id long, n long, bytes long, linked boolean"))

    # The others against the rows of the group that their sizes let them link with, but for the leader, block by block.
    classed = seen.withColumn("class", size_class(F.col("n"), percent))
    apart = F.when(~F.col("linked"), F.col("bytes"))
    counts = classed.groupBy("leader", "class").agg(F.count(apart).alias("apart"), F.sum(apart).alias("size"), F.count("*").alias("c"), F.sum("bytes").alias("whole"))
    lefts = counts.where("apart > 0").select("leader", F.col("class").alias("x"), F.col("c").alias("own"), _parts(F.col("apart"), F.col("size")).alias("lefts"), F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("y"))
    rights = counts.select("leader", F.col("class").alias("y"), "c", _parts(F.col("c"), F.col("whole")).alias("rights"))
    pairs = lefts.join(rights, ["leader", "y"]).where("x <> y OR own > 1").select("leader", "x", "y", "lefts", "rights")
    left = classed.where("NOT linked").withColumnRenamed("class", "x").join(pairs, ["leader", "x"]).select("leader", "doc_id", "x", "y", _place("lefts").alias("i"), _each("rights").alias("j"), F.lit(True).alias("is_left"))
    right = classed.withColumnRenamed("class", "y").join(pairs, ["leader", "y"]).select("leader", "doc_id", "x", "y", _each("lefts").alias("i"), _place("rights").alias("j"), F.lit(False).alias("is_left"))
    found = left.unionByName(right).join(sets, "doc_id").groupBy("leader", "x", "y", "i", "j").applyInArrow(lambda table: product(table, percent), "a long, b long")
    return found.unionByName(seen.where("linked").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    sets = checkpointed(incidence(docs, size, percent))
    named = sets.where("doc_id IS NOT NULL AND signature IS NOT NULL").select("doc_id", "signature")
    classes = named.groupBy("signature").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies"))
    likely = sets.where("doc_id IS NOT NULL AND first IS NOT NULL")
    firsts = likely.select("doc_id", "signature").groupBy("signature").agg(F.min("doc_id").alias("doc_id"))
    rows = likely.join(firsts, ["doc_id", "signature"], "left_semi").dropDuplicates(["doc_id", "signature"])
    same_id = named.groupBy("doc_id").agg(F.min("signature").alias("a"), F.max("signature").alias("b")).where("a <> b").select("doc_id")
    edges = links(rows, percent)
    # A doc_id whose rows differ ties the classes of its texts together.
    ties = named.join(same_id, "doc_id", "left_semi").join(classes, "signature").select(F.col("doc_id").alias("a"), F.col("representative").alias("b"))
    roots = connected_components(edges.unionByName(ties))
    grouped = classes.join(roots, classes["representative"] == roots["node"], "left").where("copies > 1 OR root IS NOT NULL").select("signature", F.coalesce("root", "representative").alias("component"))
    return sets.select("doc_id", "n", "signature").join(grouped, "signature", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest doc_id of their component, and those without a doc_id."""
    gone = ngram_join(docs, size, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), 3, 90)
