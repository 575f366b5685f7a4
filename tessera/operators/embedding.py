"""Embedding as an Arrow-batched map over chunks.

An embedder is any object with ``embed(texts)`` and ``embed_query(text)``; it is
sent to the tasks, so it must pickle. A batch that fails is tried text by text; after
``MAX_FAILURES`` batches in a row of which nothing worked, the embedder is reloaded
(if it can be, and at most ``MAX_RELOADS`` times), and then the rest of the task
counts as failed. Every input row comes out, with a vector or an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

BATCH, PAUSE_S, MAX_FAILURES, MAX_RELOADS = 100, 0.2, 3, 3


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


@lru_cache(1 << 18)
def _hash(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


class HashEmbedder:
    """Deterministic stand-in for a learned model: hashed word counts, normalised. Not semantic."""

    def __init__(self, dimensions: int = 64, query_prefix: str = "", document_prefix: str = ""):
        self.dimensions, self.query_prefix, self.document_prefix = dimensions, query_prefix, document_prefix

    def vector(self, text: str) -> list[float]:
        tokens = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        out = np.bincount(np.fromiter(map(_hash, tokens), np.int64, len(tokens)) % self.dimensions, minlength=self.dimensions).astype(float)
        return (out / (np.sqrt((out * out).sum()) or 1)).tolist()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.vector(self.document_prefix + t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self.vector(self.query_prefix + text)


class HttpEmbedder:
    """A model behind an HTTP service that takes {"model", "input"} at /embeddings and answers {"data": [{"index", "embedding"}]}, as most do."""

    def __init__(self, model: str, base_url: str, key_name: str = "", query_prefix: str = "", document_prefix: str = "", timeout_s: float = 60.0):
        self.model, self.base_url, self.key_name, self.timeout_s = model, base_url.rstrip("/"), key_name, timeout_s
        self.query_prefix, self.document_prefix = query_prefix, document_prefix

    #: Between the batches of a task, so that the service isn't pressed.
    pause_s = PAUSE_S

    def reload(self) -> bool:
        """Whether the service answers again, which it is given a while for."""
        for wait in (1.0, 4.0):
            time.sleep(wait)
            try:
                return bool(self._ask(["reload"]))
            except Exception:  # noqa: BLE001  still away
                continue
        return False

    def _ask(self, texts: list[str]) -> list[list[float]]:
        key = os.environ.get(self.key_name) if self.key_name else None  # read where it runs: keys don't travel with tasks
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(f"{self.base_url}/embeddings", json.dumps({"model": self.model, "input": texts}).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
            found = json.load(answer)["data"]
        return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._ask([self.document_prefix + t for t in texts])

    def embed_query(self, text: str) -> list[float]:
        return self._ask([self.query_prefix + text])[0]


def _http(default_url: str | None, key_name: str = "") -> Callable[..., Embedder]:
    def make(model: str, base_url: str | None = None, query_prefix: str = "", document_prefix: str = "", **_: object) -> Embedder:
        if not (base_url or default_url):
            raise ValueError("this provider needs a baseURL")
        return HttpEmbedder(model, base_url or default_url, key_name, query_prefix, document_prefix)

    return make


#: Providers by name; the URLs are the services' public defaults.
PROVIDERS: dict[str, Callable[..., Embedder]] = {"openai": _http("https://api.openai.com/v1", "OPENAI_API_KEY"), "ollama": _http("http://localhost:11434/v1"), "lmstudio": _http("http://localhost:1234/v1"), "http": _http(None, "EMBEDDING_API_KEY"), "hash": lambda model, dimensions=None, query_prefix="", document_prefix="", **_: HashEmbedder(dimensions or int(re.sub(r"\D", "", model) or 64), query_prefix, document_prefix)}


def embedder_for(model: str, **options: object) -> Embedder:
    """``provider:model`` by the registry of providers."""
    provider, _, name = model.partition(":")
    if not name or provider not in PROVIDERS:
        raise ValueError(f"unknown model {model!r}; providers: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[provider](name, **options)


class Resilient:
    """The driver of one task's batches."""

    def __init__(self, embedder: Embedder, dimensions: int | None = None, pause_s: float = 0.0):
        self.embedder, self.dimensions, self.pause_s = embedder, dimensions, pause_s
        self.failures = self.reloads = 0
        self.aborted = False

    def _checked(self, vector: list[float]) -> list[float]:
        if self.dimensions and len(vector) != self.dimensions:
            raise ValueError(f"vector of {len(vector)} dimensions; the index has {self.dimensions}")
        return [float(x) for x in vector]

    def _one(self, text: str) -> tuple[list[float] | None, str | None]:
        try:
            return self._checked(self.embedder.embed([text])[0]), None
        except Exception as e:  # noqa: BLE001  an embedder may raise anything; the row carries it on
            return None, f"{type(e).__name__}: {e}"

    def _once(self, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = self.embedder.embed(texts)
            if len(vectors) != len(texts):
                raise ValueError("as many vectors as texts are needed")
            return [(self._checked(v), None) for v in vectors]
        except Exception:  # noqa: BLE001
            return [self._one(t) for t in texts]

    def batch(self, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        if self.aborted:
            return [(None, "aborted")] * len(texts)
        out = self._once(texts)
        if any(v is not None for v, _ in out):
            self.failures = 0
        else:
            self.failures += 1
            if self.failures >= MAX_FAILURES:
                reload = getattr(self.embedder, "reload", None)
                if reload and self.reloads < MAX_RELOADS and reload():
                    self.reloads, self.failures = self.reloads + 1, 0
                    out = self._once(texts)
                else:
                    self.aborted = True
        time.sleep(self.pause_s)
        return out


def embedded(chunks: DataFrame, embedder: Embedder, text: str = "embedText", dimensions: int | None = None, batch: int = BATCH, pause_s: float = 0.0) -> DataFrame:
    """The rows with ``vector`` and ``error`` instead of the text."""
    schema = StructType([f for f in chunks.schema.fields if f.name != text] + [StructField("vector", ArrayType(FloatType())), StructField("error", StringType())])

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        driver = Resilient(embedder, dimensions, pause_s)
        for rows in batches:
            for a in range(0, len(rows), batch):
                part = rows.iloc[a : a + batch]
                vectors, errors = zip(*driver.batch(part[text].tolist()), strict=True)
                yield part.drop(columns=[text]).assign(vector=list(vectors), error=list(errors))

    return chunks.mapInPandas(of_task, schema)


def batch_totals(rows: DataFrame, batch: int = BATCH, text: str = "embedText", order: str = "id") -> DataFrame:
    """(batch, texts, tokens): what each batch of ``batch`` rows in the order of a key holds, by the estimate of four characters a token.

    Rows are numbered within ranges of the key, so no task sees them all. The ranges are written once: cut anew for the counts,
    they would be other ranges.
    """
    from pyspark.sql import Window

    from ..functions.text import token_estimate
    from ..sources.scratch import checkpointed

    ranged = checkpointed(rows.select(order, token_estimate(F.col(text)).alias("tokens")).repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    row = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    numbered = ranged.withColumn("row", row).join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")  # one row a partition
    return numbered.groupBy(F.floor((F.col("row") + F.col("before")) / batch).alias("batch")).agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))
