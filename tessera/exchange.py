"""Export and import of an index as a folder, optionally sealed with a share code.

Layout: ``meta.json``, ``chunks/`` and ``files/``, and, last, ``DONE`` with the
counts: an import takes a whole export or nothing. Sealed exports hold rows
as AES-GCM payloads of a key that only the share code gives.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import secrets
from .functions.text import model_family
from .operators import changes
from .sources.snapshots import Folder, Store, Writing, with_branch


class IncompatibleError(ValueError):
    pass


def _seal(df: DataFrame, code: str | None) -> DataFrame:
    return df if code is None else df.select(secrets.sealed(F.encode(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), "UTF-8"), code).alias("payload"))


def _open(df: DataFrame, schema: str, code: str | None) -> DataFrame:
    return df if code is None else df.select(F.from_json(F.decode(secrets.opened(F.col("payload"), code), "UTF-8"), schema).alias("r")).select("r.*")


def export(store: Store, to: str, code: str | None = None) -> dict:
    if code is not None and not secrets.CODE.match(code):
        raise ValueError("not a share code")
    folder, tables = Folder(store.spark, to), store.tables()
    folder.delete("DONE")
    for name, df in tables.items():
        _seal(df, code).write.mode("overwrite").parquet(f"{folder.path}/{name}")
    counts = {name: store.spark.read.parquet(f"{folder.path}/{name}").count() for name in tables}
    folder.write("meta.json", json.dumps(store.metadata()))
    folder.write("DONE", json.dumps(counts | {"sealed": code is not None}))
    return counts


def import_(spark: SparkSession, source: str, store: Store, code: str | None = None, reset: bool = False, default_branch: str = "_default", log: Callable[[str], None] = print) -> dict:
    """Rows that the index lacks, by id and file hash; branches stay what they were."""
    folder = Folder(spark, source)
    done, meta = json.loads(folder.read("DONE") or "null"), json.loads(folder.read("meta.json") or "{}")
    if done is None:
        raise FileNotFoundError("not a complete export")
    if done["sealed"] != (code is not None):
        raise ValueError("a share code is needed" if done["sealed"] else "this export isn't sealed")
    own = store.metadata()
    if not reset and own.get("dimensions") and meta.get("dimensions") and own["dimensions"] != meta["dimensions"]:
        raise IncompatibleError(f"the export has {meta['dimensions']} dimensions, the index {own['dimensions']}")
    if not reset and own.get("model") and meta.get("model") and not same_family(spark, own["model"], meta["model"]):
        log(f"warning: the export was made with {meta['model']}, the index with {own['model']}")
    chunks, files = (_open(spark.read.parquet(f"{folder.path}/{name}"), Store.SCHEMAS[name], code) for name in ("chunks", "files"))
    return merge(store, chunks, files, meta, reset, default_branch)


def same_family(spark: SparkSession, one: str, other: str) -> bool:
    return spark.range(1).select(model_family(F.lit(one)) == model_family(F.lit(other))).first()[0]


def new_rows(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks, each once, whose id and file hash the stored ones lack."""
    return chunks.dropDuplicates(Store.KEYS["chunks"]).join(stored.select(Store.KEYS["chunks"]), Store.KEYS["chunks"], "left_anti")


def merge(store: Store, chunks: DataFrame, files: DataFrame, meta: dict, reset: bool = False, default_branch: str = "_default") -> dict:
    with Writing(store):
        if reset:
            store.reset()
        store.migrate(default_branch)
        files = with_branch(files, default_branch)
        stored = store.chunks()
        new = new_rows(chunks, stored).select(stored.columns)
        counts = {"chunks": new.count(), "files": files.count()}
        store.change(chunks=(new, None), files=changes.manifest_change(store.files(), changes.upsert(store.files(default_branch), files)))
        store.write_metadata(meta.get("root", ""), meta.get("branch", default_branch), meta.get("model"), meta.get("dimensions"), meta.get("remote"))
    return counts
