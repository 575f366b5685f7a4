"""Chunk and manifest tables as versioned Parquet snapshots.

A write makes new version folders and then replaces the small pointer file
CURRENT, which names the versions of each table: readers see both tables of one
commit, and a failed write leaves nothing visible. A table is a base and up to
``MOST_DELTAS`` later versions, each of which adds rows and names keys of older rows
that go; one more writes a new base. One writer at a time (see ``lock``). Works on
any file system that Hadoop opens.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import token_estimate
from ..operators import stats
from ..types import CHUNKS, MANIFEST


class Folder:
    """A folder on a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed."""
        beside = self._at(f".{name}.new")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration()) if beside.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, self._at(name), options)

    def create(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet; False if it is."""
        at = self._fs.makeQualified(self._at(name))
        try:
            if at.toUri().getScheme() == "file":
                os.makedirs(os.path.dirname(at.toUri().getPath()), exist_ok=True)
                handle = os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                with os.fdopen(handle, "w") as f:
                    f.write(text)
            else:
                stream = self._fs.create(at, False)
                stream.write(bytearray(text.encode()))
                stream.close()
        except (FileExistsError, Py4JJavaError):
            if self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"cannot move {name} to {to}")


#: Later versions of a table that a read puts together, at most.
MOST_DELTAS = 16


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a scan in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_branch(manifest: DataFrame, default: str) -> DataFrame:
    """Rows of before there were branches belong to the current one."""
    branch = F.coalesce("branch", F.lit(default)) if "branch" in manifest.columns else F.lit(default)
    return manifest.withColumn("branch", branch)


class Store:
    """One index: ``chunks``, ``files``, the pointer and the metadata."""

    SCHEMAS = {"chunks": CHUNKS, "files": MANIFEST}
    #: What names a row of a table that goes.
    KEYS = {"chunks": ["id", "fileHash"], "files": ["branch", "filePath"]}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def _pointer(self) -> dict:
        found = json.loads(self.folder.read("CURRENT") or "{}")
        return {name: {"base": state, "deltas": [], "gone": []} if isinstance(state, int) else state for name, state in found.items()}

    def _read(self, name: str, letter: str, versions: list[int]) -> DataFrame:
        """The rows of some versions in one scan, with the version; of letter v whole rows, of letter g keys that go."""
        empty = self.spark.createDataFrame([], self.SCHEMAS[name])
        schema = (empty.select(self.KEYS[name]) if letter == "g" else empty).schema.add(letter, IntegerType())
        top = f"{self.folder.path}/{name}"
        return self.spark.read.option("basePath", top).schema(schema).parquet(*(f"{top}/{letter}={v}" for v in versions))

    def tables(self) -> dict[str, DataFrame]:
        """All tables as of one commit."""
        pointer = self._pointer()
        return {name: self.table(name, pointer) for name in self.SCHEMAS}

    def table(self, name: str, pointer: dict | None = None) -> DataFrame:
        """pointer: of the commit to read; the latest if none is given."""
        state, empty = (self._pointer() if pointer is None else pointer).get(name), self.spark.createDataFrame([], self.SCHEMAS[name])
        if state is None:
            return empty
        rows = self._read(name, "v", [state["base"], *state["deltas"]])
        if state["gone"]:
            latest = self._read(name, "g", state["gone"]).groupBy(*(F.col(c).alias(f"_{c}") for c in self.KEYS[name])).agg(F.max("g").alias("g"))
            match = reduce(lambda a, b: a & b, (rows[c] == latest[f"_{c}"] for c in self.KEYS[name]))
            rows = rows.join(latest, match & (rows["v"] < latest["g"]), "left_anti")
        return rows.select(empty.columns)

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def files(self, default_branch: str | None = None) -> DataFrame:
        found = self.table("files")
        return found if default_branch is None else with_branch(found, default_branch)

    def exists(self) -> bool:
        return bool(self._pointer())

    def _write(self, name: str, df: DataFrame, version: int, gone: bool = False) -> None:
        writer = df.hint("rebalance", "branch") if name == "files" and not gone else df  # a large branch is split, small ones share a task
        writer = writer.write.mode("overwrite")
        path = f"{self.folder.path}/{name}/{'g' if gone else 'v'}={version}"
        (writer.partitionBy("branch") if name == "files" and not gone else writer).parquet(path)
        if name == "chunks" and not gone:
            added = self.spark.read.schema(df.schema).parquet(path).withColumn("tokens", token_estimate(F.col("content")))
            stats.sketches(added, []).coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/sketches/v={version}")

    def estimates(self) -> DataFrame:
        """One row of about how many files and hashes the chunks have, and quantiles of their tokens, from a sketch a version; nothing of the tables is read. Rows that later commits took away count until the next base."""
        state = self._pointer().get("chunks")
        versions = [] if state is None else [v for v in (state["base"], *state["deltas"]) if self.folder.exists(f"sketches/v={v}")]
        if not versions:  # none, or written before there were sketches
            return stats.estimates(stats.sketches(self.chunks().withColumn("tokens", token_estimate(F.col("content"))), []), [])
        return stats.estimates(stats.merged_sketches(self.spark.read.parquet(*(f"{self.folder.path}/sketches/v={v}" for v in versions)), []), [])

    def _next(self, pointer: dict) -> int:
        return max((v for s in pointer.values() for v in (s["base"], *s["deltas"])), default=0) + 1

    def version(self) -> int:
        """Of the latest commit; 0 if there is none."""
        return self._next(self._pointer()) - 1

    def commit(self, **tables: DataFrame) -> None:
        """New whole tables; those not given stay."""
        pointer = self._pointer()
        version = self._next(pointer)
        for name, df in tables.items():
            self._write(name, df.select(self.spark.createDataFrame([], self.SCHEMAS[name]).columns), version)
            pointer[name] = {"base": version, "deltas": [], "gone": []}
        self.folder.write("CURRENT", json.dumps(pointer))

    def change(self, **tables: tuple[DataFrame | None, DataFrame | None]) -> None:
        """For each table, rows to add and keys of stored rows that go, in one commit. Stored rows are not written again, but once in ``MOST_DELTAS`` times."""
        pointer, whole = self._pointer(), {}
        version = self._next(pointer)
        for name, (added, removed) in tables.items():
            keys, columns = self.KEYS[name], self.spark.createDataFrame([], self.SCHEMAS[name]).columns
            state = pointer.get(name)
            if state is None or len(state["deltas"]) >= MOST_DELTAS:
                left = self.table(name) if removed is None else self.table(name).join(removed.select(keys).distinct(), keys, "left_anti")
                whole[name] = left.select(columns) if added is None else left.select(columns).unionByName(added.select(columns))
                self._write(name, whole[name], version)
                pointer[name] = {"base": version, "deltas": [], "gone": []}
                continue
            self._write(name, (self.spark.createDataFrame([], self.SCHEMAS[name]) if added is None else added).select(columns), version)
            state["deltas"].append(version)
            if removed is not None:
                self._write(name, removed.select(keys).distinct(), version, True)
                state["gone"].append(version)
        self.folder.write("CURRENT", json.dumps(pointer))

    def migrate(self, branch: str) -> None:
        """Writes a manifest of before there were branches with the current one."""
        if not self.table("files").where("branch IS NULL").isEmpty():
            self.commit(files=self.files(branch))

    def append(self, chunks: DataFrame) -> None:
        self.change(chunks=(chunks, None))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Chunks in the order of their keys."""
        return page(self.chunks(), self.KEYS["chunks"], limit, offset)

    def reset(self) -> None:
        """Empty tables; the model's baseline goes too."""
        empty = {name: self.spark.createDataFrame([], schema) for name, schema in self.SCHEMAS.items()}
        self.commit(**empty)
        self.folder.delete("meta.json")

    def compact(self, keep: int = 1, rows_per_file: int = 1_000_000) -> None:
        """Rewrites both tables, the chunks into few files, and drops versions beyond the last ``keep``."""
        chunks = self.chunks()
        self.commit(chunks=chunks.repartition(max(1, -(-chunks.count() // rows_per_file))), files=self.files())
        self.vacuum(keep)

    def vacuum(self, keep: int = 1) -> None:
        for name in self.SCHEMAS:
            state = self._pointer().get(name, {"base": 0, "deltas": [], "gone": []})
            live = {state["base"], *state["deltas"]}
            versions = sorted({int(v[2:]) for v in self.folder.names(name) if v[:2] in ("v=", "g=")} - live, reverse=True)
            for v in versions[keep - 1 :]:
                if name == "chunks":
                    self.folder.delete(f"sketches/v={v}")
                self.folder.delete(f"{name}/v={v}")
                self.folder.delete(f"{name}/g={v}")

    def metadata(self) -> dict:
        return json.loads(self.folder.read("meta.json") or "{}")

    def write_metadata(self, root: str, branch: str, model: str | None, dimensions: int | None, remote: str | None = None) -> dict:
        """Model and dimensions are a baseline: what is there stays."""
        old = self.metadata()
        new = {"root": root, "remote": remote, "branch": branch, "indexedAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "model": old.get("model") or model, "dimensions": old.get("dimensions") or dimensions}
        new = {k: v for k, v in new.items() if v is not None}
        self.folder.write("meta.json", json.dumps(new))
        return new

    def lock(self) -> bool:
        """True if this process is the writer now. The file is made only where none is; that of a process that is gone is moved away, which one taker can do."""
        mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid()})
        for _ in range(3):
            if self.folder.create("writer.lock", mine):
                return True
            held = self.folder.read("writer.lock")
            if held == mine:
                return True
            if held is None:
                continue
            if _alive(held):
                return False
            aside = f"stale-{uuid.uuid4().hex}.lock"
            try:
                self.folder.move("writer.lock", aside)
            except (OSError, Py4JJavaError):
                continue
            if (taken := self.folder.read(aside)) != held and taken is not None:  # another taker's new lock: it goes back
                self.folder.create("writer.lock", taken)
            self.folder.delete(aside)
        return False

    def holds_lock(self) -> bool:
        return _owner(self.folder.read("writer.lock")) == (socket.gethostname(), os.getpid())

    def unlock(self) -> None:
        if self.holds_lock():
            self.folder.delete("writer.lock")

    def is_locked(self) -> bool:
        owner = self.folder.read("writer.lock")
        return owner is not None and _alive(owner)


class LockedError(RuntimeError):
    pass


class Writing:
    """Holds an index's lock while it is changed, unless this process has it already."""

    def __init__(self, store: Store):
        self.store, self.had = store, store.holds_lock()

    def __enter__(self) -> None:
        if not self.store.lock():
            raise LockedError("another process writes this index")

    def __exit__(self, *_: object) -> None:
        if not self.had:
            self.store.unlock()


def _owner(text: str | None) -> tuple[str, int] | None:
    """(host, pid); locks of older versions hold a pid alone."""
    try:
        found = json.loads(text or "null")
    except ValueError:
        return None
    if isinstance(found, int):
        return socket.gethostname(), found
    return (found["host"], found["pid"]) if found else None


def _alive(text: str) -> bool:
    """A lock of another host counts as alive: nothing here can tell."""
    owner = _owner(text)
    return owner is not None and (owner[0] != socket.gethostname() or os.path.exists(f"/proc/{owner[1]}"))


def indexes(spark: SparkSession, base: str) -> list[tuple[str, dict]]:
    """(path, metadata) of every index below a folder."""
    folder = Folder(spark, base)
    found = [(f"{folder.path}/{name}", Store(spark, f"{folder.path}/{name}").metadata()) for name in folder.names()]
    return [(path, meta) for path, meta in found if meta]


def running(spark: SparkSession, base: str) -> DataFrame:
    """Live writers: pid, kind, root and branch."""
    from ..functions.text import process_kind

    rows = []
    for path, meta in indexes(spark, base):
        owner = _owner(Folder(spark, path).read("writer.lock"))
        if owner and owner[0] == socket.gethostname() and os.path.exists(f"/proc/{owner[1]}"):
            with open(f"/proc/{owner[1]}/comm") as name, open(f"/proc/{owner[1]}/cmdline") as command:
                rows.append((owner[1], name.read().strip(), command.read().replace("\0", " ").strip(), meta.get("root"), meta.get("branch")))
    df = spark.createDataFrame(rows, "pid long, process string, command string, root string, branch string").dropDuplicates(["pid"])
    return df.select("pid", process_kind(F.col("process"), F.col("command")).alias("kind"), "root", "branch")
