"""Change events as streams: debounced sets of paths, and incremental builds for each micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import extension
from ..operators.changes import working_tree
from ..sources.files import scan
from ..sources.ignore import DEFAULT_IGNORE, Matcher, extensions
from ..sources.snapshots import Folder, LockedError
from ..types import BuildOptions

DEBOUNCE = "2 seconds"
LISTING = "filePath string, fileHash string"


def wanted(events: DataFrame, path: str = "filePath", extra_ignore: list[str] | None = None, include: tuple = (), exclude: tuple = ()) -> DataFrame:
    """Events of named code files that the root rules don't ignore."""
    rules = Matcher([*DEFAULT_IGNORE, *(extra_ignore or [])])

    def keep(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield batch[[not rules(p) for p in batch[path]]]

    return events.where(F.col(path).isNotNull() & extension(F.col(path)).isin(extensions(include, exclude))).mapInPandas(keep, events.schema)


def debounced(events: DataFrame, key: str, ts: str = "ts", gap: str = DEBOUNCE, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of events with no pause of ``gap`` or more; works on a table and, within the watermark, on a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Watcher:
    """Compares listings of the tree: what changed since the last build is built once two polls in a row agree, so a burst of changes counts once.

    A listing is a table (path, time and length of each file that the rules let through) in ``folder``, and the last one that
    was built outlives the process; only whether listings differ comes to the driver.
    """

    def __init__(self, index: object, folder: str):
        self.index, self.files = index, Folder(index.spark, folder)
        state = json.loads(self.files.read("STATE") or "{}")
        self.settled: str | None = state.get("settled")
        self.last: str | None = None
        self.count = state.get("count", 0)

    def _read(self, name: str | None) -> DataFrame:
        spark = self.index.spark
        return spark.createDataFrame([], LISTING) if name is None else spark.read.schema(LISTING).parquet(f"{self.files.path}/{name}")

    def _listed(self) -> str:
        kinds, self.count = self.index.config.extensions, self.count + 1
        tree = scan(self.index.spark, self.index.project.root, self.index.config.ignore, kinds.include, kinds.exclude)
        name = f"listing-{self.count}"
        tree.select("filePath", F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("fileHash")).write.mode("overwrite").parquet(f"{self.files.path}/{name}")
        return name

    def settle(self) -> None:
        """The first time: what is there now counts as built, as a whole build follows."""
        if self.settled is None:
            self.settled = self.last = self._listed()
            self.files.write("STATE", json.dumps({"settled": self.settled, "count": self.count}))

    def poll(self, wait: bool = True) -> bool:
        """Builds what changed if it did and the tree is at rest (or ``wait`` is false). True if it built."""
        held, now = {self.last, self.settled}, self._listed()
        moving = wait and not working_tree(self._read(now), self._read(self.last)).isEmpty()
        changed = working_tree(self._read(now), self._read(self.settled))
        built = not moving and not changed.isEmpty()
        if built:
            self.index.build(BuildOptions(files=changed.select("filePath")))
            self.settled = now
            self.files.write("STATE", json.dumps({"settled": now, "count": self.count}))
        self.last = now
        for name in held - {self.last, self.settled, None}:
            self.files.delete(name)
        return built


def watch(index: object, once: bool = False, folder: str | None = None) -> StreamingQuery:
    """Builds the index again, file by file, as files change, come and go. once: what there is now, then ends.

    A clock of micro-batches drives the polls, so they run one after the other and changes during a build wait for the
    next one. The first build is whole. The lock is held until the index is closed.
    """
    if not index.store.lock():
        raise LockedError("another process writes this index")
    watcher = Watcher(index, folder or f"{index.store.folder.path}/watch")
    watcher.settle()
    index.build()
    if once:
        watcher.poll(wait=False)
    clock = index.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    writer = clock.writeStream.foreachBatch(lambda _, number: None if once else watcher.poll())
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
