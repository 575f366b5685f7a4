"""The source tree as a DataFrame."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, short_hash
from ..types import FILES_IN
from .ignore import DEFAULT_IGNORE, Nested, extensions

IGNORE_FILES = (".gitignore", ".tesseraignore")


def special_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(relative path, URI) of ignore files and of files in whose path a part starts with an underscore: Spark's listing leaves both out."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(top)
    if top.toUri().getScheme() == "file":
        base = top.toUri().getPath()
        found = ((os.path.relpath(os.path.join(folder, name), base), os.path.join(folder, name)) for folder, _, names in os.walk(base) for name in names)
    else:
        found = _remote(fs, top)
    return [(path, uri) for path, uri in found if path.rsplit("/", 1)[-1] in IGNORE_FILES or re.search(r"(^|/)_", path)]


def _remote(fs, top) -> Iterator[tuple[str, str]]:  # noqa: ANN001
    files = fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        yield top.toUri().relativize(path.toUri()).getPath(), path.toString()


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """filePath (relative), modificationTime, length and content of every file without a dot part. Content is read only where a plan uses it."""
    base = urlparse(root).path.rstrip("/") or root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    relative = F.substring(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z0-9]+:/*", "/"), len(unquote(base)) + 2, 1 << 30)
    listed = files.select(relative.alias("filePath"), F.to_timestamp_ltz("modificationTime").alias("modificationTime"), "length", "content")
    apart = [(path, uri) for path, uri in special_files(spark, root) if not re.search(r"(^|/)\.", path)]
    if apart:
        listed = listed.unionByName(spark.createDataFrame(apart, "filePath string, uri string").repartition(min(len(apart), 64)).mapInPandas(_opened, FILES_IN))
    return listed.where(~F.col("filePath").rlike(r"(^|/)\."))


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads files one by one where Spark's reader skips their names."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path, uri in zip(batch["filePath"], batch["uri"], strict=True):
            system, inside = fs.FileSystem.from_uri(uri)
            try:
                with system.open_input_stream(inside) as stream:
                    content = stream.read()
                rows.append((path, content, pd.Timestamp(system.get_file_info(inside).mtime), len(content)))
            except OSError:  # gone or unreadable since the listing: left out, as in the listed ones
                continue
        yield pd.DataFrame(rows, columns=["filePath", "content", "modificationTime", "length"]).astype({"modificationTime": "datetime64[ns, UTC]", "length": "int64"})


def ignore_rules(spark: SparkSession, root: str, extra: Iterable[str] = ()) -> Nested:
    """Root and nested rules. Ignore files are few and small; only they come to the driver."""
    from pyarrow import fs

    folders: dict[str, list[str]] = {}
    lines: list[str] = []
    for path, uri in special_files(spark, root):
        folder, _, name = path.rpartition("/")
        if name not in IGNORE_FILES or folder and name != IGNORE_FILES[0]:
            continue
        system, inside = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(inside) as stream:
            own = stream.read().decode("utf-8", "replace").split("\n")
        if folder:
            folders[folder] = own
        else:
            lines += own
    return Nested([*DEFAULT_IGNORE, *extra, *lines], folders)


def not_ignored(files: DataFrame, rules: Nested) -> DataFrame:
    """The files that no rule excludes. Only paths go to Python, contents stay where they were read."""

    @F.pandas_udf("boolean")
    def kept(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not rules(p))

    return files.where(kept("filePath"))


#: Paths or keys that are sent to every task; more of them meet the other side in a shuffle.
FEW = 200_000


def few(keys: DataFrame) -> DataFrame:
    """The keys, with the hint to send them to every task if they are counted to be few."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def listed(spark: SparkSession, files: list[str] | DataFrame | None) -> DataFrame:
    """Paths that a caller names, as (filePath)."""
    return files.select("filePath") if isinstance(files, DataFrame) else spark.createDataFrame([(f,) for f in files or []], "filePath string")


def scan(spark: SparkSession, root: str, extra_ignore: Iterable[str] = (), include: Iterable[str] = (), exclude: Iterable[str] = (), files: list[str] | DataFrame | None = None) -> DataFrame:
    """Code files below a folder: by extension, then by ignore rules; or an explicit list."""
    tree = read_tree(spark, root)
    if files is not None:
        return tree.join(few(listed(spark, files).distinct()), "filePath", "left_semi")
    return not_ignored(tree.where(extension(F.col("filePath")).isin(extensions(include, exclude))), ignore_rules(spark, root, extra_ignore))


def hashed(files: DataFrame) -> DataFrame:
    """filePath and fileHash."""
    return files.select("filePath", short_hash(F.col("content")).alias("fileHash"))


def modified_since(files: DataFrame, now_ms: int, duration_ms: int) -> DataFrame:
    """Files changed within the duration; the filter reaches the file listing."""
    return files.where(F.col("modificationTime") >= F.timestamp_millis(F.lit(now_ms - duration_ms)))
