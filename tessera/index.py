"""The library's front door: ``create_index(spark, cwd)``."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import project
from .config import Config, load
from .exchange import same_family
from .functions.text import below
from .operators import changes, stats
from .operators.chunking import syntax_chunks
from .operators.embedding import Embedder, embedder_for
from .operators.fulltext import TextIndex
from .plans.build import build
from .plans.repair import repair
from .plans.search import Target, chunk_key, search, worded
from .sources import files as source
from .sources.snapshots import LockedError, Store, Writing, indexes
from .types import BuildOptions, BuildResult, RepairResult, SearchOptions


class DimensionError(ValueError):
    pass


def within(seconds: float, what: Callable[[], object]) -> object:
    """The result, or an error if it takes longer; the work itself then ends on its own."""
    out: dict = {}

    def run() -> None:
        try:
            out["value"] = what()
        except Exception as e:  # noqa: BLE001  raised again where it is waited for
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if "error" in out:
        raise out["error"]
    if "value" not in out:
        raise TimeoutError(f"no answer within {seconds:g} s")
    return out["value"]


class Index:
    #: What status waits for an embedding, and for a search, at most.
    STATUS_SECONDS = 3.0

    def __init__(self, spark: SparkSession, cwd: str, config: Config, embedder: Embedder, chunker: Callable[[DataFrame], DataFrame], log: Callable[[str], None]):
        self.spark, self.cwd, self.config, self.embedder, self.chunker, self.log = spark, cwd, config, embedder, chunker, log
        self.project = project.resolve(cwd)
        self.store = Store(spark, project.index_path(cwd))

    def build(self, options: BuildOptions | None = None) -> BuildResult:
        here = self.project
        stored = [r[0] for r in stats.branches(self.store.files(here.branch)).toLocalIterator()] if here.branch != project.DEFAULT_BRANCH else []
        near = [(b, n) for b in stored if b != here.branch and (n := project.commits_between(here.root, here.branch, b)) is not None]
        alive = project.branches(here.root) if here.branch != project.DEFAULT_BRANCH else None
        if options and options.dry:
            return build(self.spark, here.root, self.store, self.embedder, here.branch, self.config, options, self.chunker, alive or None, near)
        with Writing(self.store):
            return build(self.spark, here.root, self.store, self.embedder, here.branch, self.config, options, self.chunker, alive or None, near)

    def targets(self, options: SearchOptions) -> list[Target]:
        """across, else project, else this one with the prefix of the folder searched from."""
        local = Target(self.store.chunks(), self.store.files(self.project.branch).where(F.col("branch") == self.project.branch), options.file_prefix)
        if options.across:
            others = [p for p in options.across if project.index_path(p) != self.store.folder.path]
            return [local, *(Target(Store(self.spark, project.index_path(p)).chunks(), None, options.file_prefix, p) for p in others)]
        if options.project:
            return [Target(Store(self.spark, project.index_path(options.project)).chunks(), None, options.file_prefix, options.project)]
        found = project.indexed_ancestor(self.cwd)
        local.prefix = below(found[1] if found else "", options.file_prefix) or None
        return [local]

    def text_index(self) -> TextIndex:
        """The text index of the stored chunks, with what commits since have brought; what is gone drops out of results."""
        held, commit = TextIndex(self.spark, f"{self.store.folder.path}/text"), self.store.version()
        if held.meta.get("commit") == commit:
            return held
        with contextlib.ExitStack() as writing:
            try:
                writing.enter_context(Writing(self.store))
            except LockedError:
                if held.meta["versions"]:  # what there is will do while another process writes
                    return held
                raise
            rows = self.store.chunks().select(chunk_key().alias("id"), F.concat_ws("\n", "context", "content").alias("text"))
            if held.meta["versions"]:
                rows = rows.join(held.ids(), "id", "left_anti")
            held.add(rows, commit=commit)
        return held

    def search(self, query: str, options: SearchOptions | None = None) -> DataFrame:
        options = options or SearchOptions()
        if options.mode not in ("vector", "text", "hybrid"):
            raise ValueError(f"unknown mode {options.mode!r}: vector, text or hybrid")
        if options.mode != "vector" and (options.across or options.project or options.negative):
            raise ValueError("text and hybrid searches take one project and no negative text")
        if options.mode == "text":
            return worded(self.targets(options)[0], self.text_index(), query, options)
        vector = self.embedder.embed_query(query)
        meta = self.store.metadata()
        if meta.get("dimensions") and len(vector) != meta["dimensions"]:
            raise DimensionError(f"the query has {len(vector)} dimensions, the index {meta['dimensions']}")
        if meta.get("model") and not same_family(self.spark, meta["model"], self.config.model):
            self.log(f"warning: the index was made with {meta['model']}, not {self.config.model}")
        if options.mode == "hybrid":
            return worded(self.targets(options)[0], self.text_index(), query, options, vector)
        negative = self.embedder.embed_query(options.negative) if options.negative else None
        return search(self.targets(options), vector, options, negative)

    def repair(self, dry: bool = False) -> RepairResult:
        if dry:
            return repair(self.spark, self.project.root, self.store, self.project.branch, self.config, dry, self.chunker)
        with Writing(self.store):
            return repair(self.spark, self.project.root, self.store, self.project.branch, self.config, dry, self.chunker)

    def changes(self) -> DataFrame:
        """(filePath, kind) of the tree against this branch."""
        tree = source.scan(self.spark, self.project.root, self.config.ignore, self.config.extensions.include, self.config.extensions.exclude)
        return changes.working_tree(source.hashed(tree), self.store.files(self.project.branch).where(F.col("branch") == self.project.branch))

    def status(self) -> dict:
        out = {"root": self.project.root, "branch": self.project.branch, "model": self.config.model, "locked": self.store.is_locked()}
        out |= stats.index_stats(self.store.chunks(), self.store.files(self.project.branch).where(F.col("branch") == self.project.branch)).first().asDict()
        out |= {"indexedAt": self.store.metadata().get("indexedAt"), "branches": sorted(r[0] for r in stats.branches(self.store.files(self.project.branch)).toLocalIterator())}
        began = time.time()
        try:
            vector = within(self.STATUS_SECONDS, lambda: self.embedder.embed_query("function"))
            out |= {"embedding_ok": True, "embedding_ms": round((time.time() - began) * 1000), "dimensions": len(vector)}
            began = time.time()
            out["search_ok"] = within(self.STATUS_SECONDS, lambda: not search([Target(self.store.chunks())], vector, SearchOptions(limit=1)).isEmpty())
            out["search_ms"] = round((time.time() - began) * 1000)
        except Exception as e:  # noqa: BLE001  status reports what fails
            out |= {"embedding_ok": out.get("embedding_ok", False), "search_ok": False, "error": str(e)}
        return out

    def watch(self, once: bool = False) -> object:
        from .streaming.watch import watch

        return watch(self, once=once)

    def other_projects(self) -> list[dict]:
        return [meta for path, meta in indexes(self.spark, project.state_folder()) if path.rsplit("/", 1)[-1] != self.store.folder.path.rsplit("/", 1)[-1]]

    def close(self) -> None:
        self.store.unlock()


def create_index(spark: SparkSession, cwd: str, config: Config | None = None, embedder: Embedder | None = None, chunker: Callable[[DataFrame], DataFrame] | None = None, log: Callable[[str], None] = print) -> Index:
    config = config or load(cwd)
    embedder = embedder or embedder_for(config.model, dimensions=config.dimensions, base_url=config.base_url, query_prefix=config.query_prefix or "", document_prefix=config.document_prefix or "")
    return Index(spark, cwd, config, embedder, chunker or syntax_chunks, log)
