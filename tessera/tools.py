"""The tool core for agents: health, search text and the list of other projects."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import fixed_score, location
from .index import Index
from .types import SearchOptions

LOCAL_SECONDS, REMOTE_SECONDS, TOOL_LIMIT = 10, 60, 10
REASONS = ("ok", "not_indexed", "embedding_failed", "search_empty")


def rendered(results: DataFrame) -> DataFrame:
    """One text for each result."""
    head = F.concat(location(F.col("filePath"), F.col("startLine"), F.col("endLine"), F.col("type"), F.col("name")), F.lit(" (score: "), fixed_score(F.col("score")), F.lit(")"))
    return results.select(F.concat_ws("\n", head, F.when(F.col("context") != "", F.col("context")), "content").alias("text"))


def as_json(results: DataFrame) -> list[str]:
    return results.toJSON().collect()  # at most the limit of rows


@dataclass
class ToolCore:
    index: Index
    reason: str = "not_indexed"
    listeners: list[Callable[[str], None]] = field(default_factory=list)
    _stop: threading.Event = field(default_factory=threading.Event)
    _thread: threading.Thread | None = None

    def check(self) -> str:
        status = self.index.status()
        found = "not_indexed" if not status["files"] else "embedding_failed" if not status["embedding_ok"] else "ok" if status["search_ok"] else "search_empty"
        self._set(found)
        return found

    def _set(self, reason: str) -> None:
        if reason != self.reason:
            self.reason = reason
            for listener in self.listeners:
                listener(reason)

    def description(self) -> str:
        return "Searches the code of this project by meaning." + ("" if self.reason == "ok" else f" Not ready: {self.reason}.")

    def start(self) -> None:
        """Polls until the index is found healthy or a search succeeds."""
        if self._thread and self._thread.is_alive():
            return
        self._stop.clear()
        pause = LOCAL_SECONDS if self.index.config.local else REMOTE_SECONDS

        def poll() -> None:
            while not self._stop.is_set() and self.check() != "ok":
                self._stop.wait(pause)

        self._thread = threading.Thread(target=poll, daemon=True)
        self._thread.start()

    def search(self, query: str, limit: int = TOOL_LIMIT, file_prefix: str | None = None, type: list[str] | None = None, language: list[str] | None = None, project: str | None = None) -> tuple[str, bool]:
        """(text, is it an error)."""
        try:
            rows = rendered(self.index.search(query, SearchOptions(limit, file_prefix, type=type or [], language=language or [], project=project))).collect()
        except Exception as e:  # noqa: BLE001  tools report errors as text
            self.start()
            return f"Error: {e}", True
        self._set("ok")
        self._stop.set()  # healthy: no poll until the next error
        return "\n\n---\n\n".join(r[0] for r in rows) or "No results found.", False

    def projects(self) -> str:
        found = [f"- {m['root']}" + (f" ({m['remote']})" if m.get("remote") else "") for m in self.index.other_projects()]
        return "Indexed projects:\n" + "\n".join(found) if found else "No other indexed projects found."

    def dispose(self) -> None:
        """Ends the poll, which may be in the middle of a check, and frees the index."""
        self._stop.set()
        self.listeners.clear()
        if self._thread and self._thread is not threading.current_thread():
            self._thread.join(4 * self.index.STATUS_SECONDS + 30)
        self.index.close()
