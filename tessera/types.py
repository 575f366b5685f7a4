"""Declared schemas and the option records of the API."""

from __future__ import annotations

from dataclasses import dataclass, field

FILES_IN = "filePath string, content binary, modificationTime timestamp, length bigint"
CHUNK_COLUMNS = "id string, filePath string, startLine int, endLine int, type string, name string, content string, context string, hash string"
CHUNKS = CHUNK_COLUMNS + ", fileHash string, vector array<float>"
MANIFEST = "filePath string, fileHash string, branch string"
#: Columns of a search result; ``score`` follows.
RESULT_COLUMNS = ["filePath", "startLine", "endLine", "type", "name", "content", "context"]


@dataclass
class Extensions:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


@dataclass
class SearchOptions:
    limit: int = 25
    file_prefix: str | None = None
    negative: str | None = None  # a text to steer away from
    min_score: float | None = None
    type: list[str] = field(default_factory=list)
    language: list[str] = field(default_factory=list)
    project: str | None = None
    across: list[str] = field(default_factory=list)
    metric: str = "l2"
    compat: bool = False  # language and min_score after the limit, prefixes as LIKE patterns
    mode: str = "vector"  # or text (BM25), or hybrid (both, fused by rank); these two search this project only


@dataclass
class BuildOptions:
    reset: bool = False
    since: str | None = None
    force: bool = False
    dry: bool = False
    files: object = None  # paths, as a list or a DataFrame with the column filePath
    on_progress: object = None


@dataclass
class BuildResult:
    succeeded: int = 0
    failed: int = 0
    already_indexed: int = 0
    oversize: int = 0
    deleted: int = 0
    planned: list[str] = field(default_factory=list)


@dataclass
class RepairResult:
    orphaned: list[str]
    stale: list[str]
    chunk_mismatch: list[str]
    chunks_removed: int
