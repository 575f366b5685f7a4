"""Ignore rules in the gitignore grammar, compiled to regular expressions on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

# What a scan leaves out or takes in unless it is configured otherwise.
DEFAULT_IGNORE = [
    "node_modules",
    ".git",
    "dist",
    "build",
    ".next",
    "__pycache__",
    ".venv",
    "vendor",
    "target",
    ".tessera",
    "*.min.js",
    "*.min.css",
    "*.map",
    "*.lock",
    "pnpm-lock.yaml",
    "package-lock.json",
    "yarn.lock",
    "*.png",
    "*.jpg",
    "*.jpeg",
    "*.gif",
    "*.ico",
    "*.woff",
    "*.woff2",
    "*.ttf",
    "*.eot",
    "*.svg",
    "*.zip",
    "*.tar",
    "*.gz",
    "*.bin",
    "*.exe",
    "*.dll",
    "*.so",
    "*.dylib",
    "*.wasm",
]
CODE_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".py", ".rs", ".go", ".rb", ".c", ".h", ".cpp", ".hpp", ".cc", ".swift", ".json", ".yaml", ".yml", ".toml", ".lua", ".scala", ".zig", ".md", ".markdown", ".mdx", ".sh", ".bash", ".sql", ".graphql", ".gql", ".proto", ".html", ".css", ".scss", ".vue", ".svelte", ".nix", ".tf", ".hcl", ".kt", ".java", ".php", ".cs", ".rst", ".adoc"]


def extensions(include: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[str]:
    return sorted({*CODE_EXTENSIONS, *include} - {*exclude})


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negative: bool
    folder_only: bool


def _glob(pattern: str) -> str:
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
            continue
        if pattern[k:] == "**" and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + ".+", k + 2
            continue
        if c == "*":
            out += "[^/]*"
            while pattern[k + 1 : k + 2] == "*":
                k += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inside = pattern[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def parse(line: str) -> Rule | None:
    """One line of an ignore file; None for blanks and comments."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negative = line.startswith("!")
    line = line[1:] if negative else line[1:] if line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    body = _glob(line.lstrip("/"))
    return Rule(re.compile("^" + ("" if anchored else "(?:.*/)?") + body + "$"), negative, folder)


class Matcher:
    """The last matching rule decides; what lies in an ignored folder stays ignored."""

    def __init__(self, lines: Iterable[str]):
        self.rules = [r for r in map(parse, lines) if r]

    def _decided(self, path: str, folder: bool) -> bool:
        for rule in reversed(self.rules):
            if (folder or not rule.folder_only) and rule.pattern.match(path):
                return not rule.negative
        return False

    def __call__(self, path: str) -> bool:
        parts = path.split("/")
        return any(self._decided("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._decided(path, False)


class Nested:
    """Root rules, and those of ignore files in folders, which hold for what lies below them, relative to the folder."""

    def __init__(self, root: Iterable[str], folders: dict[str, list[str]] | None = None):
        self.root = Matcher(root)
        self.folders = {d.rstrip("/"): Matcher(lines) for d, lines in (folders or {}).items() if d not in ("", ".")}

    def __call__(self, path: str) -> bool:
        if self.root(path):
            return True
        parts = path.split("/")
        return any((rules := self.folders.get("/".join(parts[:k]))) is not None and rules("/".join(parts[k:])) for k in range(1, len(parts)))
