"""Configuration from YAML: the first file found counts, files are not merged."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml

from .types import Extensions

TEMPLATE = "model: hash:64\n# batchSize: 100\n# maxTokens: 8192\n# ignore: []\n# extensions: {include: [], exclude: []}\n"


@dataclass
class Config:
    model: str
    provider: str | None = None
    base_url: str | None = None
    local: bool | None = None
    batch_size: int = 100
    dimensions: int | None = None
    query_prefix: str | None = None
    document_prefix: str | None = None
    max_tokens: int | None = None
    ignore: list[str] = field(default_factory=list)
    extensions: Extensions = field(default_factory=Extensions)

    def __post_init__(self) -> None:
        if not re.match(r"^.+:.+$", self.model):
            raise ValueError(f"model must be provider:name, not {self.model!r}")
        for name in ("batch_size", "dimensions", "max_tokens"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, int) or value <= 0):
                raise ValueError(f"{name} must be a positive integer")
        if self.base_url and not re.match(r"^[a-z][a-z0-9+.-]*://", self.base_url):
            raise ValueError("base_url must be a URL")


_NAMES = {"baseURL": "base_url", "batchSize": "batch_size", "queryPrefix": "query_prefix", "documentPrefix": "document_prefix", "maxTokens": "max_tokens"}


def parse(text: str) -> Config:
    raw = yaml.safe_load(text) or {}
    known = {_NAMES.get(k, k): v for k, v in raw.items()}
    if "model" not in known:
        raise ValueError("model is missing")
    if known.get("extensions") is not None:
        known["extensions"] = Extensions(**{k: list(v or []) for k, v in known["extensions"].items()})
    names = set(Config.__dataclass_fields__)
    return Config(**{k: v for k, v in known.items() if k in names and v is not None})


def places(cwd: str) -> list[Path]:
    home = Path.home()
    shared = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / "tessera"
    return [Path(cwd) / ".tessera.yml", Path(cwd) / ".tessera.yaml", shared / "config.yml", shared / "config.yaml", home / ".tessera.yml"]


def load(cwd: str, **overrides: object) -> Config:
    for path in places(cwd):
        if path.exists():
            return replace(parse(path.read_text()), **overrides)
    if "model" in overrides:
        return Config(**overrides)
    raise FileNotFoundError("no configuration; looked for " + ", ".join(map(str, places(cwd))))
