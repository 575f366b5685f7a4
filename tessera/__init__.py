"""Tessera: semantic search over source trees and document corpora, as Spark plans."""

from .index import create_index

__all__ = ["create_index"]
