"""Limits on query texts (always on) and on data (on request)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    query_bytes: int = 64 * 1024
    tokens: int = 100_000
    nodes: int = 50_000
    string_length: int = 8192
    depth: int = 128
    recursion_levels: int = 1000
    #: None: no limit. Spark spills, so data need no cap to be safe.
    file_bytes: int | None = None
    rows: int | None = None
    timeout_ms: int | None = None
