"""What a request may ask for: numbers and texts within their ranges, checked before a job starts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from tessera.operators.chunk import ChunkConfig
from tessera.operators.retrieve import SearchConfig, check_query

#: Least and most of each number, or of a text's or list's length.
RANGES = {
    "chunk_size": (100, 2000), "chunk_overlap": (0, 500), "sync_interval": (1, 1440), "query": (1, 2000), "max_sources": (1, 20), "confidence_threshold": (0, 1),
    "queries": (1, 10), "page": (1, None), "page_size": (1, 100), "history": (1, 50), "key_name": (1, 100), "description": (0, 500),
}


def within(name: str, value):
    """``value``, if it (or its length) lies in the range of ``name``; otherwise an error that tells the range."""
    least, most = RANGES[name]
    size = len(value) if isinstance(value, (str, list, tuple)) else value
    if isinstance(size, bool) or not isinstance(size, (int, float)) or size < least or (most is not None and size > most):
        raise ValueError(f"{name} must lie in {least}..{'' if most is None else most}")
    return value


@dataclass(frozen=True)
class SyncRequest:
    """A tenant's own settings for its syncs, narrower than what ``ChunkConfig`` can do."""

    chunk_size: int = 512
    chunk_overlap: int = 50
    sync_interval: int = 60
    model: str = "all-MiniLM-L6-v2"
    strategy: str = "fixed"
    force: bool = False

    def __post_init__(self):
        for name in ("chunk_size", "chunk_overlap", "sync_interval"):
            within(name, getattr(self, name))
        self.config()

    def config(self) -> ChunkConfig:
        return ChunkConfig(self.model, self.strategy, self.chunk_size, self.chunk_overlap)


@dataclass(frozen=True)
class BatchRequest:
    """One to ten questions with common settings."""

    queries: Sequence[str]
    max_sources: int = 5
    confidence_threshold: float = 0.5

    def __post_init__(self):
        within("queries", list(self.queries))
        within("max_sources", self.max_sources)
        within("confidence_threshold", self.confidence_threshold)
        for q in self.queries:
            check_query(q)

    def config(self) -> SearchConfig:
        return SearchConfig(k=self.max_sources, threshold=self.confidence_threshold)
