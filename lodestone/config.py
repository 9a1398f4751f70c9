"""Settings from the environment, with defaults for what is missing or no number."""

from __future__ import annotations

import os
from dataclasses import dataclass


def as_int(value: str | None, default: int) -> int:
    try:
        return int((value or "").strip())
    except ValueError:
        return default


def as_float(value: str | None, default: float) -> float:
    try:
        return float((value or "").strip())
    except ValueError:
        return default


def as_bool(value: str | None, default: bool) -> bool:
    told = (value or "").strip().lower()
    return told in ("1", "true", "yes", "on") if told else default


@dataclass(frozen=True)
class SearchConfig:
    """Defaults of searches and chunks. ``min_score`` leaves lower hits out where it is set."""

    backend: str = "qdrant"
    top_k: int = 3
    hops: int = 2
    expand_limit: int = 50
    graph_weight: float = 0.5
    vector_weight: float = 0.5
    max_chunk: int = 500
    overlap_ratio: float = 0.15
    min_score: float | None = None

    @classmethod
    def from_env(cls, env=os.environ) -> SearchConfig:
        backend = env.get("VECTOR_BACKEND", "qdrant").strip().lower()
        score = env.get("MIN_SCORE_THRESHOLD")
        return cls(
            backend if backend in ("qdrant", "neo4j", "dual") else "qdrant", as_int(env.get("TOP_K"), 3), as_int(env.get("MAX_HOPS"), 2), as_int(env.get("GRAPH_MAX_NODES"), 50),
            as_float(env.get("GRAPH_WEIGHT"), 0.5), as_float(env.get("VECTOR_WEIGHT"), 0.5), as_int(env.get("MAX_CHUNK_SIZE"), 500), as_float(env.get("OVERLAP_RATIO"), 0.15), None if score is None else as_float(score, 0.0),
        )


def checked_request(query: str | bytes, top_k: int | None = None, hops: int | None = None) -> tuple[str, int, int]:
    """A search request with defaults put in: a query of 1 to 2,000 characters, 1 to 50
    results, 0 to 10 hops; 0 and None are the default."""
    text = (query.decode("utf-8") if isinstance(query, bytes) else query).strip()
    if not 1 <= len(text) <= 2000:
        raise ValueError("query must have 1 to 2000 characters")
    if top_k is not None and not 0 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    if hops is not None and not 0 <= hops <= 10:
        raise ValueError("max_hops must be between 0 and 10")
    return text, top_k or 3, hops or 2
