"""Settings, their defaults and limits, and how they are read from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from corpuscle.errors import ConfigError

MODES = ("vector", "bm25", "hybrid")


@dataclass(frozen=True)
class Config:
    chunk_size: int = 512
    chunk_overlap: int = 128
    max_file_size: int = 10 * 1024 * 1024
    embedding_batch_size: int = 32
    embedding_dims: int = 768
    mode: str = "hybrid"
    top_k: int = 5
    min_score: float = 0.5
    vector_weight: float = 0.5
    bm25_weight: float = 0.5
    adaptive: bool = True
    adaptive_threshold: float = 0.65
    low_vector_weight: float = 0.2
    low_bm25_weight: float = 0.8
    rrf_k: int = 60
    rerank: bool = False
    rerank_top_k: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    max_commits: int = 1000
    data_dir: str = "./data"
    workers: int = os.cpu_count() or 1
    queue_size: int = 4 * (os.cpu_count() or 1)

    def validate(self) -> Config:
        if self.chunk_size <= 0:
            raise ConfigError("chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ConfigError("chunk_overlap must be smaller than chunk_size")
        if self.mode not in MODES:
            raise ConfigError(f"mode must be one of {MODES}")
        if self.mode == "hybrid" and abs(self.vector_weight + self.bm25_weight - 1) > 0.001:
            raise ConfigError("the weights must add up to 1")
        if self.bm25_k1 <= 0 or not 0 <= self.bm25_b <= 1:
            raise ConfigError("bm25_k1 must be positive and bm25_b between 0 and 1")
        if self.workers <= 0 or self.queue_size <= 0:
            raise ConfigError("workers and queue_size must be positive")
        if self.top_k <= 0 or self.rerank_top_k <= 0:
            raise ConfigError("result limits must be positive")
        return self

    def fetch_limits(self) -> tuple[int, int]:
        """``(initial, leg)``: candidates kept after fusion, and those each leg of a hybrid search fetches."""
        initial = self.top_k * (3 if self.rerank else 1)
        return initial, 2 * initial


def _read(kind: type, text: str):
    if kind is bool:
        low = text.strip().lower()
        if low in ("1", "true", "yes", "on"):
            return True
        if low in ("0", "false", "no", "off"):
            return False
        raise ConfigError(f"not a truth value: {text}")
    try:
        return kind(text.strip())
    except ValueError as e:
        raise ConfigError(f"not a {kind.__name__}: {text}") from e


def from_env(env: Mapping[str, str] | None = None, **overrides) -> Config:
    """Settings named like their fields in capitals; overrides come last, and only then all is checked."""
    env = os.environ if env is None else env
    kinds = {"int": int, "float": float, "bool": bool, "str": str}
    got = {f.name: _read(kinds[f.type], env[f.name.upper()]) for f in fields(Config) if env.get(f.name.upper(), "").strip()}
    return replace(Config(), **got, **overrides).validate()
