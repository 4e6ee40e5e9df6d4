"""Settings of the engine with their defaults and the rules between them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    """A setting is missing, unreadable or against another."""


@dataclass(frozen=True)
class Settings:
    """Each field is read from RAGLOOM_<NAME> by ``from_env``."""

    max_entry_count: int = 10_000
    max_uncompressed_bytes: int = 524_288_000
    include_glob: str = "**/*.md"
    default_language: str = "en"
    max_chunk_size: int = 500
    min_chunk_size: int = 100
    length_strategy: str = "approx-token"
    overlap_strategy: str = "heading-context"
    overlap_sentences: int = 1
    include_parent_chunks: bool = True
    embedding_provider: str = "fake"
    embedding_model: str = "fake-model"
    embedding_model_version: str = "1"
    embedding_dimensions: int = 1024
    embedding_batch_size: int = 100
    embedding_retry_base_ms: int = 500
    embedding_retry_max_ms: int = 30_000
    embedding_max_attempts: int = 5
    embedding_batch_tokens: int = 64_000
    embedding_timeout_s: float = 60.0
    input_max_tokens: int = 8000
    include_heading_context: bool = True
    chunk_types: str = "child"
    failure_threshold: float = 0.5
    run_cap: int = 0
    domain: str = "docs"
    index_batch_size: int = 200
    store_retry_base_ms: int = 200
    store_retry_max_ms: int = 10_000
    allow_fake_provider: bool = False
    default_top_k: int = 10
    max_top_k: int = 100
    score_threshold: float = 0.0
    expand_parents: bool = True
    max_context_chunks: int = 5
    min_retrieval_score: float = 0.0
    max_context_chars: int = 12_000
    max_prompt_tokens: int = 8000
    input_price_per_million: float = 0.75
    output_price_per_million: float = 3.75

    def __post_init__(self) -> None:
        rules = [
            (self.min_chunk_size < self.max_chunk_size, "min_chunk_size must be under max_chunk_size"),
            (self.embedding_retry_base_ms < self.embedding_retry_max_ms, "embedding_retry_base_ms must be under embedding_retry_max_ms"),
            (self.store_retry_base_ms < self.store_retry_max_ms, "store_retry_base_ms must be under store_retry_max_ms"),
            (self.default_top_k <= self.max_top_k, "default_top_k must not exceed max_top_k"),
            (0 <= self.failure_threshold <= 1, "failure_threshold must be within 0 and 1"),
            (1 <= self.embedding_batch_size <= 100, "embedding_batch_size must be within 1 and 100"),
            (self.length_strategy in ("char", "word", "approx-token"), "unknown length_strategy"),
            (self.overlap_strategy in ("none", "heading-context", "sentence-overlap"), "unknown overlap_strategy"),
        ]
        broken = [text for holds, text in rules if not holds]
        if broken:
            raise ConfigError("; ".join(broken))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        given = {}
        for f in fields(cls):
            raw = env.get(f"RAGLOOM_{f.name.upper()}")
            if raw is None:
                continue
            kind = type(f.default)
            try:
                given[f.name] = {"true": True, "false": False}[raw.lower()] if kind is bool else kind(raw)
            except (KeyError, ValueError):
                raise ConfigError(f"RAGLOOM_{f.name.upper()}: {raw!r} is no {kind.__name__}") from None
        return cls(**given)
