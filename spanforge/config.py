"""Engine settings, passed explicitly; ``from_env`` reads overrides with the prefix ``SPANFORGE_``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    embedding_dim: int = 64
    bm25_k: float = 1.2
    bm25_b: float = 0.75
    bm25_avg_len: float = 256.0
    candidates: int = 50
    top_k: int = 10
    rerank_floor: float = 4.0
    min_results: int = 3
    rerank_input: str = "manifest"
    # whitespace-word limits; BPE_LIMITS holds those for a BPE counter
    parent_max: int = 1200
    parent_min: int = 200
    child_max: int = 250
    child_min: int = 50
    embed_max_chars: int = 8000
    rrf_k: int = 60
    # a byte-level BPE that counts tokens; without it white-space words are counted
    token_ranks: str = ""
    token_pattern: str = ""

    def __post_init__(self):
        if self.rerank_input not in ("manifest", "heading", "child"):
            raise ValueError(f"rerank_input: {self.rerank_input}")

    @classmethod
    def from_env(cls, environ=os.environ) -> EngineConfig:
        found = {}
        for f in fields(cls):
            value = environ.get("SPANFORGE_" + f.name.upper())
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)

    def with_bpe_limits(self) -> EngineConfig:
        return replace(self, **BPE_LIMITS)


BPE_LIMITS = {"parent_max": 1900, "parent_min": 300, "child_max": 250, "child_min": 75}
