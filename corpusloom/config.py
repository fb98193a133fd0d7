"""Engine parameters that change results, and retrieval modes."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

MODES = ("PURE_SEMANTIC", "ENTERPRISE", "KEYWORD")


@dataclass(frozen=True)
class EngineConfig:
    chunk_tokens: int = 400
    chunk_overlap: int = 50
    rrf_k: int = 60
    top_k: int = 50
    hybrid_alpha: float = 0.7
    retrieval_top_k: int = 8
    context_tokens: int = 2000
    confidence_threshold: float = 0.42
    citation_floor: float = 0.45
    title_floor: float = 0.55
    category_gap: float = 0.30
    max_citations: int = 3
    filter_high: float = 0.90
    filter_least: float = 0.75
    intent_high: float = 0.90
    intent_least: float = 0.60
    intent_accept: float = 0.58
    intent_margin: float = 0.05
    rerank_pool: int = 20
    rerank_keep: int = 5
    cache_similarity: float = 0.95
    cache_ttl: int = 86_400
    max_intents: int = 2
    mode: str = "ENTERPRISE"

    @classmethod
    def from_env(cls, prefix: str = "CORPUSLOOM_") -> EngineConfig:
        """Defaults, overridden by environment variables named after the fields."""
        found = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return replace(cls(), **found)


def parse_mode(text: str | None) -> str:
    """The mode of a name in any case, with dashes or underscores; the default for an unknown one."""
    name = (text or "").strip().upper().replace("-", "_")
    return name if name in MODES else "ENTERPRISE"


def rules_active(mode: str) -> bool:
    return mode == "ENTERPRISE"


def gate_active(mode: str) -> bool:
    return mode == "ENTERPRISE"
