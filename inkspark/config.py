"""Settings, checked when made, with defaults; from_env reads them from INKSPARK_* variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

STRATEGIES = ("obsidian_aware", "markdown_semantic", "semantic", "markdown", "late_chunking", "simple")
TRANSFORMS = ("none", "hyde", "multi_query", "both")


@dataclass(frozen=True)
class Settings:
    """Chunking, search and loop settings; a value out of its range raises ValueError."""

    vault: str = ""
    strategy: str = "obsidian_aware"
    chunk_size: int = 512
    chunk_overlap: int = 75
    alpha: float = 0.7
    top_k: int = 75
    rerank_n: int = 10
    transform: str = "none"
    variations: int = 3
    temperature: float = 0.1
    vault_weight: float = 1.0
    conversations_weight: float = 0.8
    max_links: int = 3
    max_retries: int = 2
    research_rounds: int = 3
    research_confidence: float = 0.8
    cutoff: float = 0.0
    rerank_limit: int = 200_000_000

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.strategy in STRATEGIES, f"strategy: one of {', '.join(STRATEGIES)}")
        need(self.transform in TRANSFORMS, f"transform: one of {', '.join(TRANSFORMS)}")
        need(self.chunk_size > 0 and 0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap: from 0 to less than chunk_size")
        need(0 <= self.alpha <= 1, "alpha: 0 to 1")
        need(0 <= self.temperature <= 2, "temperature: 0 to 2")
        need(all(0 <= w <= 2 for w in (self.vault_weight, self.conversations_weight)), "weights: 0 to 2")
        need(self.top_k > 0 and self.rerank_n > 0, "top_k and rerank_n: above 0")
        if self.vault:
            need(Path(self.vault).is_dir(), f"vault: no folder {self.vault}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings of INKSPARK_CHUNK_SIZE and so on, each in the type of its default."""
        env = os.environ if env is None else env
        return cls(**{f.name: type(f.default)(env[key]) for f in fields(cls) if (key := f"INKSPARK_{f.name.upper()}") in env})


def check_question(text: str | None) -> str:
    """The question without outer blanks; blank and over-long ones (10,000 characters) raise ValueError."""
    text = (text or "").strip()
    if not text or len(text) > 10_000:
        raise ValueError("a question has 1 to 10,000 characters")
    return text


ROUTES = {"@vault": "vault", "@conv": "conversations", "@all": "all", "@research": "research"}


def route(text: str, sources: tuple[str, ...] = ("vault",)) -> tuple[str, str]:
    """Where a question goes by its first word, and the rest; without one, to all sources if there are several."""
    first, _, rest = text.strip().partition(" ")
    if first.lower() in ROUTES:
        return ROUTES[first.lower()], rest.strip()
    return ("all" if len(sources) > 1 else "vault"), text.strip()
