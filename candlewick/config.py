"""Settings, with defaults from environment variables that are read when Settings are made."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

PREFIX = "CANDLEWICK_"


def _from_env(name: str, default, kind: Callable):
    """A dataclass field; a value that is missing, empty or of the wrong kind leaves the default."""

    def read():
        value = os.environ.get(PREFIX + name)
        try:
            return default if value in (None, "") and kind is not str else default if value is None else kind(value)
        except ValueError:
            return default

    return field(default_factory=read)


@dataclass(frozen=True)
class Settings:
    embedding_model_name: str = _from_env("EMBEDDING_MODEL", "paraphrase-multilingual-MiniLM-L12-v2", str)
    min_chunk_chars: int = _from_env("MIN_CHUNK_CHARS", 200, int)
    max_chunk_chars: int = _from_env("MAX_CHUNK_CHARS", 1200, int)
    #: The higher, the fewer topic cuts: neighbours less alike than the (100 - this)th percentile may part.
    breakpoint_percentile: float = _from_env("BREAKPOINT_PERCENTILE", 75.0, float)
    default_top_k: int = _from_env("TOP_K", 5, int)
    highlight_sentences: int = _from_env("HIGHLIGHT_SENTENCES", 2, int)

    def validate(self) -> None:
        rules = (
            (self.min_chunk_chars >= 1, "min_chunk_chars is below 1"),
            (self.max_chunk_chars > self.min_chunk_chars, "max_chunk_chars doesn't exceed min_chunk_chars"),
            (0 <= self.breakpoint_percentile <= 100, "breakpoint_percentile isn't from 0 to 100"),
            (self.default_top_k >= 1, "default_top_k is below 1"),
            (self.highlight_sentences >= 1, "highlight_sentences is below 1"),
        )
        for holds, fault in rules:
            if not holds:
                raise ValueError(fault)
