"""The defaults that decide results, in one place, validated."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    min_length: int = 10
    max_length: int | None = 2000
    min_words: int = 3
    max_special_ratio: float = 0.1
    max_repetition: float = 0.5
    repetition_min_words: int = 15
    duplicate_threshold: float = 0.92
    jaccard: float = 0.5
    permutations: int = 128
    shingle: int = 4
    top_k: int = 10

    def __post_init__(self):
        if self.min_length < 0 or (self.max_length is not None and self.max_length < 0):
            raise ValueError("lengths can't be negative")
        if not 0 <= self.duplicate_threshold <= 1 or not 0 < self.jaccard <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if self.top_k < 1 or self.shingle < 1 or self.permutations < 1:
            raise ValueError("top_k, shingle and permutations are 1 at least")


DEFAULTS = Settings()
