"""Parameters that change results."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction


@dataclass(frozen=True)
class Weights:
    """Shares of the three similarity components; they must sum to 1."""

    words: float = 1 / 3
    locations: float = 1 / 3
    categories: float = 1 / 3

    def __post_init__(self) -> None:
        parts = (self.words, self.locations, self.categories)
        if min(parts) < 0 or abs(sum(parts) - 1) > 1e-9:
            raise ValueError(f"weights must not be negative and must sum to 1, not {sum(parts)}")

    @classmethod
    def parse(cls, text: str) -> Weights:
        """From ``words,locations,categories``, each a fraction (1/3) or a decimal (0.25)."""
        parts = [float(Fraction(p.strip())) for p in text.split(",")]
        if len(parts) != 3:
            raise ValueError("three weights are needed")
        return cls(*parts)


@dataclass(frozen=True)
class Settings:
    """Defaults of all operators (fixed values)."""

    bold_title_within: int = 50
    longest_title: int = 100
    clean_title_within: int = 250
    top_words: int = 20
    top_locations: int = 20
    last_location_word: int = 250
    located_at_words: int = 30
    located_at_chars: int = 150
    located_at_diameter_km: float = 5000.0
    is_a_in_words: int = 50
    is_a_in_chars: int = 300
    rows_per_file: int = 2500
    least_common_words: int = 2
    least_common_locations: int = 1
    least_common_categories: int = 1
    least_similarity: float = 0.1
    most_neighbors: int = 100
    is_a_in_boost: float = 2.0
    located_at_boost: float = 5.0
    least_boost_priority: int = 5


DEFAULTS = Settings()
