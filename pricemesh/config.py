"""Tunable numbers, handed to the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    """Weights and thresholds of the pair score."""

    text: float = 0.40
    attribute: float = 0.25
    image: float = 0.35
    exact: float = 0.90
    similar: float = 0.70
    dims: int = 512          # buckets of the hashed embedding
    cell_rows: int = 1024    # most profiles on one side of a comparison tile


@dataclass(frozen=True)
class SearchConfig:
    min_coverage: float = 0.55
    unseen_idf: float = 2.5
    synonym_credit: float = 0.7
    prefix_credit: float = 0.6
    prefix_min_chars: int = 4
    review_bonus: float = 0.05
    review_cap: int = 10000


@dataclass(frozen=True)
class RuleConfig:
    price_ratio: float = 1.6
    vague_price_ratio: float = 1.15
    family_dice: float = 0.75
    near_price: float = 0.05
    max_groups: int | None = None        # page size of rule results; None: every group
    snapshot_hours: int = 6
    second_feed_rows: int | None = None  # rows per query of the second feed; None: all
