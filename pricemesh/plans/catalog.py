"""Batch build: from listings to scored pairs, product groups and explanations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pricemesh.config import MatchConfig
from pricemesh.operators import candidates, explain, products, profiles, scoring
from pricemesh.session import cut_lineage


@dataclass
class Build:
    """The tables of one batch build; every further question reads these."""

    members: DataFrame
    profiles: DataFrame
    pairs: DataFrame
    classes: DataFrame

    def products(self) -> DataFrame:
        return products.canonical_products(self.members, self.profiles, self.pairs, self.classes)

    def membership(self) -> DataFrame:
        return products.membership(self.members, self.profiles, self.classes)

    def explanations(self) -> DataFrame:
        positions = self.membership().select("profile_id", "position")
        return explain.explanations(self.pairs, self.classes, positions)

    def similar(self) -> DataFrame:
        return explain.similar_products(self.pairs, self.classes)


def match_pairs(
    listings: DataFrame, cfg: MatchConfig = MatchConfig(), keep_members: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, weighted profiles, kept pairs).  Profiles are written once and read many times.

    ``keep_members``: members are written too, for plans that read them again.
    """
    member_rows = profiles.members(listings)
    if keep_members:
        member_rows = cut_lineage(member_rows)
    rows = cut_lineage(profiles.profiles(member_rows))
    weighted = cut_lineage(profiles.weighted(rows, cfg))
    pairs = scoring.score_profiles(candidates.candidate_pairs(weighted, cfg), weighted, cfg)
    return member_rows, weighted, pairs


def build(listings: DataFrame, cfg: MatchConfig = MatchConfig()) -> Build:
    member_rows, weighted, pairs = match_pairs(listings, cfg, keep_members=True)
    pairs = cut_lineage(pairs)
    return Build(member_rows, weighted, pairs, products.classes(weighted, pairs))
