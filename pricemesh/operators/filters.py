"""Listing filters: a group survives when any of its listings passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """One request's filters; ``None`` or empty means no limit."""

    marketplaces: tuple[str, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    max_delivery_days: int | None = None
    min_rating: float | None = None
    brands: tuple[str, ...] = ()
    in_stock_only: bool = False

    def condition(self) -> Column:
        """Plain literals, so the comparisons reach the scan."""
        c = F.col
        checks = [F.lit(True)]
        if self.marketplaces:
            checks.append(c("marketplace").isin(*self.marketplaces))
        if self.price_min is not None:
            checks.append(c("price") >= self.price_min)
        if self.price_max is not None:
            checks.append(c("price") <= self.price_max)
        if self.max_delivery_days is not None:
            checks.append(c("delivery_days") <= self.max_delivery_days)
        if self.min_rating is not None:
            checks.append(c("rating") >= self.min_rating)
        if self.brands:
            checks.append(F.lower(F.coalesce(c("brand"), F.lit(""))).isin(*[b.lower() for b in self.brands]))
        if self.in_stock_only:
            checks.append(c("availability") != "out_of_stock")
        out = checks[0]
        for check in checks[1:]:
            out = out & check
        return out


def passes(query: str = "q", listing: str = "l") -> Column:
    """The same filters, read from a query row joined to a listing row."""
    q, l = (lambda k: F.col(f"{query}.{k}")), (lambda k: F.col(f"{listing}.{k}"))
    unlimited = lambda k: q(k).isNull()
    empty = lambda k: F.coalesce(F.size(q(k)), F.lit(0)) <= 0
    brands = F.transform(q("brands"), lambda b: F.lower(b))
    return (
        (empty("marketplaces") | F.array_contains(q("marketplaces"), l("marketplace")))
        & (unlimited("price_min") | (l("price") >= q("price_min")))
        & (unlimited("price_max") | (l("price") <= q("price_max")))
        & (unlimited("max_delivery_days") | (l("delivery_days") <= q("max_delivery_days")))
        & (unlimited("min_rating") | (l("rating") >= q("min_rating")))
        & (empty("brands") | F.array_contains(brands, F.lower(F.coalesce(l("brand"), F.lit("")))))
        & (~F.coalesce(q("in_stock_only"), F.lit(False)) | (l("availability") != "out_of_stock"))
    )
