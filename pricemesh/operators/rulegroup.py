"""Greedy grouping of feed listings per query, and one offer per store.

The greedy pass depends on order: a row joins the first group all of whose members
it can stand with.  What makes it fit a cluster:

* listings can only join when query, model words, condition and accessory flag
  are equal, and when a chain of prices no further apart than the price ratio
  connects them, so these form the block that a pass runs over;
* listings with the same identity and price always end in the same group as the
  first of them unless they state nothing (storage, RAM, colour, quantity) or
  name neither model nor family, so all others are folded into one row
  beforehand and take its group afterwards;
* a group is known by the kinds of its members and their price range, so a pass
  holds groups, not rows or pairs: blocks stream through their tasks, many small
  ones or one of any length, in memory that grows with a block's groups alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemesh.config import RuleConfig
from pricemesh.functions.identity import (
    group_attributes, is_accessory, query_words, specificity, with_identity,
)
from pricemesh.functions.text import clean_rule_title
from pricemesh.operators import rulematch
from pricemesh.session import cut_lineage

Keep = Callable[[DataFrame], DataFrame]

_FACTS = ["brand", "storage", "ram", "colour", "quantity"]


def _block(identity: Column, accessory: Column) -> Column:
    """Model words, condition and accessory flag as one key; null where the title tells none of them.

    No word holds a blank.
    """
    known = identity["model"].isNotNull() & identity["condition"].isNotNull() & accessory.isNotNull()
    return F.when(known, F.to_json(F.array(F.array_join(identity["model"], " "), identity["condition"], accessory.cast("string"))))


def _facts(identity: Column) -> Column:
    """All else that decides a group, prices aside, as one key."""
    return F.to_json(F.array(*[identity[k] for k in _FACTS], F.array_join(identity["family"], " ")))


def identified(raws: DataFrame, keep: Keep = cut_lineage) -> DataFrame:
    """Feed listings with identity, accessory flag, specificity, and the keys ``block`` and ``facts`` of grouping.

    ``raws`` carry query_id, query, listing_id, title, price, position and
    marketplace.  Of rows with one listing id per query the first is kept, of
    equally placed ones the cheaper, then the one whose title and other columns
    come first.  Equal titles of a query are read by the text rules once.
    ``keep`` writes the listings, which are read twice.
    """
    order = ["position", "price", "title"]
    rest = [c for c in raws.columns if c not in (*order, "query_id", "listing_id")]
    first = raws.groupBy("query_id", "listing_id").agg(F.min(F.struct(*order, *rest)).alias("_row"))
    unique = keep(first.select("query_id", "listing_id", "_row.*").select(*raws.columns))
    titles = unique.select(F.col("query").alias("_query"), F.col("title").alias("_said")).distinct()
    read = (
        with_identity(titles, "_said")
        .withColumn("accessory", is_accessory(F.col("identity"), query_words(F.col("_query"))))
        .withColumn("specificity", specificity(F.col("identity")))
        .withColumn("block", _block(F.col("identity"), F.col("accessory")))
        .withColumn("facts", _facts(F.col("identity")))
    )
    same = F.col("title").eqNullSafe(F.col("_said")) & F.col("query").eqNullSafe(F.col("_query"))
    return unique.join(read, same).drop("_query", "_said")


def _banded(leads: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Number the price chains of each block: a gap above the ratio starts a new one."""
    ordered = Window.partitionBy("query_id", "block").orderBy("price")
    gap = F.col("price") / F.greatest(F.lit(1.0), F.lag("price").over(ordered)) > cfg.price_ratio
    # Rows of one price are peers, so all of them count the gap that the first has.
    return leads.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "band", F.sum("_gap").over(ordered)
    ).drop("_gap")


_FEW = 24   # groups that a plain loop goes through faster than array operations do


class GroupState:
    """The open groups of one block, each by what its members state and the range of their prices.

    A row stands with all members of a group if its facts and words agree with every
    kind of member and its price with the cheapest and the dearest of them, so
    members need not be kept: a block of any length streams through.
    """

    def __init__(self, cfg: RuleConfig, model: bool | None = None):
        self.cfg = cfg
        self.model = model                  # whether the block names a model; else told by its rows
        self.kinds: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.known: dict[str, int] = {}     # kinds by the text of their facts
        self.agree: dict[tuple[int, int], bool] = {}
        self.held: list[set[int]] = []      # kinds in each group
        self.openers: list[str] = []
        # Cheapest and dearest of a group's rows that state storage, colour or quantity, and of its other rows;
        # kinds x groups: whether the kind agrees with all kinds of the group.  Lists while there are few groups.
        self.prices: list | np.ndarray = []
        self.open: list | np.ndarray = []

    def _agrees(self, i: int, j: int) -> bool:
        """Whether rows of two kinds may share a group, prices aside."""
        key = (i, j) if i < j else (j, i)
        found = self.agree.get(key)
        if found is None:
            (x, a), (y, b) = self.kinds[i], self.kinds[j]
            common = len(a & b)
            if self.model:
                found = common > 0 or not a or not b
            else:
                found = common > 0 and 2 * common / (len(a) + len(b)) >= self.cfg.family_dice
            found = self.agree[key] = found and not any(v and w and v != w for v, w in zip(x, y))
        return found

    def _kind(self, row: dict) -> int:
        kind = (tuple(row[f] or None for f in _FACTS), frozenset(row["family"]))
        k = self.number.get(kind)
        if k is None:
            k = self.number[kind] = len(self.kinds)
            self.kinds.append(kind)
            fits = [all(self._agrees(k, q) for q in held) for held in self.held]
            if isinstance(self.open, list):
                self.open.append(fits)
            else:
                if k == len(self.open):
                    self.open = np.concatenate([self.open, np.empty_like(self.open)])
                self.open[k, : len(fits)] = fits
        return k

    def _opened(self, k: int, listing: str) -> int:
        at = len(self.held)
        fresh = (np.inf, -np.inf, np.inf, -np.inf)
        fits = [self._agrees(q, k) for q in range(len(self.kinds))]
        self.held.append({k})
        self.openers.append(listing)
        if at < _FEW:
            self.prices.append([*fresh])
            for row, fit in zip(self.open, fits):
                row.append(fit)
            return at
        if at == _FEW:
            prices, opened = self.prices, self.open
            self.prices, self.open = np.empty((2 * _FEW, 4)), np.empty((max(4, len(fits)), 2 * _FEW), dtype=bool)
            self.prices[:at], self.open[: len(fits), :at] = prices, opened
        elif at == len(self.prices):
            self.prices = np.concatenate([self.prices, np.empty_like(self.prices)])
            self.open = np.concatenate([self.open, np.empty_like(self.open)], axis=1)
        self.prices[at] = fresh
        self.open[: len(fits), at] = fits
        return at

    def _fitting(self, k: int, price: float, floor: float, limit: float) -> list[int] | np.ndarray:
        """Groups that the row can stand with, the oldest first; ``limit``: most times the price of rows that state nothing."""
        ratio, n = self.cfg.price_ratio, len(self.held)
        if n <= _FEW:
            return [
                g for g, (fit, (low, high, vague_low, vague_high)) in enumerate(zip(self.open[k], self.prices))
                if fit and price / max(1.0, low) <= ratio and high / floor <= ratio
                and price / max(1.0, vague_low) <= limit and vague_high / floor <= limit
            ]
        now = self.prices[:n]
        fits = (
            self.open[k, :n] & (price / np.maximum(1.0, now[:, 0]) <= ratio) & (now[:, 1] / floor <= ratio)
            & (price / np.maximum(1.0, now[:, 2]) <= limit) & (now[:, 3] / floor <= limit)
        )
        return np.flatnonzero(fits)

    def place(self, row: dict) -> str:
        """The listing that opened the group of this row, the next in placing order."""
        if self.model is None:
            self.model = bool(row["model"])
        return self._placed(self._kind(row), row["price"], row["specificity"], row["listing_id"])

    def place_known(self, facts: str, said: dict, price: float, specific: int, listing: str) -> str:
        """``place`` for a row by the text of its facts, which ``said`` holds read."""
        k = self.known.get(facts)
        if k is None:
            k = self.known[facts] = self._kind(said)
        return self._placed(k, price, specific, listing)

    def _placed(self, k: int, price: float, specific: int, listing: str) -> str:
        cfg = self.cfg
        # Brand, storage, RAM, colour and quantity, in this order.
        _, storage, _, colour, quantity = self.kinds[k][0]
        speaks = bool(storage or colour or quantity)
        floor = max(1.0, price)
        choice = self._fitting(k, price, floor, cfg.price_ratio if speaks else cfg.vague_price_ratio)
        if len(choice) > 1 and not specific:
            # A vague row only decides between groups by its price, and only if that leaves one.
            if isinstance(choice, list):
                close = [g for g in choice if abs(price - min(self.prices[g][0], self.prices[g][2])) / floor <= cfg.near_price]
            else:
                lowest = np.minimum(self.prices[choice, 0], self.prices[choice, 2])
                close = choice[np.abs(price - lowest) / floor <= cfg.near_price]
            choice = close if len(close) == 1 else []
        at = int(choice[0]) if len(choice) else self._opened(k, listing)
        if k not in self.held[at]:
            self.held[at].add(k)
            if isinstance(self.open, list):
                for q, row in enumerate(self.open):
                    row[at] = row[at] and self._agrees(q, k)
            else:
                self.open[: len(self.kinds), at] &= [self._agrees(q, k) for q in range(len(self.kinds))]
        low, own = 0 if speaks else 2, self.prices[at]
        own[low] = min(own[low], price)
        own[low + 1] = max(own[low + 1], price)
        return self.openers[at]


_LED = ["query_id", "block", "facts", "price", "own"]


def _placed_blocks(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """All blocks of a partition one after another: rows come sorted by block and placing order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, state = None, None, None
        read: dict[str, dict] = {}
        for batch in batches:
            out = []
            column = lambda k: batch.column(k).to_pylist()
            for query, block, band, facts, price, specific, listing in zip(
                *map(column, ("query_id", "block", "band", "facts", "price", "specificity", "listing_id"))
            ):
                said = read.get(facts)
                if said is None:
                    if len(read) > 100_000:
                        read.clear()
                    *values, family = json.loads(facts)
                    said = read[facts] = dict(zip(_FACTS, values), family=family.split() if family else [])
                now = (query, block, band)
                if now != before:
                    # A row alone in its block is its own group, so groups are kept from the second on.
                    before, first, state = now, (facts, said, price, specific, listing), None
                    out.append(listing)
                    continue
                if state is None:
                    state = GroupState(cfg, bool(json.loads(block)[0]))
                    state.place_known(*first)
                out.append(state.place_known(facts, said, price, specific, listing))
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in _LED], pa.array(out, pa.string())], [*_LED, "group_id"])

    # The window deals the rows by block and nothing between deals them anew.
    order = ["query_id", "block", "band", F.desc("specificity"), "position", "listing_id"]
    return rows.sortWithinPartitions(*order).mapInArrow(
        run, "query_id string, block string, facts string, price double, own string, group_id string"
    )


def assign_groups(rows: DataFrame, cfg: RuleConfig = RuleConfig(), keep: Keep = cut_lineage) -> DataFrame:
    """Add ``group_id`` (the listing that opened the group) to identified rows.

    ``keep`` writes what is read more than once.
    """
    c = F.col
    place = F.struct(c("position").cast("double").alias("position"), "listing_id")
    # A listing without any stated fact stays a row of its own, and so does one that names neither
    # a model nor a family word: it matches nothing, not even its equals.
    named = ~F.get_json_object("block", "$[0]").eqNullSafe("") | (F.coalesce(F.get_json_object("facts", "$[5]"), F.lit("")) != "")
    own = F.when((c("specificity") > 0) & named, "").otherwise(c("listing_id"))
    # Tested on the written rows: a plan would test them below the text rules, which it writes out there once more.
    rows = keep(rows).filter("query_id is not null and listing_id is not null and block is not null and price is not null").withColumn("own", own)
    leads = rows.groupBy(*_LED, "specificity").agg(F.min(place).alias("lead")).select(*_LED, "specificity", "lead.*")
    led = _placed_blocks(_banded(leads, cfg), cfg)
    return keep(rows.join(led, _LED).drop("block", "facts", "own"))


def one_offer_per_store(grouped: DataFrame) -> DataFrame:
    """Cheapest offer of each store in each group; the earlier one on equal prices."""
    order = F.struct(F.col("price").alias("p"), (-F.col("specificity")).alias("s"), F.col("position").alias("o"), F.col("listing_id").alias("i"))
    best = grouped.groupBy("query_id", "group_id", "marketplace").agg(F.min(order).alias("best"))
    kept = best.select("query_id", F.col("best.i").alias("listing_id"))
    return grouped.join(kept, ["query_id", "listing_id"], "left_semi")


def rule_groups(offers: DataFrame) -> DataFrame:
    """One row per group of ``one_offer_per_store``: title and attributes of its lead listing.

    ``rank`` is the place of the group's first offer in the united feeds, the
    second feed after the whole first one.
    """
    second = F.col("direct") if "direct" in offers.columns else F.lit(False)
    offers = offers.withColumn("_rank", F.struct(second.alias("feed"), F.col("position").alias("position"), F.col("listing_id").alias("listing_id")))
    # The lead is the listing placed first in the feed; equal places go to the cheaper offer.
    place = F.struct("position", "price", "listing_id")
    lead = F.struct("listing_id", "title", "image_url", "identity", "position")
    return (
        offers.groupBy("query_id", "query", "group_id")
        .agg(
            F.min_by(lead, place).alias("lead"),
            F.min("_rank").alias("rank"),
            F.min("price").alias("price_min"),
            F.max("price").alias("price_max"),
            F.count("*").alias("listing_count"),
            # One offer per store, so this is as long as the store list at most.
            F.array_sort(F.collect_list("marketplace")).alias("marketplaces"),
            F.min(F.when(F.col("delivery_days") < 90, F.col("delivery_days"))).alias("fastest_days"),
        )
        .select(
            "query_id", "query", "group_id",
            clean_rule_title(F.col("lead.title")).alias("canonical_title"),
            group_attributes(F.col("lead.identity")).alias("attributes"),
            F.col("lead.image_url").alias("canonical_image"),
            "rank", "price_min", "price_max", "listing_count", "marketplaces", "fastest_days",
        )
    )


def group_pairs(offers: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Compared pairs inside each group: a group holds one offer per store, so few."""
    side = lambda s: offers.select(
        "query_id", "group_id",
        *[F.col(k).alias(f"{k}_{s}") for k in ("listing_id", "identity", "accessory", "price", "specificity", "position")],
    )
    order = lambda s: F.struct(
        (-F.col(f"specificity_{s}")).alias("x"), F.col(f"position_{s}").alias("y"), F.col(f"listing_id_{s}").alias("z")
    )
    pairs = side("a").join(side("b"), ["query_id", "group_id"]).filter(order("a") < order("b"))
    return rulematch.compare(pairs, cfg).select(
        "query_id", "group_id", "listing_id_a", "listing_id_b", "text_score", "image_score",
        "attribute_score", "combined_score", "match_type", "reasons",
    )
