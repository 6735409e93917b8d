"""Search over product groups: coverage, filters, roll-up and sort for many queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.config import SearchConfig
from pricemesh.operators.explain import found_explanations
from pricemesh.operators.filters import passes
from pricemesh.operators.offers import rollup
from pricemesh.operators.search import coverage, distinct_texts, listing_relevance
from pricemesh.operators.sorting import rank_within, requested_group_order, requested_listing_key
from pricemesh.plans.catalog import Build
from pricemesh.session import cut_lineage


def search_groups(
    queries: DataFrame, listings: DataFrame, sort: str = "relevance", cfg: SearchConfig = SearchConfig()
) -> DataFrame:
    """One row per (query, product) that survives.

    ``queries`` is the query table; ``listings`` carry ``search_text``,
    ``product_id`` and ``discount_percentage``.  The relevance of a group is
    that of its best covered listing, also when a filter removes that listing.
    """
    hits = coverage(queries.select("query_id", "query"), distinct_texts(listings), cfg)
    found = listing_relevance(hits, listings, cfg)
    joined = found.alias("l").join(queries.alias("q"), F.col("l.query_id") == F.col("q.query_id"))
    shown = joined.filter(passes("q", "l")).select("l.*")
    best = found.groupBy("query_id", "product_id").agg(F.round(F.max("relevance"), 3).alias("relevance"))
    return rollup(shown, ["query_id", "product_id"], sort).join(best, ["query_id", "product_id"])


def result_pages(queries: DataFrame, listings: DataFrame, built: Build, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The groups of every query with their place in the sort that the query asks for, and why they are groups.

    ``listings`` are those of ``built`` (see ``Build.membership``) with
    ``search_text`` and ``discount_percentage``.  Confidence and reasons rest on
    the listings a query found, also those its filters remove; a product of which
    it found one listing has none.  Unknown or missing sorts mean relevance.
    """
    hits = coverage(queries.select("query_id", "query"), distinct_texts(listings), cfg)
    found = cut_lineage(listing_relevance(hits, listings, cfg))   # read for groups, relevance and explanations
    joined = found.alias("l").join(queries.alias("q"), F.col("l.query_id") == F.col("q.query_id"))
    shown = joined.filter(passes("q", "l")).select("l.*", "q.sort")
    sort = F.col("sort")
    of_group = found.groupBy("query_id", "product_id").agg(
        F.round(F.max("relevance"), 3).alias("relevance"),
        F.min(F.when(F.col("merged"), F.col("class_id"))).alias("class_id"),
    )
    why = found_explanations(built.pairs, built.classes, found.select("query_id", "profile_id", "position"))
    groups = (
        rollup(shown, ["query_id", "sort", "product_id"], key=requested_listing_key(sort))
        .join(of_group, ["query_id", "product_id"])
        .join(why, ["query_id", "class_id"], "left")
    )
    return rank_within(groups, ["query_id"], requested_group_order(sort), "place")
