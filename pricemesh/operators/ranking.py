"""Relevance, flags and final order of rule-matched groups per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.config import RuleConfig
from pricemesh.functions.identity import is_accessory, query_words, with_identity
from pricemesh.functions.text import title_key


def upper_median(groups: DataFrame) -> DataFrame:
    """(query_id, median): element n div 2 of the sorted group minimums that are not zero.

    Equal prices are counted, not listed, so a query with very many groups
    costs one row per distinct price.
    """
    counted = groups.filter("price_min <> 0").groupBy("query_id", "price_min").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("query_id").orderBy("price_min")
    running = counted.withColumn("_upto", F.sum("n").over(upto))
    totals = counted.groupBy("query_id").agg(F.sum("n").alias("total"))
    return (
        running.join(totals, "query_id")
        .filter(F.col("_upto") > F.floor(F.col("total") / 2))
        .groupBy("query_id")
        .agg(F.min("price_min").alias("median"))
    )


def _asks_refurbished(query: Column) -> Column:
    words = F.array(*[F.lit(w) for w in vocab.REFURBISHED_QUERY_WORDS])
    return F.arrays_overlap(F.split(F.lower(query), r"(?U)\s+"), words)


def score_groups(groups: DataFrame) -> DataFrame:
    """Add ``relevance`` and ``flags``.

    ``groups`` carry query_id, query, canonical_title, price_min, marketplaces.
    """
    c = F.col
    asked = with_identity(groups.select("query_id", "query").distinct(), "query", "wanted").select(
        "query_id", "wanted", query_words(c("query")).alias("query_words"), _asks_refurbished(c("query")).alias("_refurb_ok")
    )
    rows = (
        with_identity(groups, "canonical_title", "found")
        .join(asked, "query_id")
        .join(upper_median(groups), "query_id", "left")
    )
    terms = lambda i: F.array_union(i["model"], i["family"])
    storage_wanted = c("wanted.storage").isNotNull().cast("int")
    hits = F.size(F.array_intersect(terms(c("wanted")), terms(c("found")))) + F.coalesce(
        (c("wanted.storage") == c("found.storage")).cast("int"), F.lit(0)
    )
    total = F.size(terms(c("wanted"))) + storage_wanted

    def is_extra(m: Column) -> Column:
        longer = F.exists(
            c("wanted.model"), lambda w: (m != w) & m.startswith(w) & w.rlike(r"^\d+$")
        )
        return m.isin(vocab.RULE_VARIANT_WORDS) | (m == "e") | longer

    extra = F.size(F.filter(F.array_except(c("found.model"), c("wanted.model")), is_extra))
    wrong_brand = c("wanted.brand").isNotNull() & F.coalesce(
        c("found.brand_guess") != c("wanted.brand"), F.lit(True)
    )
    refurbished = (c("found.condition") == "refurbished") & ~c("_refurb_ok")
    accessory = is_accessory(c("found"), c("query_words"))
    cheap = F.coalesce(c("price_min") < 0.4 * c("median"), F.lit(False))
    minus = lambda test, points: F.when(test, points).otherwise(0.0)
    staged = (
        rows.withColumn("_share", F.when(total > 0, hits / total).otherwise(0.5))
        .withColumn("_extra", extra)
        .withColumn("_brand", wrong_brand)
        .withColumn("_refurbished", refurbished)
        .withColumn("_accessory", accessory)
        .withColumn("_cheap", cheap)
    )
    relevance = (
        c("_share") - 0.2 * c("_extra") - minus(c("_brand"), 0.6) - minus(c("_refurbished"), 0.25)
        - minus(c("_accessory"), 0.6) - minus(c("_cheap"), 0.9) + 0.05 * (F.size("marketplaces") - 1)
    )
    flags = F.array(
        F.when(c("_refurbished"), "refurbished"),
        F.when(c("_accessory"), "accessory"),
        F.when(c("_cheap"), "unusually_low_price"),
    )
    return (
        staged.withColumn("relevance", F.round(relevance, 3))
        .withColumn("flags", F.filter(flags, lambda f: f.isNotNull()))
        .drop(
            "found", "wanted", "query_words", "_refurb_ok", "median", "_share", "_extra", "_brand",
            "_refurbished", "_accessory", "_cheap",
        )
    )


def visible_groups(scored: DataFrame) -> DataFrame:
    """Hide flagged groups; then those without known delivery if any has it; then weak ones if three are strong.

    The counts per query are aggregates joined back, not windows, so a query
    with very many groups is counted on the map side.
    """
    plain = scored.filter(F.size("flags") == 0)
    counts = plain.groupBy("query_id").agg(
        F.count_if(F.col("fastest_days").isNotNull()).alias("_known"),
        F.count_if(F.col("relevance") >= 0.5).alias("_strong"),
        F.count_if((F.col("relevance") >= 0.5) & F.col("fastest_days").isNotNull()).alias("_strong_known"),
    )
    strong = F.when(F.col("_known") > 0, F.col("_strong_known")).otherwise(F.col("_strong"))
    return (
        plain.join(counts, "query_id")
        .filter((F.col("_known") == 0) | F.col("fastest_days").isNotNull())
        .filter((strong < 3) | (F.col("relevance") >= 0.5))
        .drop("_known", "_strong", "_strong_known")
    )


def _place(*columns: Column) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def final_groups(visible: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Drop look-alike titles and number the groups of each query.

    All groups are returned with their place; where ``cfg.max_groups`` sets a
    page size, only the best groups of each query.
    """
    c = F.col
    stores = F.size("marketplaces")
    place = _place(-c("relevance"), -stores, c("rank"), c("group_id"))
    placed = visible.withColumn("_place", place).withColumn("_title", title_key(c("canonical_title")))
    first = placed.groupBy("query_id", "_title").agg(F.min("_place").alias("_place"))
    unique = placed.join(first, ["query_id", "_title", "_place"], "left_semi")
    if cfg.max_groups is not None:
        # Spark trims each partition to the page size before the exchange.
        best = Window.partitionBy("query_id").orderBy("_place")
        unique = unique.withColumn("_n", F.row_number().over(best)).filter(c("_n") <= cfg.max_groups).drop("_n")
    shown = Window.partitionBy("query_id").orderBy(-c("relevance"), c("rank"), c("_place"))
    return unique.withColumn("place", F.row_number().over(shown)).drop("_place", "_title")
