"""Ad-hoc matching: requested pairs of catalog listings and of rows sent along, weighed by kept corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.config import MatchConfig
from pricemesh.operators import profiles, scoring
from pricemesh.operators.idf import corpus_idf
from pricemesh.operators.ingest import first_rows
from pricemesh.session import cut_lineage

#: What a pair score reads of a listing; rows sent along hold these.
PAYLOAD = ("title", "description", "brand", "category", "image_url", "image_hash", "product_attributes")


def catalog_statistics(listings: DataFrame) -> DataFrame:
    """(token, df, idf_micros) of a catalog's titles, to be kept with ``sinks.write_statistics``."""
    return corpus_idf(profiles.members(listings).withColumn("words", F.filter(F.split("title_tokens", " "), lambda w: w != "")), "words")


def match_requests(requests: DataFrame, payloads: DataFrame, listings: DataFrame, idf: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """One row per row of ``requests`` (request_id, listing_a, listing_b): scores, class and reasons of the pair asked for.

    A side is the catalog listing of the given id or else the row of
    ``payloads`` (request_id, side ``a`` or ``b``, ``PAYLOAD``); ``listing_a`` and
    ``listing_b`` then read ``adhoc-a`` and ``adhoc-b``.  ``outcome`` is
    ``missing`` where a side is neither, with null scores, else ``scored``.  Token
    weights come from ``idf``, a catalog's statistics: tokens it does not hold weigh
    as unseen, and requested rows never change them.  Of rows with equal keys the
    first by position (payloads: by title) counts.  Only requested rows are
    tokenised, each distinct profile once.
    """
    ids = requests.select(F.col("listing_a").alias("listing_id")).unionByName(requests.select(F.col("listing_b").alias("listing_id"))).distinct()
    held = first_rows(listings.join(ids, "listing_id", "left_semi").select("listing_id", "position", *PAYLOAD))
    held = held.withColumn("key", F.concat(F.lit("l"), "listing_id"))
    sent = first_rows(payloads.withColumn("key", F.concat(F.lit("p"), "side", "request_id")).filter("key is not null").select("key", *PAYLOAD), "key", "title")
    rows = cut_lineage(held.select("key", *PAYLOAD).unionByName(sent).withColumnRenamed("key", "position"))

    member_rows = cut_lineage(profiles.members(rows))
    profile_rows = cut_lineage(profiles.profiles(member_rows))
    weighted = cut_lineage(profiles.weighted(profile_rows, cfg, idf))
    placed = member_rows.select(F.col("position").alias("key"), "signature").join(profile_rows.select("signature", "profile_id"), "signature")
    placed = cut_lineage(placed.select("key", "profile_id"))

    asked = requests.select("request_id", "listing_a", "listing_b")
    for side in "ab":
        of_catalog = placed.select(F.col("key").alias("_held"), F.col("profile_id").alias("_held_profile"))
        of_payload = placed.select(F.col("key").alias("_sent"), F.col("profile_id").alias("_sent_profile"))
        asked = (
            asked.join(of_catalog, F.concat(F.lit("l"), f"listing_{side}") == F.col("_held"), "left")
            .join(of_payload, F.concat(F.lit(f"p{side}"), "request_id") == F.col("_sent"), "left")
            .withColumn(f"profile_{side}", F.coalesce("_held_profile", "_sent_profile"))
            .withColumn(
                f"listing_{side}",
                F.when(F.col("_held").isNull() & F.col("_sent").isNotNull(), f"adhoc-{side}").otherwise(F.col(f"listing_{side}")),
            )
            .drop("_held", "_held_profile", "_sent", "_sent_profile")
        )
    asked = cut_lineage(asked)
    scored = scoring.score_requested(asked.filter("profile_a is not null and profile_b is not null"), weighted, cfg)
    shown = scored.select(
        "profile_a", "profile_b", "text_score", "attribute_score", "image_score", "combined_score", "match_type", scoring.reasons().alias("reasons")
    )
    return (
        asked.join(shown, ["profile_a", "profile_b"], "left")
        .withColumn("outcome", F.when(F.col("match_type").isNull(), "missing").otherwise("scored"))
        .withColumn("weights", F.struct(*[F.lit(w).alias(k) for k, w in (("text", cfg.text), ("attribute", cfg.attribute), ("image", cfg.image))]))
        .withColumn("thresholds", F.struct(F.lit(cfg.exact).alias("exact"), F.lit(cfg.similar).alias("similar")))
        .drop("profile_a", "profile_b")
    )
