"""Distinct matching profiles of a catalog.

The pair score reads only the product text, the attributes and the image hash
of a listing.  Listings that agree in all of these are copies of one profile:
profiles are compared once, however many copies there are, and every count
further on is weighted by the number of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.config import MatchConfig
from pricemesh.functions.attributes import with_attributes
from pricemesh.functions.text import digest, product_text, tokens
from pricemesh.operators.embedding import gram_buckets, word_buckets
from pricemesh.operators.idf import corpus_idf, unseen_idf

SCORED = list(vocab.ATTRIBUTE_WEIGHTS)


def members(listings: DataFrame) -> DataFrame:
    """Listings with attributes, token texts and the signature of their profile."""
    staged = (
        with_attributes(listings)
        .withColumn("text_tokens", F.array_join(tokens(product_text(F.col("title"), F.col("attributes"))), " "))
        .withColumn("title_tokens", F.array_join(F.array_sort(F.array_distinct(tokens(F.col("title")))), " "))
        .withColumn(
            "attribute_text",
            F.array_join(
                F.transform(
                    F.array_sort(F.map_entries("attributes")),
                    lambda e: F.concat(e["key"], F.lit("\u0003"), e["value"]),
                ),
                "\u0002",
            ),
        )
        .withColumn("image_hash", F.coalesce("image_hash", F.lit("")))
    )
    parts = F.concat_ws("\u0001", "text_tokens", "title_tokens", "attribute_text", "image_hash")
    return staged.withColumn("signature", digest(parts))


def _family(name: Column) -> Column:
    """Related names count as one when blocks are formed."""
    fold = [(b, a) for a, b in vocab.RELATED_CATEGORIES]
    out = F.nullif(name, F.lit(""))
    for b, a in fold:
        out = F.when(name == b, a).otherwise(out)
    return out


def profiles(member_rows: DataFrame) -> DataFrame:
    """One row per signature; ``profile_id`` is the first position among its copies."""
    grouped = member_rows.groupBy(
        "signature", "text_tokens", "title_tokens", "attribute_text", "image_hash"
    ).agg(
        F.min("position").alias("profile_id"),
        F.max("position").alias("last_position"),
        F.count("*").alias("copies"),
    )
    words = lambda k: F.filter(F.split(k, " "), lambda w: w != "")
    attrs = F.when(
        F.col("attribute_text") != "", F.str_to_map("attribute_text", F.lit("\u0002"), F.lit("\u0003"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    staged = grouped.select(
        "profile_id", "last_position", "copies", "signature", "image_hash",
        words("text_tokens").alias("text_tokens"),
        words("title_tokens").alias("title_tokens"),
        attrs.alias("attributes"),
    )
    scored = F.array(*[F.try_element_at("attributes", F.lit(k)) for k in SCORED])
    return (
        staged.withColumn("attrs", scored)
        .withColumn("category", F.try_element_at("attributes", F.lit("category")))
        .withColumn("category_block", _family(F.col("category")))
        .withColumn("brand_block", _family(F.try_element_at("attributes", F.lit("brand"))))
    )


def weighted(profile_rows: DataFrame, cfg: MatchConfig, idf: DataFrame | None = None) -> DataFrame:
    """Add the token weights and embedding buckets the comparison needs.

    Without ``idf`` the weights come from these profiles' own titles.
    """
    if idf is None:
        idf = corpus_idf(profile_rows, "title_tokens", "copies")
    per_token = profile_rows.select("profile_id", F.explode(F.array_distinct("text_tokens")).alias("token"))
    lists = (
        per_token.join(idf.select("token", "idf_micros"), "token", "left")
        .withColumn("micros", F.coalesce("idf_micros", unseen_idf(F.col("token"))))
        .groupBy("profile_id")
        .agg(
            F.collect_list(F.struct("token", "micros")).alias("weights"),
            F.sum("micros").alias("total_micros"),
        )
    )
    return (
        profile_rows.join(lists, "profile_id", "left")
        .withColumn("word_buckets", word_buckets(F.col("text_tokens"), cfg.dims))
        .withColumn("gram_buckets", gram_buckets(F.col("text_tokens"), cfg.dims))
    )
