"""Product groups: which listings are one product, and how the product is shown.

Grouping works on profiles.  Copies of a profile are one product when two
copies match exactly or when the profile matches another one exactly; then the
``class_id`` stands for one product.  Otherwise each copy stays a product of
its own and the class holds several equal products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.functions.text import clean_title
from pricemesh.operators.components import connected_components
from pricemesh.operators.scoring import EXACT


def classes(profiles: DataFrame, scored: DataFrame) -> DataFrame:
    """(profile_id, copies, class_id, merged) for every profile."""
    exact = scored.filter(F.col("match_type") == EXACT).select("profile_a", "profile_b")
    linked = connected_components(exact, "profile_a", "profile_b")
    alike = exact.filter("profile_a = profile_b").select(
        F.col("profile_a").alias("profile_id"), F.lit(True).alias("_alike")
    )
    return (
        profiles.select("profile_id", "copies")
        .join(linked.withColumnRenamed("node", "profile_id"), "profile_id", "left")
        .join(alike, "profile_id", "left")
        .select(
            "profile_id",
            "copies",
            F.coalesce("component", "profile_id").alias("class_id"),
            (F.col("component").isNotNull() | F.col("_alike").isNotNull() | (F.col("copies") == 1)).alias("merged"),
        )
    )


def membership(member_rows: DataFrame, profiles: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Listings with ``profile_id``, ``class_id`` and ``product_id`` (its first position)."""
    keyed = profiles.select("signature", "profile_id").join(class_rows, "profile_id")
    return (
        member_rows.join(keyed, "signature")
        .withColumn("product_id", F.when(F.col("merged"), F.col("class_id")).otherwise(F.col("position")))
    )


def in_class(scored: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Pairs with the class of both sides."""
    side = lambda s: class_rows.select(
        F.col("profile_id").alias(f"profile_{s}"),
        F.col("class_id").alias(f"class_{s}"),
        F.col("merged").alias(f"merged_{s}"),
    )
    return scored.join(side("a"), "profile_a").join(side("b"), "profile_b")


def centrality(scored: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Sum of kept scores from one copy of a profile to the other listings of its product."""
    inside = in_class(scored, class_rows).filter("class_a = class_b and merged_a")
    points = F.col("combined_score").cast("decimal(20,4)")
    same = F.col("profile_a") == F.col("profile_b")
    to_b = inside.select(
        F.col("profile_a").alias("profile_id"),
        (points * (F.col("copies_b") - same.cast("bigint"))).alias("points"),
    )
    to_a = inside.filter(~same).select(
        F.col("profile_b").alias("profile_id"), (points * F.col("copies_a")).alias("points")
    )
    return to_b.unionByName(to_a).groupBy("profile_id").agg(F.sum("points").alias("centrality"))


def majority_attributes(profiles: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Most common value per attribute and class; ties go to the value seen first."""
    values = profiles.join(class_rows.select("profile_id", "class_id"), "profile_id").select(
        "class_id", "profile_id", "copies", F.explode("attributes").alias("key", "value")
    )
    counted = values.groupBy("class_id", "key", "value").agg(
        F.sum("copies").alias("votes"), F.min("profile_id").alias("first")
    )
    best = counted.groupBy("class_id", "key").agg(
        F.max_by("value", F.struct("votes", -F.col("first"))).alias("value")
    )
    # One entry per attribute name, so the map stays small.
    return best.groupBy("class_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes")
    )


def canonical_products(
    members: DataFrame, profiles: DataFrame, scored: DataFrame, class_rows: DataFrame
) -> DataFrame:
    """One row per product: most central title, longest description, most reviewed image."""
    central = class_rows.join(centrality(scored, class_rows), "profile_id", "left").withColumn(
        "centrality", F.coalesce("centrality", F.lit(0).cast("decimal(38,4)"))
    )
    rows = membership(members, profiles, central)
    first = -F.col("position")
    described = F.coalesce("description", F.lit(""))
    shown = rows.groupBy("product_id", "class_id").agg(
        F.max_by("title", F.struct("centrality", first)).alias("title"),
        F.max_by(described, F.struct(F.length(described), first)).alias("description"),
        F.max_by("image_url", F.struct("review_count", first)).alias("canonical_image"),
        F.count("*").alias("listing_count"),
        F.min("position").alias("group_position"),
    )
    return shown.join(majority_attributes(profiles, class_rows), "class_id", "left").select(
        "product_id",
        "class_id",
        clean_title(F.col("title")).alias("canonical_title"),
        F.try_element_at("attributes", F.lit("brand")).alias("brand"),
        F.try_element_at("attributes", F.lit("category")).alias("category"),
        "description",
        "canonical_image",
        "attributes",
        "listing_count",
        "group_position",
    )


def batch_summary(members: DataFrame, products: DataFrame, scored: DataFrame) -> DataFrame:
    """Sizes of one batch build, as one row per measure."""
    measure = lambda name, df, value: df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(
        F.lit(name).alias("measure"), "value"
    )
    rows = [
        measure("marketplaces", members.groupBy("marketplace").count(), F.count("*")),
        measure("listings", members, F.count("*")),
        measure("products", products, F.count("*")),
        measure("multi_listing_groups", products, F.count_if(F.col("listing_count") > 1)),
        measure("matches", scored, F.sum("n_pairs")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
