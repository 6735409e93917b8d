"""The product page: offers compared, why the listings belong together, images, similar products and their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.operators.explain import similar_counts, similar_of
from pricemesh.operators.offers import images_in_order, rollup, with_discount
from pricemesh.plans.catalog import Build


def _asked(rows: DataFrame, requested: DataFrame | None) -> DataFrame:
    """Rows of the requested products; ``None`` asks for all, unknown and missing ids ask for none."""
    return rows if requested is None else rows.join(requested.select("product_id"), "product_id", "left_semi")


def product_details(built: Build, requested: DataFrame | None = None, sort: str = "price_asc") -> DataFrame:
    """One row per requested product: offer roll-up, explanation, ``n_similar`` and ``all_listings``.

    ``all_listings`` counts the product's own listings and those of all its similar products.
    """
    members = _asked(built.membership(), requested)
    keyed = members.groupBy("product_id").agg(F.min("class_id").alias("class_id"))
    counts = similar_counts(built.similar(), built.classes)
    similar = F.coalesce("similar_listings", F.lit(0))
    return (
        rollup(with_discount(members), ["product_id"], sort)
        .join(keyed, "product_id")
        .join(counts, "class_id", "left")
        .join(built.explanations(), "class_id", "left")
        .withColumn("n_similar", F.coalesce("n_similar", F.lit(0)))
        .withColumn("all_listings", F.col("listing_count") + similar)
        .drop("similar_listings")
    )


def product_images(built: Build, requested: DataFrame | None = None, sort: str = "price_asc") -> DataFrame:
    """The distinct images of each requested product with their rank, in the order of its listings."""
    return images_in_order(with_discount(_asked(built.membership(), requested)), ["product_id"], sort)


def product_similar(built: Build, requested: DataFrame | None = None) -> DataFrame:
    """(product_id, other_product, place, similarity, listing_count, reasons), best edge first."""
    rows = built.membership().groupBy("product_id").agg(
        F.min("class_id").alias("class_id"), F.count("*").alias("listing_count")
    )
    return similar_of(_asked(rows, requested).select("product_id", "class_id"), rows, built.similar())
