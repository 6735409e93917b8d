"""Why the listings of a product belong together, and which products are similar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemesh.operators.products import in_class
from pricemesh.operators.scoring import EXACT, SIMILAR, reasons
from pricemesh.operators.sorting import rank_within


def _directed(pairs: DataFrame, member_positions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``n_forward``: in how many listing pairs the a-side listing comes first.

    ``by``: columns of both tables that pairs and their listings share.

    The catalog order decides the wording "(x vs y)".  Most profiles do not
    interleave, so the count is all pairs.  Only where copies of two profiles
    interleave *and* a reason names both values are the copies counted.
    """
    wording = F.exists(reasons(), lambda r: r["label"].rlike(r" differs \(|^Related category \("))
    same = F.col("profile_a") == F.col("profile_b")
    mixed = ~same & (F.col("last_position_a") > F.col("profile_b")) & wording
    flagged = pairs.withColumn("_mixed", mixed)
    keys = [*by, "profile_a", "profile_b"]
    inside = flagged.filter("_mixed").select(*keys)
    at = lambda s: member_positions.select(*by, F.col("profile_id").alias(f"profile_{s}"), "position")
    lined_up = (
        inside.join(at("a"), [*by, "profile_a"]).withColumn("_a", F.lit(1))
        .unionByName(inside.join(at("b"), [*by, "profile_b"]).withColumn("_a", F.lit(0)))
    )
    before = Window.partitionBy(*keys).orderBy("position")
    counted = (
        lined_up.withColumn("_before", F.sum("_a").over(before))
        .filter("_a = 0")
        .groupBy(*keys)
        .agg(F.sum("_before").alias("_forward"))
    )
    return (
        flagged.join(counted, keys, "left")
        .withColumn("n_forward", F.when(F.col("_mixed"), F.coalesce("_forward", F.lit(0))).otherwise(F.col("n_pairs")))
        .drop("_mixed", "_forward")
    )


def exact_pairs_in_groups(scored: DataFrame, class_rows: DataFrame) -> DataFrame:
    return in_class(scored, class_rows).filter(
        (F.col("match_type") == EXACT) & (F.col("class_a") == F.col("class_b"))
    )


def _summarised(inside: DataFrame, directed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Confidence, mean scores and the reasons most pairs of a group share."""
    n = F.col("n_pairs").cast("decimal(20,0)")
    total = lambda score: F.sum(F.col(score).cast("decimal(12,4)") * n)
    mean = lambda score: (total(score) / F.sum("n_pairs")).cast("double")
    scores = inside.groupBy(*by).agg(
        F.sum("n_pairs").alias("pair_count"),
        F.round(mean("combined_score") * 100, 0).cast("bigint").alias("confidence"),
        F.round(mean("text_score"), 3).alias("text"),
        F.round(mean("attribute_score"), 3).alias("attribute"),
        F.round(mean("image_score"), 3).alias("image"),
    )
    place = lambda first, second, k: F.struct(F.col(first).alias("x"), F.col(second).alias("y"), k.alias("k"))
    ways = [
        (reasons("a", "b"), F.col("n_forward"), ("profile_a", "profile_b")),
        (reasons("b", "a"), F.col("n_pairs") - F.col("n_forward"), ("profile_b", "profile_a")),
    ]
    labelled = None
    for said, times, order in ways:
        rows = (
            directed.withColumn("_times", times)
            .filter("_times > 0")
            .select(*by, "_times", *order, F.posexplode(said).alias("_k", "r"))
            .select(
                *by,
                "_times",
                (F.col("r.status") == "ok").alias("ok"),
                F.col("r.label").alias("label"),
                place(*order, F.col("_k")).alias("first"),
            )
        )
        labelled = rows if labelled is None else labelled.unionByName(rows)
    counted = labelled.groupBy(*by, "ok", "label").agg(
        F.sum("_times").alias("times"), F.min("first").alias("first")
    )
    kept = counted.join(scores.select(*by, "pair_count"), list(by)).filter(
        F.when(F.col("ok"), F.col("times") * 2 >= F.col("pair_count")).otherwise(
            F.col("times") * 3 >= F.greatest(F.lit(3), F.col("pair_count"))
        )
    )
    # A kept label is in a third of the pairs, so there are few of them.
    entry = F.struct(
        (~F.col("ok")).alias("late"), (-F.col("times")).alias("rare"), "first", "label",
        F.when(F.col("ok"), "ok").otherwise("warn").alias("status"),
    )
    listed = kept.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_listed"))
    return scores.join(listed, list(by), "left").select(
        *by, "pair_count", "confidence", "text", "attribute", "image",
        F.transform("_listed", lambda e: F.struct(e["label"].alias("label"), e["status"].alias("status"))).alias("reasons"),
    )


def explanations(scored: DataFrame, class_rows: DataFrame, member_positions: DataFrame) -> DataFrame:
    """Confidence, mean scores and the reasons most pairs of a product share."""
    inside = exact_pairs_in_groups(scored, class_rows).withColumnRenamed("class_a", "class_id")
    return _summarised(inside, _directed(inside, member_positions), ("class_id",))


def found_explanations(scored: DataFrame, class_rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same per query, over the pairs of which a query found both listings.

    ``found`` holds (query_id, profile_id, position), one row per listing found.
    Copies are counted per query and profile first, so pairs are never expanded.
    """
    counts = found.groupBy("query_id", "profile_id").agg(F.count("*").alias("n"))
    side = lambda s: counts.select("query_id", F.col("profile_id").alias(f"profile_{s}"), F.col("n").alias(f"n_{s}"))
    same = F.col("profile_a") == F.col("profile_b")
    n_pairs = F.when(same, F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    inside = (
        exact_pairs_in_groups(scored, class_rows)
        .withColumnRenamed("class_a", "class_id")
        .join(side("a"), "profile_a")
        .join(side("b"), ["query_id", "profile_b"])
        .withColumn("n_pairs", n_pairs)
        .filter("n_pairs > 0")
    )
    return _summarised(inside, _directed(inside, found, ("query_id",)), ("query_id", "class_id"))


def similar_products(scored: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Best similar edge from each product class to each other one.

    A class of unmerged copies is similar to itself: its products are equal
    but separate.
    """
    edges = in_class(scored, class_rows).filter(
        (F.col("match_type") == SIMILAR)
        & ((F.col("class_a") != F.col("class_b")) | ~F.col("merged_a"))
    )
    edge = F.struct("combined_score", (-F.col("profile_a")).alias("a"), (-F.col("profile_b")).alias("b"))
    said = reasons()
    ways = edges.select(
        F.explode(
            F.when(
                F.col("class_a") == F.col("class_b"), F.array(F.struct(F.col("class_a").alias("f"), F.col("class_b").alias("t")))
            ).otherwise(
                F.array(
                    F.struct(F.col("class_a").alias("f"), F.col("class_b").alias("t")),
                    F.struct(F.col("class_b").alias("f"), F.col("class_a").alias("t")),
                )
            )
        ).alias("way"),
        edge.alias("edge"),
        said.alias("reasons"),
    )
    best = ways.groupBy(F.col("way.f").alias("class_id"), F.col("way.t").alias("other_class")).agg(
        F.max_by(F.struct("edge", "reasons"), F.col("edge")).alias("best")
    )
    return best.select(
        "class_id",
        "other_class",
        F.col("best.edge.combined_score").alias("combined_score"),
        F.round(F.col("best.edge.combined_score") * 100, 0).cast("bigint").alias("similarity"),
        F.col("best.reasons").alias("reasons"),
    )


def similar_counts(similar: DataFrame, class_rows: DataFrame) -> DataFrame:
    """(class_id, n_similar, similar_listings) of each product of a class that has similar products.

    A class of unmerged copies is one product per copy: it counts with all of
    them for other classes and with all but one for each of its own products.
    """
    sizes = class_rows.groupBy(F.col("class_id").alias("other_class")).agg(
        F.sum("copies").alias("listings"), F.min("merged").alias("merged")
    )
    itself = (F.col("class_id") == F.col("other_class")).cast("bigint")
    products = F.when(F.col("merged"), F.lit(1)).otherwise(F.col("listings"))
    return similar.select("class_id", "other_class").join(sizes, "other_class").groupBy("class_id").agg(
        F.sum(products - itself).alias("n_similar"), F.sum(F.col("listings") - itself).alias("similar_listings")
    )


def similar_of(asked: DataFrame, products: DataFrame, similar: DataFrame) -> DataFrame:
    """The similar products of each asked one (product_id, class_id), best edge first, then by product id.

    Products of one class have the same similar products in the same order, but for themselves, so they are
    ranked once a class.  Class edges become product edges in the last join, whose rows go nowhere but into the
    result: copies that stay apart are never written all with all.  ``products`` holds (product_id, class_id,
    listing_count).
    """
    others = products.select(F.col("product_id").alias("other_product"), F.col("class_id").alias("other_class"), "listing_count")
    edges = similar.join(asked.select("class_id"), "class_id", "left_semi").join(others, "other_class")
    ranked = rank_within(edges, ["class_id"], [F.col("combined_score").desc(), F.col("other_product").asc()], "_place")
    itself = ranked.select("class_id", F.col("other_product").alias("product_id"), F.col("_place").alias("_own"))
    met = asked.join(itself, ["class_id", "product_id"], "left").join(ranked, "class_id").filter("product_id <> other_product")
    # A product is not similar to itself: those after it move up by one.
    moved = F.coalesce((F.col("_own") < F.col("_place")).cast("int"), F.lit(0))
    return met.select("product_id", "other_product", (F.col("_place") - moved).alias("place"), "similarity", "listing_count", "reasons")


def telling_reasons(reason_list):
    """Up to three reasons that are not agreements."""
    return F.slice(F.filter(reason_list, lambda r: r["status"] != "ok"), 1, 3)
