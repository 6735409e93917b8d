"""Pair scores, classes and reasons as column expressions over two profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.config import MatchConfig
from pricemesh.functions.images import ImageSimilarity, hash_similarity
from pricemesh.operators.embedding import bucket_weights
from pricemesh.session import filter_here

EXACT, SIMILAR, DIFFERENT = "EXACT_MATCH", "SIMILAR", "DIFFERENT"


NEITHER, DIFFERS, SAME = 0, 1, 2   # how the two sides stand on one attribute
_KEYS = list(vocab.ATTRIBUTE_WEIGHTS)


def _at(array: str, key: str) -> Column:
    return F.get(F.col(array), _KEYS.index(key))


def _related(a: Column, b: Column) -> Column:
    hits = [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in vocab.RELATED_CATEGORIES]
    return F.coalesce(reduce(lambda p, q: p | q, hits), F.lit(False))


def agreement() -> Column:
    """NEITHER (not stated on both sides), DIFFERS or SAME for each scored attribute."""
    return F.zip_with(
        F.col("attrs_a"),
        F.col("attrs_b"),
        lambda a, b: F.when(a.isNull() | b.isNull(), NEITHER).when(a == b, SAME).otherwise(DIFFERS),
    )


def _differs(keys: list[str]) -> Column:
    return F.exists(F.array(*[_at("agreement", k) for k in keys]), lambda x: x == DIFFERS)


def attribute_score() -> Column:
    weights = F.array(*[F.lit(w) for w in vocab.ATTRIBUTE_WEIGHTS.values()])
    weight_of = lambda least: F.aggregate(
        F.zip_with(F.col("agreement"), weights, lambda x, w: F.when(x >= least, w).otherwise(0.0)),
        F.lit(0.0),
        lambda s, w: s + w,
    )
    half = F.when(
        _related(_at("attrs_a", "category"), _at("attrs_b", "category")),
        vocab.ATTRIBUTE_WEIGHTS["category"] / 2,
    ).otherwise(0.0)
    total = weight_of(DIFFERS)
    return F.when(total == 0, 0.5).otherwise(F.round((weight_of(SAME) + half) / total, 4))


def _reason(label: Column | str, status: str) -> Column:
    text = label if isinstance(label, Column) else F.lit(label)
    return F.struct(text.alias("label"), F.lit(status).alias("status"))


def reasons(first: str = "a", second: str = "b") -> Column:
    """What agrees and what differs, in the words shown to a reader.

    The order of the sides decides the wording "(x vs y)": the listing that
    comes first in the catalog is named first.
    """
    labels = F.array(*[F.lit(vocab.ATTRIBUTE_LABELS[k]) for k in _KEYS])
    names = F.array(*[F.lit(vocab.ATTRIBUTE_LABELS[k].capitalize()) for k in _KEYS])
    one_sided = F.array(*[F.lit(k in vocab.ONE_SIDED_ATTRIBUTES) for k in _KEYS])
    category = _KEYS.index("category")

    def reason(i: Column) -> Column:
        a, b = F.get(F.col(f"attrs_{first}"), i), F.get(F.col(f"attrs_{second}"), i)
        state, name = F.get(F.col("agreement"), i), F.get(names, i)
        related = F.concat(F.lit("Related category ("), a, F.lit(" / "), b, F.lit(")"))
        differs = F.concat(name, F.lit(" differs ("), a, F.lit(" vs "), b, F.lit(")"))
        missing = F.concat(name, F.lit(" unavailable on one listing"))
        return (
            F.when(state == SAME, _reason(F.concat(F.lit("Same "), F.get(labels, i)), "ok"))
            .when((i == category) & _related(a, b), _reason(related, "warn"))
            .when(state == DIFFERS, _reason(differs, "warn"))
            .when(F.get(one_sided, i) & (a.isNotNull() != b.isNotNull()), _reason(missing, "warn"))
        )

    of_attributes = F.transform(F.sequence(F.lit(0), F.lit(len(_KEYS) - 1)), reason)
    image, text = F.col("image_score"), F.col("text_score")
    of_image = (
        F.when(image >= 0.9, _reason("Similar product imagery", "ok"))
        .when(image >= 0.75, _reason("Partially similar imagery", "warn"))
        .otherwise(_reason("Imagery differs", "warn"))
    )
    of_text = (
        F.when(text >= 0.7, _reason("Similar product title", "ok"))
        .when(text >= 0.45, _reason("Partially similar title", "warn"))
        .otherwise(_reason("Titles differ", "warn"))
    )
    listed = "array<struct<label:string,status:string>>"
    return F.concat(
        F.filter(of_attributes, lambda r: r.isNotNull()).cast(listed), F.array(of_image, of_text).cast(listed)
    )


def classify(score: Column, exact: float = 0.90, similar: float = 0.70) -> Column:
    return F.when(score >= exact, EXACT).when(score >= similar, SIMILAR).otherwise(DIFFERENT)


def score(pairs: DataFrame, cfg: MatchConfig, image: ImageSimilarity = hash_similarity) -> DataFrame:
    """Add all scores and the class to pairs carrying dice, cosine, attrs_* and image_hash_*."""
    c = F.col
    total = c("text_score") * cfg.text + c("attribute_score") * cfg.attribute + c("image_score") * cfg.image
    stated = lambda k: (_at("attrs_a", k) != "") & (_at("attrs_b", k) != "")
    other_identity = [
        (_at("agreement", k) == DIFFERS) & stated(k) & ~_related(_at("attrs_a", k), _at("attrs_b", k))
        for k in vocab.IDENTITY_ATTRIBUTES
    ]
    raw = (
        pairs.withColumn("agreement", agreement())
        .withColumn("text_score", F.round(0.5 * c("dice") + 0.5 * c("cosine"), 4))
        .withColumn("attribute_score", attribute_score())
        .withColumn("image_score", image(c("image_hash_a"), c("image_hash_b")))
        .withColumn("_raw", F.round(F.least(F.lit(1.0), total), 4))
        .withColumn("_identity", F.coalesce(reduce(lambda p, q: p | q, other_identity), F.lit(False)))
        .withColumn("_variant", _differs(vocab.VARIANT_ATTRIBUTES))
        .withColumn("_cousin", (_at("agreement", "category") == DIFFERS) & F.coalesce(stated("category"), F.lit(False)))
        .withColumn("_type", F.when(c("_identity"), DIFFERENT).otherwise(classify(c("_raw"), cfg.exact, cfg.similar)))
    )
    below_exact, below_similar = F.lit(cfg.exact - 0.01), F.lit(cfg.similar - 0.01)
    # Variant conflicts and related categories can be similar at best.
    capped = (c("_type") != DIFFERENT) & (c("_variant") | ((c("_type") == EXACT) & c("_cousin")))
    combined = (
        F.when(c("_identity"), F.least(c("_raw"), below_similar))
        .when(capped, F.least(c("_raw"), below_exact))
        .otherwise(c("_raw"))
    )
    return (
        raw.withColumn("combined_score", F.round(combined, 4))
        .withColumn("match_type", F.when(capped & (c("_type") == EXACT), SIMILAR).otherwise(c("_type")))
        .drop("_raw", "_identity", "_variant", "_cousin", "_type")
    )


def with_sides(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach what scoring and counting need from both profiles."""
    kept = ("copies", "last_position", "attrs", "image_hash")
    side = lambda s: profiles.select(
        F.col("profile_id").alias(f"profile_{s}"), *[F.col(k).alias(f"{k}_{s}") for k in kept]
    )
    return pairs.join(side("a"), "profile_a").join(side("b"), "profile_b")


def self_pairs(weighted: DataFrame) -> DataFrame:
    """Copies of one profile as a pair of the profile with itself."""
    stated = (F.coalesce(F.col("total_micros"), F.lit(0)) > 0).cast("double")
    return weighted.filter("copies > 1").select(
        F.col("profile_id").alias("profile_a"),
        F.col("profile_id").alias("profile_b"),
        stated.alias("dice"),
        stated.alias("cosine"),
    )


def score_profiles(candidates: DataFrame, weighted: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Exact and similar profile pairs; ``n_pairs`` listing pairs stand behind each."""
    pairs = candidates.unionByName(self_pairs(weighted))
    scored = filter_here(score(with_sides(pairs, weighted), cfg), F.col("match_type") != DIFFERENT)
    a, b = F.col("copies_a"), F.col("copies_b")
    same = F.col("profile_a") == F.col("profile_b")
    n_pairs = F.when(same, F.floor(a * (a - 1) / 2)).otherwise(a * b)
    return scored.withColumn("n_pairs", n_pairs.cast("bigint"))


def score_requested(requests: DataFrame, weighted: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Score given (profile_a, profile_b) pairs, whatever their class.

    Token and bucket sums come from joins on (pair, token) and (pair, bucket),
    so the cost follows the number of requested pairs.
    """
    pairs = requests.select("profile_a", "profile_b").distinct()

    def sums(features: DataFrame, key: str, out: str) -> DataFrame:
        left = pairs.join(features.withColumnRenamed("profile_id", "profile_a"), "profile_a")
        right = pairs.join(
            features.withColumnsRenamed({"profile_id": "profile_b", "w": "w_b"}), "profile_b"
        )
        product = F.col("w") if out == "shared" else F.col("w") * F.col("w_b")
        return (
            left.join(right, ["profile_a", "profile_b", key])
            .groupBy("profile_a", "profile_b")
            .agg(F.sum(product).alias(out))
        )

    tokens = weighted.select("profile_id", F.explode("weights").alias("t")).select(
        "profile_id", F.col("t.token").alias("token"), F.col("t.micros").alias("w")
    )
    buckets = bucket_weights(weighted, "profile_id", "text_tokens", cfg.dims).withColumnRenamed("weight", "w")
    norms = buckets.groupBy("profile_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias("norm"))
    totals = weighted.select("profile_id", "total_micros").join(norms, "profile_id", "left")
    side = lambda s: totals.select(
        F.col("profile_id").alias(f"profile_{s}"),
        F.coalesce("total_micros", F.lit(0)).alias(f"total_{s}"),
        F.coalesce("norm", F.lit(1.0)).alias(f"norm_{s}"),
    )
    c = F.col
    text = (
        pairs.join(sums(tokens, "token", "shared"), ["profile_a", "profile_b"], "left")
        .join(sums(buckets, "bucket", "dot"), ["profile_a", "profile_b"], "left")
        .join(side("a"), "profile_a")
        .join(side("b"), "profile_b")
        .withColumn("_stated", (c("total_a") > 0) & (c("total_b") > 0))
        .withColumn(
            "dice",
            F.when(c("_stated"), 2.0 * F.coalesce("shared", F.lit(0)) / (c("total_a") + c("total_b"))).otherwise(0.0),
        )
        .withColumn(
            "cosine",
            F.when(
                c("_stated"), F.least(F.lit(1.0), F.coalesce("dot", F.lit(0)) / (c("norm_a") * c("norm_b")))
            ).otherwise(0.0),
        )
        .select("profile_a", "profile_b", "dice", "cosine")
    )
    return score(with_sides(text, weighted), cfg)


def expand_pairs(scored: DataFrame, member_profiles: DataFrame) -> DataFrame:
    """Listing-level edge list of the profile pairs, first listing first.

    As long as the edge list itself: meant for catalogs with few copies.
    ``member_profiles`` holds (profile_id, position, listing_id).
    """
    side = lambda s: member_profiles.select(
        F.col("profile_id").alias(f"profile_{s}"),
        F.col("position").alias(f"position_{s}"),
        F.col("listing_id").alias(f"listing_{s}"),
    )
    c = F.col
    met = scored.join(side("a"), "profile_a").join(side("b"), "profile_b")
    met = met.filter((c("profile_a") != c("profile_b")) | (c("position_a") < c("position_b")))
    forward = c("position_a") < c("position_b")
    return met.select(
        F.when(forward, c("listing_a")).otherwise(c("listing_b")).alias("listing_a"),
        F.when(forward, c("listing_b")).otherwise(c("listing_a")).alias("listing_b"),
        "text_score", "image_score", "attribute_score", "combined_score", "match_type",
        F.when(forward, reasons("a", "b")).otherwise(reasons("b", "a")).alias("reasons"),
    )
