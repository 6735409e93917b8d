"""Identity of a listing read from its title alone, for the rule matcher."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.functions.text import lookup, squeeze

RAM = r"\b(\d{1,2})gb\s*ram\b|\bram\s*(\d{1,2})gb\b"
MEMORY = r"\b(?:\d+(?:\.\d+)?)(?:gb|tb)\b"
QUANTITY = r"\b(\d+(?:\.\d+)?)\s?(ml|l|g|kg|mah|w|inch|cm)\b"
COLOUR = r"\b(" + "|".join(
    re.escape(c).replace(r"\ ", " ") for c in sorted(vocab.RULE_COLOURS, key=len, reverse=True)
) + r")\b"


def rule_text(title: Column) -> Column:
    t = F.translate(F.lower(title), "’é", "'e")
    t = F.regexp_replace(t, r"(iphone|galaxy|pixel|redmi|note|ipad)((?U)\d)", "$1 $2")
    t = F.regexp_replace(t, r"(?U)(\d+)\s*(gb|tb)\b", "$1$2")
    t = F.regexp_replace(t, r"\[[^\]]*\]", " ")
    t = F.regexp_replace(t, r'[()\[\],|/+–—:;!"*]', " ")
    t = F.regexp_replace(t, r"(?U)\s-\s|\s-|-\s", " ")
    return squeeze(t)


def query_words(query: Column) -> Column:
    return F.filter(F.split(rule_text(query), " "), lambda w: w != "")


def _literal_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _sized(label: Column) -> Column:
    amount = F.regexp_extract(label, r"[\d.]+", 0).cast("double")
    return F.struct(
        (amount * F.when(F.right(label, F.lit(2)) == "tb", 1024).otherwise(1)).alias("gigabytes"),
        label.alias("label"),
    )


def with_identity(df: DataFrame, title: str, out: str = "identity") -> DataFrame:
    """Add the query-free part of the identity as one struct column."""
    c = F.col
    staged = df.withColumn("_t", rule_text(c(title)))
    # A title without the bar is its own head and is not read twice.
    head = F.when(c(title).contains("|"), rule_text(F.substring_index(c(title), "|", 1)))
    staged = staged.withColumn("_head", F.coalesce(F.nullif(head, F.lit("")), c("_t")))
    staged = (
        staged.withColumn("_words", F.filter(F.split(c("_head"), " "), lambda w: w != ""))
        .withColumn("_colours", F.regexp_extract_all(c("_t"), F.lit(COLOUR), F.lit(1)))
        .withColumn(
            "_ram",
            F.nullif(
                F.concat(F.regexp_extract(c("_t"), RAM, 1), F.regexp_extract(c("_t"), RAM, 2)), F.lit("")
            ),
        )
    )
    stated_ram = F.concat(c("_ram"), F.lit("gb"))
    sizes = F.array_sort(
        F.transform(F.regexp_extract_all(c("_t"), F.lit(MEMORY), F.lit(0)), _sized)
    )
    staged = staged.withColumn(
        "_sizes", F.filter(sizes, lambda s: c("_ram").isNull() | (s["label"] != stated_ram))
    )
    # Two sizes and no word "ram": the smaller is RAM when it can be.
    implied = c("_ram").isNull() & (F.size("_sizes") >= 2) & (F.get("_sizes", 0)["gigabytes"] <= 24)
    ram = F.when(c("_ram").isNotNull(), stated_ram).when(implied, F.get("_sizes", 0)["label"])

    plain = F.regexp_replace(c("_t"), r"\b[2-5]g\b", " ")
    amount = F.concat(F.regexp_extract(plain, QUANTITY, 1), F.regexp_extract(plain, QUANTITY, 2))
    quantity = F.when(~amount.isin("", "2g", "3g", "4g", "5g"), amount)

    leading = F.get(F.filter(F.slice("_words", 1, 3), lambda w: w.isin(vocab.RULE_BRANDS)), 0)
    implied_brand = F.get(F.filter(c("_words"), lambda w: w.isin(list(vocab.RULE_BRAND_WORDS))), 0)
    brand = F.coalesce(leading, lookup(implied_brand, vocab.RULE_BRAND_WORDS))
    staged = staged.withColumn("_brand", lookup(brand, vocab.RULE_BRAND_FOLDS, brand))

    # A column of its own: inside the filter it would be split anew for every word.
    staged = staged.withColumn("_colour_words", F.split(F.array_join("_colours", " "), " "))
    bare = F.transform(c("_words"), lambda w: F.btrim(w, F.lit(".'")))
    telling = F.filter(
        bare,
        lambda w: (w != "")
        & ~w.isin(vocab.RULE_FILLER_WORDS)
        & ~F.array_contains("_colour_words", w)
        & ~F.coalesce(w == c("_brand"), F.lit(False))
        & ~w.rlike(r"^(?:\d+(?:\.\d+)?(?:gb|tb)|5g|4g)$|\d{5,}"),
    )
    staged = staged.withColumn("_telling", telling)
    is_model = lambda w: w.isin(vocab.RULE_VARIANT_WORDS) | w.rlike(r"(?U)\d")
    staged = staged.withColumn("_model", F.filter(c("_telling"), is_model))
    family = F.filter(c("_telling"), lambda w: (F.length(w) > 1) & ~F.array_contains("_model", w))

    first = F.get("_words", 0)
    spare = (
        c("_head").rlike(vocab.SPARE_PATTERN)
        | c("_head").startswith("for ")
        | (c("_head").rlike(r"\b(display|screen)\b") & ~c("_t").rlike(r"\d+\s?(gb|tb)\b"))
    )
    colour = F.replace(F.try_element_at("_colours", F.lit(-1)), F.lit("gray"), F.lit("grey"))
    identity = F.struct(
        c("_brand").alias("brand"),
        F.array_sort(F.array_distinct("_model")).alias("model"),
        F.array_sort(F.array_distinct(family)).alias("family"),
        F.try_element_at("_sizes", F.lit(-1))["label"].alias("storage"),
        ram.alias("ram"),
        colour.alias("colour"),
        F.when(c("_t").rlike(vocab.CONDITION_PATTERN), "refurbished").otherwise("new").alias("condition"),
        quantity.alias("quantity"),
        F.coalesce(
            c("_brand"), F.when((F.length(first) > 1) & ~first.rlike(r"^(?U)\d"), first)
        ).alias("brand_guess"),
        F.arrays_overlap("_telling", _literal_array(vocab.RULE_ACCESSORY_WORDS)).alias("accessory_word"),
        F.coalesce(spare, F.lit(False)).alias("spare"),
    )
    drop = ["_t", "_head", "_words", "_colours", "_ram", "_sizes", "_brand", "_telling", "_model", "_colour_words"]
    return staged.withColumn(out, identity).drop(*drop)


def is_accessory(identity: Column, query: Column) -> Column:
    """Accessory or spare part that the query (its word array) does not ask for."""
    asks_accessory = F.arrays_overlap(query, _literal_array(vocab.RULE_ACCESSORY_WORDS))
    asks_spare = F.arrays_overlap(query, _literal_array(vocab.SPARE_QUERY_WORDS))
    return (identity["accessory_word"] & ~asks_accessory) | (identity["spare"] & ~asks_spare)


def specificity(identity: Column) -> Column:
    return sum(
        (identity[k].isNotNull().cast("int") for k in ("ram", "colour", "quantity")),
        identity["storage"].isNotNull().cast("int"),
    )


def display_size(label: Column) -> Column:
    """``128gb`` -> ``128 GB``."""
    return F.when(
        label.rlike(r"\d(gb|tb)$"),
        F.concat(F.regexp_extract(label, r"^(.*\d)(gb|tb)$", 1), F.lit(" "), F.upper(F.right(label, F.lit(2)))),
    ).otherwise(label)


def group_attributes(identity: Column) -> Column:
    """Attributes shown for a rule-matched group, taken from its lead listing."""
    shown = F.create_map(
        F.lit("brand"), identity["brand"],
        F.lit("storage"), display_size(identity["storage"]),
        F.lit("ram"), F.concat(display_size(identity["ram"]), F.lit(" RAM")),
        F.lit("colour"), identity["colour"],
        F.lit("condition"), F.nullif(identity["condition"], F.lit("new")),
        F.lit("quantity"), identity["quantity"],
    )
    return F.map_filter(shown, lambda k, v: v.isNotNull())
