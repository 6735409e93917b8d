"""Attributes read from titles, and the attributes a store supplies itself."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.functions.text import lookup, normalize_title

NETWORK = r"\b[2345]g\b"
RAM = r"\b(\d{1,2})gb\s*ram\b|\bram\s*(\d{1,2})gb\b"
MEMORY = r"\b(\d+(?:\.\d+)?)\s?(gb|tb)\b"


def _group(text: Column, pattern: str, n: int) -> Column:
    """Regex group or null (Spark gives '' where nothing matched)."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _strip_lower(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")


def canonical_brand(brand: Column) -> Column:
    b = F.replace(_strip_lower(brand), F.lit("é"), F.lit("e"))
    b = lookup(b, vocab.BRAND_ALIASES, b)
    return F.when(~b.isin(vocab.GENERIC_BRANDS), b)


def canonical_category(category: Column) -> Column:
    c = _strip_lower(category)
    return F.when(category != "", lookup(c, vocab.CATEGORY_ALIASES, c))


def first_option(text: Column, options: list[str]) -> Column:
    """Longest option first, ties in list order, whole words only."""
    ordered = sorted(options, key=len, reverse=True)
    return F.coalesce(*[F.when(text.rlike(rf"\b{re.escape(o)}\b"), o) for o in ordered])


def _memory_sizes(text: Column) -> Column:
    """``struct(gigabytes, label)`` for every memory size in the text."""
    number = lambda m: F.regexp_extract(m, r"[\d.]+", 0)
    unit = lambda m: F.right(m, F.lit(2))
    return F.transform(
        F.regexp_extract_all(text, F.lit(MEMORY), F.lit(0)),
        lambda m: F.struct(
            (number(m).cast("double") * F.when(unit(m) == "tb", 1024).otherwise(1)).alias("gigabytes"),
            F.concat_ws(" ", number(m), unit(m)).alias("label"),
        ),
    )


def inferred_attributes(text: Column) -> dict[str, Column]:
    """Attributes from normalised title plus description, by name."""
    colour = first_option(text, vocab.COLOURS)
    fit = first_option(text, vocab.FITS)
    gender = F.coalesce(
        *[
            F.when(text.rlike(r"\b(" + "|".join(words) + r")\b"), g)
            for g, words in vocab.GENDER_WORDS.items()
        ]
    )
    plain = F.regexp_replace(text, NETWORK, " ")
    ram = F.concat(F.coalesce(_group(plain, RAM, 1), _group(plain, RAM, 2)), F.lit(" gb"))
    storage = F.array_max(
        F.filter(_memory_sizes(plain), lambda s: ram.isNull() | (s["label"] != ram))
    )["label"]
    quantity = r"\b(\d+(?:\.\d+)?)(ml|g|kg|l)\b"
    letter = _group(F.replace(plain, F.lit(" size"), F.lit("")), r"\b(xs|s|m|l|xl|xxl|free)\b(?![a-z])", 1)
    return {
        "colour": lookup(colour, vocab.COLOUR_ALIASES, colour),
        "material": first_option(text, vocab.MATERIALS),
        "fit": lookup(fit, vocab.FIT_ALIASES, fit),
        "gender": gender,
        "ram": ram,
        "storage": storage,
        "quantity": F.when(
            plain.rlike(quantity),
            F.concat_ws(" ", F.regexp_extract(plain, quantity, 1), F.regexp_extract(plain, quantity, 2)),
        ),
        "wattage": F.concat(_group(plain, r"\b(\d+)w\b", 1), F.lit("W")),
        "size": F.coalesce(
            _group(plain, r"\b(?:uk|size)\s*(\d{1,2})\b", 1),
            _group(plain, r"\b(\d{2})w\b", 1),
            F.when(~letter.isin("s", "m", "l"), letter),
        ),
    }


def supplied_attributes(attributes: Column) -> Column:
    """A store's own attribute map with canonical keys and values; last repeat wins."""

    def canonical(key: Column, raw: Column) -> Column:
        value = F.replace(_strip_lower(raw), F.lit("é"), F.lit("e"))
        number_unit = lambda p: F.when(
            value.rlike("^" + p),
            F.concat_ws(" ", F.regexp_extract(value, "^" + p, 1), F.regexp_extract(value, "^" + p, 2)),
        ).otherwise(value)
        return (
            F.when(key == "colour", lookup(value, vocab.COLOUR_ALIASES, value))
            .when(key == "fit", lookup(value, vocab.FIT_ALIASES, value))
            .when(key == "size", F.regexp_replace(value, r"^(uk|size)\s*", ""))
            .when(key == "quantity", number_unit(r"(\d+(?:\.\d+)?)\s*([a-z]+)"))
            .when(key.isin("storage", "ram"), number_unit(r"(\d+(?:\.\d+)?)\s*(gb|tb)"))
            .when(key == "shade", F.coalesce(_group(value, r"\b([a-z]{1,3}\d{1,3})\b", 1), value))
            .when(key == "model", F.regexp_replace(value, r"\s+", " "))
            .otherwise(value)
        )

    def entry(e: Column) -> Column:
        key = F.lower(e["key"])
        key = F.when(key == "color", "colour").otherwise(key)
        return F.struct(key.alias("key"), canonical(key, e["value"]).alias("value"))

    stated = F.filter(
        F.map_entries(attributes), lambda e: e["value"].isNotNull() & (e["value"] != "")
    )
    entries = F.filter(F.transform(stated, entry), lambda e: ~e["key"].isin("brand", "category"))
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def with_attributes(listings: DataFrame, out: str = "attributes") -> DataFrame:
    """Add the attribute map: supplied values win over values read from the title."""
    text = normalize_title(F.concat_ws(" ", F.col("title"), F.coalesce(F.col("description"), F.lit(""))))
    staged = (
        listings.withColumn("_text", text)
        .withColumn("_supplied", supplied_attributes(F.col("product_attributes")))
    )
    found = inferred_attributes(F.col("_text"))
    inferred = F.map_filter(
        F.create_map(*[x for k, c in found.items() for x in (F.lit(k), c)]),
        lambda k, v: v.isNotNull() & ~F.map_contains_key(F.col("_supplied"), k),
    )
    fixed = F.map_filter(
        F.create_map(
            F.lit("brand"), canonical_brand(F.col("brand")),
            F.lit("category"), canonical_category(F.col("category")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return staged.withColumn(out, F.map_concat(F.col("_supplied"), inferred, fixed)).drop("_text", "_supplied")


def public_attributes(attributes: Column) -> Column:
    """Attributes fit for display: names starting with ``_`` are internal."""
    return F.map_filter(attributes, lambda k, v: ~k.startswith("_"))
