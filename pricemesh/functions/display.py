"""Numbers and labels as shown to a reader, and small value rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.functions.text import lookup


def discount(price: Column, mrp: Column) -> Column:
    off = F.greatest(F.lit(0.0), (mrp - price) / mrp * 100)
    return F.when(mrp > 0, F.round(off, 1)).otherwise(0.0)


def is_converted_price(price: Column) -> Column:
    """Prices with a fraction come from a foreign currency."""
    return F.round(price, 2) != F.round(price, 0)


def number_or(value: Column, default: Column | float = 0.0) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(value.cast("string").try_cast("double"), fallback)


def compact_number(n: Column) -> Column:
    plain = lambda c, d: F.replace(F.format_number(F.round(c, d), d), F.lit(","), F.lit(""))
    return (
        F.when(n >= 100000, F.concat(plain(n / 100000, 1), F.lit("L")))
        .when(n >= 10000, F.concat(plain(n / 1000, 0), F.lit("k")))
        .when(n >= 1000, F.concat(plain(n / 1000, 1), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def capitalised(value: Column) -> Column:
    """Every word start (ASCII letters, digits and _ make words) in capitals, all else as it is."""
    pieces = F.split(value, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    raised = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[A-Za-z0-9_]"), raised(p)).otherwise(p)), "")


def subtitle(attributes: Column, parts: int = 4) -> Column:
    """The first ``parts`` telling attribute values, capitalised unless they have a digit."""
    values = F.array(*[F.try_element_at(attributes, F.lit(k)) for k in vocab.SUBTITLE_ATTRIBUTES])
    shown = F.slice(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), 1, parts)
    capital = lambda v: F.when(v.rlike(r"\d"), v).otherwise(capitalised(v))
    return F.array_join(F.transform(shown, capital), " · ")


def location_pincode(pincode: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(pincode, F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 6, digits)


def canonical_city(district: Column) -> Column:
    name = F.lower(district)
    return lookup(name, vocab.CITY_ALIASES, name)


def saving(price_min: Column, price_max: Column) -> Column:
    return F.when(price_max > price_min, price_max - price_min)
