"""Store names: the allow-list, slugs, links and search addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.functions.text import lookup

_SLUG_OF_ALIAS = {alias: row[0] for alias, row in vocab.STORE_ALIASES.items()}
_NAME_OF_SLUG = {slug: name for _, slug, name, _ in vocab.STORES}
_COLOUR_OF_SLUG = {slug: colour for _, slug, _, colour in vocab.STORES}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def store_key(source: Column) -> Column:
    """Store name without tagline, host prefix and domain ending."""
    s = _strip(F.coalesce(source, F.lit("")))
    s = _strip(F.lower(F.regexp_replace(s, r"(?Us)\s+[-–|]\s+.*$", "")))
    s = F.regexp_replace(s, r"^(www|buy|shop|store|m)\.", "")
    return _strip(F.regexp_replace(s, r"\.(com|in|co\.in|shop|store)$", ""))


def with_store(df: DataFrame, source: str) -> DataFrame:
    """Add ``listed_slug`` (null off the allow-list), ``store_slug``, ``store_name``, ``store_colour``."""
    c = F.col
    listed = lambda k: F.when(~k.isin(vocab.AMBIGUOUS_STORE_WORDS), lookup(k, _SLUG_OF_ALIAS))
    staged = (
        df.withColumn("_key", store_key(c(source)))
        .withColumn("_first", F.substring_index("_key", " ", 1))
        .withColumn("_two", F.substring_index("_key", " ", 2))
    )
    own_shop = c("_key").rlike(r"^(apple|samsung) ") & c("_key").rlike(r"(store|shop|india)$")
    staged = staged.withColumn(
        "listed_slug",
        F.coalesce(
            lookup(c("_key"), _SLUG_OF_ALIAS), listed(c("_two")), listed(c("_first")),
            F.when(own_shop, lookup(c("_first"), _SLUG_OF_ALIAS)),
        ),
    )
    plain = F.btrim(F.regexp_replace(F.coalesce(F.nullif("_key", F.lit("")), F.lit("store")), "[^a-z0-9]+", "-"), F.lit("-"))
    shown = _strip(F.coalesce(F.nullif(c(source), F.lit("")), F.lit("Store")))
    return (
        staged.withColumn(
            "store_slug",
            F.coalesce("listed_slug", F.nullif(plain, F.lit("")), F.lit("store")),
        )
        .withColumn("store_name", F.coalesce(lookup(c("listed_slug"), _NAME_OF_SLUG), shown))
        .withColumn(
            "store_colour", lookup(c("listed_slug"), _COLOUR_OF_SLUG, F.lit(vocab.OTHER_STORE_COLOUR))
        )
        .drop("_key", "_first", "_two")
    )


def base_url(link: Column) -> Column:
    host = F.try_parse_url(link, F.lit("HOST"))
    return F.coalesce(F.concat(F.lit("https://"), host), F.lit(""))


def search_url(slug: Column, title: Column) -> Column:
    """Where to look for the first eight title words in the store itself."""
    words = F.filter(F.split(title, r"(?U)\s+"), lambda w: w != "")
    q = F.url_encode(F.array_join(F.slice(words, 1, 8), " "))
    template = lookup(slug, vocab.STORE_SEARCH_URLS, F.lit(vocab.ANY_STORE_SEARCH_URL))
    return F.replace(template, F.lit("{q}"), q)


def best_link(product_url: Column, feed_link: Column, slug: Column, title: Column) -> Column:
    """Direct store link, else the link a feed gave, else a search in the store."""
    is_direct = (product_url != "") & ~product_url.startswith("/api/go/")
    return F.coalesce(
        F.when(is_direct, product_url), F.nullif(feed_link, F.lit("")), search_url(slug, title)
    )
