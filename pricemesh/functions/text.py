"""Title normalisation, tokens and canonical titles as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pricemesh import vocab


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends trimmed (no-break blanks included)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def digest(c: Column) -> Column:
    """Join key standing for a long text.

    Declared never null: for a nullable key a join adds a null test, which the
    optimizer writes out in full, text rules and all, below every column.
    """
    return F.coalesce(F.sha2(c, 256), F.lit(""))


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Literal map lookup; values outside the table fall back to ``default``."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hit = F.try_element_at(entries, c)
    return hit if default is None else F.coalesce(hit, default)


def _apply(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), rules, c)


def normalize_title(title: Column) -> Column:
    lowered = F.translate(F.lower(title), "é’", "e'")
    padded = F.concat(F.lit(" "), lowered, F.lit(" "))
    aliased = reduce(
        lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), vocab.TITLE_ALIASES, padded
    )
    return squeeze(
        _apply(
            aliased,
            [
                (r"(?U)(\d)\s+(ml|g|l|ltrs|ltr|w|gb)\b", "$1$2"),
                (r"(?U)\bltrs?\b", "l"),
                (r"(?U)\b(\d{2})w(?:\s*x\s*\d{2}l)?\b", "$1"),
                (r"(?U)\b(uk|size)\s+(\d{1,2})\b", "$2"),
                (r"[()\[\],/|]", " "),
                (r"(?U)\s+-\s+", " "),
                (r"[^a-z0-9.'\-+ ]", " "),
            ],
        )
    )


def tokens_of(normalized: Column) -> Column:
    """Tokens of an already normalised text: order and repeats kept."""
    genders = {w: g for g, ws in vocab.GENDER_WORDS.items() for w in ws}
    bare = F.transform(F.split(normalized, " "), lambda w: F.btrim(w, F.lit(".'-")))
    kept = F.filter(bare, lambda w: (w != "") & ~w.isin(vocab.STOPWORDS))

    def singular(w: Column) -> Column:
        plural = (F.length(w) > 3) & w.rlike("[^s0-9]s$")
        return F.when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.transform(
        kept, lambda w: F.when(w.isin(list(genders)), lookup(w, genders)).otherwise(singular(w))
    )


def tokens(text: Column) -> Column:
    return tokens_of(normalize_title(text))


def product_text(title: Column, attributes: Column) -> Column:
    """Title followed by the known attributes in a fixed order."""
    return F.concat_ws(
        " ", title, *[F.try_element_at(attributes, F.lit(k)) for k in vocab.TEXT_ATTRIBUTES]
    )


def search_text(title: Column, attributes: Column) -> Column:
    return F.array_join(tokens(product_text(title, attributes)), " ")


def clean_title(title: Column) -> Column:
    """Title shown for a scored group: bracketed parts and a trailing size dropped."""
    stripped = _apply(
        title,
        [
            (r"(?U)\s*\([^)]*\)\s*", " "),
            (r"(?iU)\s*,\s*[^,]*\d+\s*(w|g|ml|l|ltrs)?\s*$", ""),
        ],
    )
    return F.btrim(squeeze(stripped), F.lit(" -,"))


def clean_rule_title(title: Column) -> Column:
    """Title shown for a rule-matched group."""
    stripped = F.regexp_replace(title, r"(?U)\s*\[[^\]]*\]\s*", " ")
    return F.btrim(squeeze(stripped), F.lit(" -|,"))


def title_key(title: Column) -> Column:
    """Two cards with the same key look alike to a reader."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def query_key(query: Column, location: Column) -> Column:
    """Key of a query at a location: both whole, so that no two share a key."""
    return F.concat(squeeze(F.lower(query)), F.lit("|"), location)


def row_hash(rows: DataFrame, columns: list[str]) -> Column:
    """A hash of the named columns; maps, which cannot be hashed, go in as sorted entries."""
    maps = {f.name for f in rows.schema if isinstance(f.dataType, MapType)}
    plain = lambda n: F.array_sort(F.map_entries(F.col(f"`{n}`"))) if n in maps else F.col(f"`{n}`")
    return F.xxhash64(*[plain(n) for n in columns])
