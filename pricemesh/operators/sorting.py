"""The eight sort orders of listings and of groups, and ranks inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemesh import vocab
from pricemesh.session import cut_lineage

# column, ascending
_LISTING = {
    "price_asc": [("price", True)],
    "price_desc": [("price", False)],
    "delivery_fastest": [("_unavailable", True), ("delivery_days", True), ("price", True)],
    "delivery_slowest": [("delivery_days", False)],
    "rating_desc": [("rating", False), ("review_count", False)],
    "rating_asc": [("rating", True)],
    "discount_desc": [("discount_percentage", False)],
    "relevance": [("relevance", False), ("rating", False)],
}
_GROUP = {
    "price_asc": [("price_min", True)],
    "price_desc": [("price_max", False)],
    "delivery_fastest": [("_fastest", True), ("price_min", True)],
    "delivery_slowest": [("slowest_days", False)],
    "rating_desc": [("rating_max", False)],
    "rating_asc": [("rating_min", True)],
    "discount_desc": [("discount_max", False)],
    "relevance": [("relevance", False), ("listing_count", False)],
}
_DERIVED = {
    "_unavailable": lambda: (F.col("availability") == "out_of_stock").cast("int"),
    "_fastest": lambda: F.coalesce(F.col("fastest_days"), F.lit(vocab.UNKNOWN_DELIVERY_DAYS)),
}


def sort_options() -> dict[str, str]:
    return dict(vocab.SORT_KEYS)


def check_sort(sort: str) -> str:
    """Requests with an unknown sort are refused; the sorts below fall back to relevance."""
    if sort not in vocab.SORT_KEYS:
        raise ValueError(f"Unknown sort '{sort}'. Options: {', '.join(vocab.SORT_KEYS)}")
    return sort


def _column(name: str) -> Column:
    return _DERIVED[name]() if name in _DERIVED else F.col(name)


def _order(keys: list[tuple[str, bool]], tie: str) -> list[Column]:
    return [_column(n).asc() if up else _column(n).desc() for n, up in keys] + [F.col(tie).asc()]


def listing_order(sort: str, tie: str = "position") -> list[Column]:
    return _order(_LISTING.get(sort, _LISTING["relevance"]), tie)


def group_order(sort: str, tie: str = "group_position") -> list[Column]:
    return _order(_GROUP.get(sort, _GROUP["relevance"]), tie)


def group_columns(sort: str) -> list[str]:
    """What ``sort_groups`` reads of a group."""
    read = {"_fastest": "fastest_days"}
    return [read.get(n, n) for n, _ in _GROUP.get(sort, _GROUP["relevance"])] + ["group_position"]


def listing_key(sort: str, tie: str = "position") -> Column:
    """The listing order as one ascending struct, for ``min_by``."""
    keys = _LISTING.get(sort, _LISTING["relevance"])
    return F.struct(*[_column(n) if up else -_column(n) for n, up in keys], F.col(tie))


def _requested(sort: Column, orders: dict[str, list[tuple[str, bool]]]) -> list[Column]:
    """Ascending columns that order every row by the sort its own ``sort`` column names.

    A sort is at most three numbers; each becomes (nulls last, number), negated
    where it falls, so rows of different sorts share one range partitioning.
    """
    out = []
    for depth in range(max(len(keys) for keys in orders.values())):
        parts = {}
        for name, keys in orders.items():
            column, up = keys[depth] if depth < len(keys) else (None, True)
            value = F.lit(0.0) if column is None else _column(column).cast("double")
            parts[name] = (F.lit(0) if up else value.isNull().cast("int"), value if up else -value)
        for place in (0, 1):
            chosen = F
            for name, part in parts.items():
                chosen = chosen.when(sort == name, part[place])
            out.append(chosen.otherwise(parts["relevance"][place]))
    return out


def requested_listing_key(sort: Column, tie: str = "position") -> Column:
    """``listing_key`` with the sort read from the row; unknown sorts fall back to relevance."""
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_requested(sort, _LISTING))], F.col(tie))


def requested_group_order(sort: Column, tie: str = "group_position") -> list[Column]:
    """``group_order`` with the sort read from the row."""
    return [k.asc() for k in _requested(sort, _GROUP)] + [F.col(tie).asc()]


def rank_within(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Row number inside each group, also when one group holds a large part of all rows.

    Rows are range-partitioned on group *and* order, so a large group spreads
    over many partitions; each partition numbers its own rows and adds the
    number of rows of the group in the partitions before it.  The checkpoint
    fixes the partition numbers, so a lost executor cannot change them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = [F.col(b) for b in by] + order
    placed = cut_lineage(
        df.repartitionByRange(partitions, *ranges).withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part", *by)
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    local = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(offsets, ["_part", *by])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_part", "_local", "_before")
    )


def sort_listings(listings: DataFrame, by: list[str], sort: str) -> DataFrame:
    return rank_within(listings, by, listing_order(sort))


def sort_groups(groups: DataFrame, by: list[str], sort: str) -> DataFrame:
    return rank_within(groups, by, group_order(sort))
