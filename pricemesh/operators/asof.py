"""As-of joins: every request meets the latest state of its key at or before its own time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemesh.functions.text import row_hash
from pricemesh.session import cut_lineage


def latest_before(requests: DataFrame, states: DataFrame, key: str, at: str, since: str, out: str = "state") -> DataFrame:
    """``requests`` with the struct ``out``: the row of ``states`` with the same ``key`` and the greatest ``since`` <= ``at``.

    One row per request, repeated requests included; ``out`` is null without a
    key, without a time or where no state is old enough.  States without key or
    time serve nobody.  Of states with one key and time one serves all requests,
    chosen by a digest of the row.  Either table may be empty.

    Requests and states are merged in the order (key, time) by range, so a hot
    key spreads over many partitions.  Each partition carries the last state
    along its own rows and takes over the last one of the partitions before it:
    one row per key and partition.  The checkpoint fixes partition numbers.
    """
    c = F.col
    usable = states.filter(c(key).isNotNull() & c(since).isNotNull())
    asked = requests.select(
        c(key).alias("_key"), c(at).alias("_at"), F.lit(1).alias("_kind"),
        F.struct(*[c(f"`{n}`") for n in requests.columns]).alias("_request"), row_hash(requests, requests.columns).alias("_tie"),
    )
    known = usable.select(
        c(key).alias("_key"), c(since).alias("_at"), F.lit(0).alias("_kind"),
        F.struct(*[c(f"`{n}`") for n in states.columns]).alias("_state"), row_hash(states, states.columns).alias("_tie"),
    )
    merged = asked.unionByName(known, allowMissingColumns=True)
    partitions = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        merged.repartitionByRange(partitions, "_key", "_at", "_kind", "_tie").withColumn("_part", F.spark_partition_id())
    )
    order = F.when(c("_state").isNotNull(), F.struct("_at", "_tie"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy("_key", "_part")
        .agg(F.max_by("_state", order).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
        .filter(c("_key").isNotNull() & c("_carried").isNotNull())
        .select("_key", "_part", "_carried")
    )
    upto = Window.partitionBy("_key", "_part").orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_own", F.last("_state", ignorenulls=True).over(upto))
        .filter("_kind = 1")
        .join(carried, ["_key", "_part"], "left")
        .withColumn("_found", F.when(c("_at").isNotNull(), F.coalesce("_own", "_carried")))
        .select("_request.*", c("_found").alias(out))
    )
