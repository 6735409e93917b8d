"""Mixing sources to target weights along a time-varying curriculum, by DataFrame functions alone.

Every source has a weight schedule: knots ``(at, weight)`` over training time 0 to
1, linear in between.  The integral of a schedule is the source's share of the mix;
shares become target words, and a target that would repeat a source too often stops
there while the excess is shared again.  The cumulative demand of a source, its
schedule's running integral scaled to the target, is then inverted: a document that
begins after ``x`` words of its source is met at the time at which ``x`` words of
that source are due.  Sorting all documents by that time gives the training order.

How it scales: texts are read once, for their sizes.  Inside a source, documents
follow each other in the order of a digest; its leading digits deal a source to
4,096 cells, so a source with a third of all rows is summed in that many parts and
the only window over a whole source sees cells, never rows.  Sources are ranked by
range partitions and offsets, and the resharing is one aggregate per round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricemesh.llm.common import partitions, written

Knots = Sequence[tuple[float, float]]
CELL_DIGITS = 3  # leading hex digits of the digest that name a cell

#: Integrals 3, 1 and 2: one source fades in, one is steady, one fades out.
FADING = (((0.0, 1.5), (1.0, 4.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 3.0), (0.5, 2.0), (1.0, 1.0)))


@dataclass(frozen=True)
class MixConfig:
    share: float = 1.5                       # words of the mix, in words of all documents
    repeats: int = 2                         # most times that a document is taken
    schedules: Sequence[Knots] = FADING      # by place of the source in code-point order, repeating; null comes last


def word_count(text: Column) -> Column:
    """Words of anything but ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _checked(config: MixConfig) -> None:
    if not 0 <= config.share <= config.repeats or config.repeats < 1 or not config.schedules:
        raise ValueError("the mix cannot hold more words than all documents repeated")
    for knots in config.schedules:
        times = [t for t, _ in knots]
        if len(knots) < 2 or times != sorted(set(times)) or (times[0], times[-1]) != (0, 1) or min(w for _, w in knots) < 0 or not any(w for _, w in knots):
            raise ValueError(f"no schedule over 0 to 1: {knots}")


def _schedule(place: Column, config: MixConfig) -> Column:
    """The knots of the source at that place, as array<struct<at, weight>>."""
    each = [F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in knots]) for knots in config.schedules]
    return F.element_at(F.array(*each), (place % len(each) + 1).cast("int"))


def integrals(knots: Column) -> Column:
    """Area of a schedule up to each of its knots, by trapezoids."""
    step = lambda k: (knots[k]["at"] - knots[k - 1]["at"]) * (knots[k]["weight"] + knots[k - 1]["weight"]) / 2
    parts = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), step)
    return F.transform(F.sequence(F.lit(0), F.size(knots) - 1), lambda n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0.0), lambda total, x: total + x))


def time_of(area: Column, knots: Column, areas: Column) -> Column:
    """When a schedule has run up that area: the integral inverted on the piece between two knots that holds it."""
    k = F.least(F.greatest(F.size(F.filter(areas, lambda a: a <= area)), F.lit(1)), F.size(knots) - 1)
    left, right, rest = F.element_at(knots, k), F.element_at(knots, k + 1), area - F.element_at(areas, k)
    slope = (right["weight"] - left["weight"]) / (right["at"] - left["at"])
    root = F.sqrt(F.greatest(left["weight"] * left["weight"] + 2 * slope * rest, F.lit(0.0)))
    return left["at"] + F.when(rest > 0, F.coalesce(F.try_divide(2 * rest, left["weight"] + root), F.lit(0.0))).otherwise(0.0)


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code-point order, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(partitions(sources.sparkSession), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "mix-sources")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row per partition
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + F.col("offset")
    return dealt.join(offsets, "part").withColumn("place", place).drop("part", "offset")


def _targets(sources: DataFrame, config: MixConfig) -> DataFrame:
    """Sources with their target: shares by schedule, stopped at the most repeats, the excess shared again until none is above."""
    placed = _ranked(sources).withColumn("knots", _schedule(F.col("place"), config)).withColumn("areas", integrals(F.col("knots")))
    ready = written(placed.withColumn("weight", F.element_at("areas", -1)).withColumn("most", config.repeats * F.col("source_size")), "mix-weights")
    total = ready.agg(F.sum("source_size")).first()[0] or 0
    full, level = F.lit(False), 0.0
    while True:
        # Sources that this round fills up keep their most; what they leave goes to the others.
        state = ready.agg(
            F.sum(F.when(full, F.col("most"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count_if(full).alias("n"),
        ).first()
        level = (config.share * total - (state["held"] or 0)) / state["weights"] if state["weights"] else 0.0
        full = full | (F.col("weight") * F.lit(level) > F.col("most"))
        if ready.filter(full).count() == state["n"]:
            break
    return ready.withColumn("target", F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix(df: DataFrame, id_col: str, source_col: str, text_col: str, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per input row: ``id_col``, source, size, source_size, target, taken, position and placements.

    ``placements`` lists every time the document is met: array<struct<position, words>>,
    by position; ``position`` is the first of them, ``taken`` the sum of their words.
    The document at which a source's target is reached is met with its first words
    only, so each source gives its target to the word.  Rows are range-sorted by
    position; documents that are not taken come first, with a null position.

    A null source is a source of its own, the last one.  Null and empty texts and
    texts without words have size 0 and are never met.  Ids may repeat or be null:
    every row is a document; which of several equal ones comes first makes no
    difference.  Texts of any length are counted whole.  An empty table gives an
    empty result; other columns are ignored.
    """
    _checked(config)
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("size")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # no nulls, so joins and windows agree on one partitioning
    rows = written(rows.select("id", "source", "size", key.alias("key"), digest.alias("digest")).withColumn("cell", F.substring("digest", 1, CELL_DIGITS)), "mix-rows")

    cells = rows.groupBy("key", "cell").agg(F.first("source").alias("source"), F.sum("size").alias("n"))
    cells = written(cells, "mix-cells")
    sources = _targets(cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("n").alias("source_size")), config)
    running = F.sum("n").over(W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    begun = cells.select("key", "cell", F.coalesce(running, F.lit(0)).alias("begun"))
    begun = begun.join(sources.select("key", "source_size", "target", "knots", "areas"), "key")

    # Where each document begins among the words of its source; epochs follow each other.
    inside = F.sum("size").over(W.partitionBy("key", "cell").orderBy("digest", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = rows.join(begun, ["key", "cell"]).withColumn("first", F.col("begun") + inside)
    goal = F.least(F.round("target").cast("long"), config.repeats * F.col("source_size"))
    placed = placed.withColumn("goal", goal)

    def met(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("first")
        area = at / F.greatest(F.col("goal"), F.lit(1)) * F.element_at("areas", -1)
        return F.struct(time_of(area, F.col("knots"), F.col("areas")).alias("position"), F.greatest(F.least(F.col("size"), F.col("goal") - at), F.lit(0)).cast("long").alias("words"))

    every = F.transform(F.sequence(F.lit(0), F.lit(config.repeats - 1)), met)
    placed = placed.withColumn("placements", F.filter(every, lambda p: p["words"] > 0))
    out = placed.select(
        F.col("id").cast(kind).alias(id_col), "source", "size", "source_size", "target",
        reduce(lambda a, k: a + F.coalesce(F.get("placements", F.lit(k))["words"], F.lit(0)), range(config.repeats), F.lit(0)).cast("long").alias("taken"),
        F.get("placements", F.lit(0))["position"].alias("position"), "placements",
    )
    order = [F.col("position").asc_nulls_first(), F.col(f"`{id_col}`").asc_nulls_first()]
    return out.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)


def training_order(mixed: DataFrame, id_col: str) -> DataFrame:
    """Every placement of a mix in training order: position, ``id_col`` and the words to take, range-sorted."""
    met = mixed.select(F.col(f"`{id_col}`"), F.explode("placements").alias("p")).select("p.position", f"`{id_col}`", "p.words")
    return met.repartitionByRange(partitions(mixed.sparkSession), "position", f"`{id_col}`").sortWithinPartitions("position", f"`{id_col}`")
