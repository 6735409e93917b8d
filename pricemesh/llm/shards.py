"""Minimax contiguous partition of ordered atomic groups into shards.

Rows are laid out in the order of (group key, id); a group is never cut.  The
layout is a range-partitioned sort, so one group with a third of all rows is
spread over many tasks.  Each task writes its running sums, a few numbers per
task turn them into global positions, and the capacity is found on summaries
of group starts whose size does not grow with the table (see ``_Starts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemesh.llm.common import partitions, scratch

BLOCKS = 1 << 16  # most summary blocks that one request brings to the driver


class _Starts:
    """Known group starts, and the open gaps between them that may hide more.

    ``low`` gives a start that surely exists, ``high`` a bound no start beyond
    which can fit.  Where both agree on feasibility the answer is exact;
    otherwise the gaps that were touched are opened further.
    """

    def __init__(self, total: int):
        self.total = total
        self.known = np.array([0, total], dtype=np.int64)
        self.hidden = np.array([True, False])  # hidden[i]: starts may lie between known[i] and known[i + 1]

    def add(self, mins: np.ndarray, maxs: np.ndarray, counts: np.ndarray, opened: np.ndarray) -> None:
        """Blocks of starts found inside the opened gaps (indices into ``known``)."""
        self.hidden[opened] = False
        points = np.concatenate([self.known, mins, maxs])
        flags = np.concatenate([self.hidden, (counts > 2), np.zeros(len(maxs), dtype=bool)])
        order = np.argsort(points, kind="stable")
        points, flags = points[order], flags[order]
        first = np.concatenate([[True], points[1:] != points[:-1]])
        self.hidden = np.logical_or.reduceat(flags, np.flatnonzero(first))
        self.known = points[first]

    def _at(self, x: int) -> int:
        return int(np.searchsorted(self.known, x, side="right")) - 1

    def low(self, x: int) -> int:
        return int(self.known[self._at(x)])

    def high(self, x: int, touched: set[int] | None = None) -> int:
        i = self._at(x)
        if i < len(self.known) - 1 and self.hidden[i] and x > self.known[i]:
            if touched is not None:
                touched.add(i)
            return x
        return int(self.known[i])

    def fits(self, capacity: int, shards: int, touched: set[int] | None = None) -> bool | None:
        """Greedy check: True or False where certain, None where hidden starts decide."""
        sure = maybe = 0
        seen: set[int] = set()
        for _ in range(shards):
            sure = self.low(min(self.total, sure + capacity))
            maybe = self.high(min(self.total, maybe + capacity), seen)
            self.high(min(self.total, sure + capacity), seen)
            if sure >= self.total:
                return True
        if maybe < self.total:
            return False
        if touched is not None:
            touched |= seen
        return None


@dataclass(frozen=True)
class Layout:
    rows: DataFrame
    capacity: int
    cuts: list[int]


def _bracket(starts: _Starts, shards: int, low: int, high: int) -> tuple[int, int, set[int]]:
    """Narrow (largest infeasible, smallest feasible) as far as the known starts decide."""
    a, b = low, high
    while b - a > 1:
        mid = (a + b) // 2
        if starts.fits(mid, shards):
            b = mid
        else:
            a = mid
    feasible = b
    a, b = low, feasible
    while b - a > 1:
        mid = (a + b) // 2
        if starts.fits(mid, shards) is False:
            a = mid
        else:
            b = mid
    touched: set[int] = set()
    for capacity in {a + 1, feasible - 1, (a + feasible) // 2}:
        starts.fits(capacity, shards, touched)
    return a, feasible, touched


def _open(table: DataFrame, starts: _Starts, gaps: list[int]) -> None:
    """One job: summarise the starts hidden in ``gaps`` by equal-width blocks."""
    each = max(2, BLOCKS // max(1, len(gaps)))
    edges = [(int(starts.known[i]), int(starts.known[i + 1])) for i in gaps]
    spark = table.sparkSession
    bounds = spark.createDataFrame(
        [(k, a, b, max(1, -(-(b - a) // each))) for k, (a, b) in enumerate(edges)], "gap int, a long, b long, width long"
    )
    # The gap list is bounded by the shard count, so this side is always small.
    inside = table.filter("opens").join(F.broadcast(bounds), (F.col("at") > F.col("a")) & (F.col("at") < F.col("b")))
    found = (
        inside.groupBy("gap", F.expr("(at - a) div width").alias("block"))
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
        .select("lo", "hi", "n")
        .toArrow()
    )
    lo, hi, n = (found.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "n"))
    starts.add(lo, hi, n, np.array(gaps, dtype=np.int64))


def _even_cuts(starts: _Starts, shards: int, capacity: int) -> list[int]:
    """Cuts within the capacity, each as near to an equal share of the rest as the capacity allows."""
    known, total = starts.known, starts.total
    latest = [total]  # from the right: the earliest start the remaining shards can take over from
    for _ in range(shards):
        i = int(np.searchsorted(known, latest[-1] - capacity, side="left"))
        latest.append(int(known[min(i, len(known) - 1)]))
    latest.reverse()
    cuts, at = [], 0
    for k in range(1, shards):
        furthest = starts.low(min(total, at + capacity))
        nearest = latest[k]
        target = at + (total - at) / (shards - k + 1)
        i = int(np.searchsorted(known, target))
        options = [int(known[j]) for j in (i - 1, i) if 0 <= j < len(known)]
        best = min(options, key=lambda x: abs(x - target))
        at = min(max(best, nearest, at), furthest)
        cuts.append(at)
    return cuts


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running bytes and rows inside one sorted partition, and where a new group begins."""
    from pyspark import TaskContext

    part, rows, size, last = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = batch.column("group").to_pylist()
        changed = np.fromiter((a != b for a, b in zip(keys, [last, *keys[:-1]])), dtype=bool, count=len(keys))
        ends = np.cumsum(sizes)
        at = size + ends - sizes
        slot = rows + np.arange(len(keys), dtype=np.int64)
        rows, size, last = rows + len(keys), size + int(ends[-1]), keys[-1]
        out = {name: batch.column(name) for name in batch.schema.names}
        out |= {"part": pa.array(np.full(len(keys), part, dtype=np.int32)), "at": pa.array(at), "row": pa.array(slot), "opens": pa.array(changed)}
        yield pa.RecordBatch.from_pydict(out)


def minimax_shards(df: DataFrame, id_col: str, group: Column, size: Column, shards: int, keep: dict[str, Column] | None = None) -> Layout:
    """Split ``df`` into ``shards`` contiguous runs of whole groups with the smallest possible largest run.

    Groups are ordered by ``group`` (any non-null key; equal keys stay together),
    rows in a group by ``id_col``; nulls come first.  ``size`` must be at least 1.
    ``keep`` names further columns to carry.  The result has ``id_col``, ``size``,
    the kept columns, ``shard`` and ``slot`` (gapless from 0 in each shard).  An
    empty table gives an empty result and capacity 0; fewer groups than shards
    leave shards empty; repeated rows are separate rows of one group.
    """
    spark = df.sparkSession
    keep = keep or {}
    plain = df.select(F.col(id_col).alias("id"), group.alias("group"), size.cast("long").alias("size"), *[c.alias(f"keep_{k}") for k, c in keep.items()])
    layout = plain.repartitionByRange(partitions(spark), "group", "id").sortWithinPartitions("group", "id")
    schema = T.StructType([*layout.schema.fields, *[T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("at", T.LongType()), ("row", T.LongType()), ("opens", T.BooleanType()))]])
    path = scratch(spark, "shards")
    layout.mapInArrow(_running, schema).write.parquet(path)
    sorted_rows = spark.read.schema(schema).parquet(path)

    # One line per task of the sort: totals and the keys at its edges.
    edges = (
        sorted_rows.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min_by("group", "row").alias("first"), F.max_by("group", "row").alias("last"))
        .orderBy("part")
        .collect()
    )
    offsets, at, row, last = [], 0, 0, None
    for e in edges:
        offsets.append((e["part"], at, row, e["first"] == last and at > 0))
        at, row, last = at + e["bytes"], row + e["rows"], e["last"]
    total = at
    table = spark.createDataFrame(offsets, "part int, at0 long, row0 long, goes_on boolean")
    placed = (
        sorted_rows.join(F.broadcast(table), "part")
        .withColumn("opens", F.col("opens") & ~(F.col("goes_on") & (F.col("row") == 0)))
        .withColumn("at", F.col("at") + F.col("at0"))
        .withColumn("row", F.col("row") + F.col("row0"))
    )
    starts = _Starts(total)
    infeasible, feasible = 0, max(1, total)
    if total:
        _open(placed, starts, [0])
        while True:
            infeasible, feasible, touched = _bracket(starts, shards, infeasible, feasible)
            if feasible - infeasible <= 1 or not touched:
                break
            _open(placed, starts, sorted(touched))
    cuts = _even_cuts(starts, shards, feasible) if total else []
    shard = sum((F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    begun = {r["at"]: r["row"] for r in placed.filter(F.col("at").isin([c for c in cuts if c < total])).select("at", "row").collect()} if cuts else {}
    first = F.lit(0).cast("long")
    for c in cuts:
        first = F.when(F.col("at") >= c, F.lit(begun.get(c, 0)).cast("long")).otherwise(first)
    rows = placed.select(
        F.col("id").alias(id_col), "size", *[F.col(f"keep_{k}").alias(k) for k in keep], shard.alias("shard"), (F.col("row") - first).alias("slot")
    )
    return Layout(rows, feasible if total else 0, cuts)
