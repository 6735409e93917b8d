"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors form one class first, so copies cost nothing further.  Every class
has a home cell and meets every cell in which a partner is possible at all: if
two unit vectors are within angle t and the second lies nearer to centroid c than
to the first one's centroid h, then the first is at most sin(t) from the plane
between c and h, and at most t beyond the radius of cell c.  So no pair is lost,
at a cost that nears all pairs where vectors are spread evenly.  Cells are put
together or cut into blocks of bounded size, and each block is written once.
Tasks are strips of block pairs that read their blocks from the shared folder, so
no vector is shuffled more than once, however many blocks it meets.  Each pair of
blocks is one matrix product, of those rows on either side that the other block's
cells can hold a partner of: in single precision with a proven margin, and again
in double precision for cosines within the margin of the threshold.  With
``probes`` set, a class visits only the cells of that many nearest centroids,
which loses pairs as the cells grow in number.  A product returns link counts and
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.llm.common import partitions, scratch, written
from pricemesh.operators.components import connected_components

EDGE = 1e-7  # margin of the pruning bounds against rounding
WIDE, TILED = 8, 32  # blocks grow up to WIDE times where there are more than TILED of them: a block is read once per strip met
BLOCK_BYTES = 16 << 20  # of a block's vectors, whatever their length
STRIP = 8        # blocks that one block is compared with before it is read again
SLICE = 1 << 20  # cosines held at a time
SETTLED = 1 << 16  # cosines taken again in double precision at a time


@dataclass(frozen=True)
class CellConfig:
    threshold: float = 0.9
    block: int = 1024            # most vectors on either side of a product; without probes up to WIDE times as many in large tables
    rows_per_cell: int = 1024
    most_cells: int = 2048
    sample: int = 20_000         # vectors that k-means is fitted on
    rounds: int = 12
    probes: int | None = None    # cells compared with, the home cell included; None: all that can hold a partner


def unit_groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors in double precision of the usable vectors of a list column, once per vector length."""
    offsets = column.offsets.to_numpy()
    # Null components become NaN.
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        x = values[offsets[rows][:, None] + np.arange(size)]
        top = np.abs(x).max(axis=1)  # NaN where a component is
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]  # neither overflow nor underflow in the squares
        yield rows[good], x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (rows of zeros where there is none, shorter ones filled up with zeros) and which rows have one."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors if v is not None), default=0)))
    ok = np.zeros(len(vectors), dtype=bool)
    for rows, x in unit_groups(pa.array(vectors, pa.list_(pa.float64()))):
        out[rows, : x.shape[1]] = x
        ok[rows] = True
    return out, ok


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids; starts from evenly spaced rows, empty cells restart at the worst fitted rows."""
    if not len(x) or k < 1:
        return np.zeros((0, x.shape[1]))
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        sims = x @ centre.T
        home = sims.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        total[empty] = x[np.argsort(sims[np.arange(len(x)), home])[: len(empty)]]
        norm[empty] = 1.0
        centre = total / norm[:, None]
    return centre


class _Forest:
    """Union-find over the rows of one product."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


@dataclass
class _Side:
    """Rows on one side of a product."""

    unit: np.ndarray
    ids: np.ndarray
    copies: np.ndarray
    home: np.ndarray
    probes: np.ndarray | None = None
    near: np.ndarray | None = None

    def only(self, rows: np.ndarray) -> _Side:
        return _Side(self.unit[rows], self.ids[rows], self.copies[rows], self.home[rows])


def _hits(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows whose cosine in double precision reaches the threshold, a bounded number of products at a time.

    A single-precision product of unit vectors of n components is off by at most
    (n + 2) 2^-24 and a little, their rounding included; the margin is twice that.
    """
    margin = 2 * (a.shape[1] + 2) * 2.0**-24
    single_a, single_b = a.astype(np.float32), b.astype(np.float32).T
    step = max(1, SLICE // len(b))
    for start in range(0, len(a), step):
        sims = single_a[start : start + step] @ single_b
        i, j = np.nonzero(sims >= threshold - margin)
        if not len(i):
            continue
        keep = sims[i, j] >= threshold + margin
        i += start
        open_ = np.flatnonzero(~keep)
        for k in range(0, len(open_), SETTLED):
            part = open_[k : k + SETTLED]
            keep[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
        yield i[keep], j[keep]


def _links(left: _Side, right: _Side, cell: int, same: bool, config: CellConfig) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Link weights of the left and right rows, and a spanning forest of the links as (left, right) ids."""
    of_left, of_right = np.zeros(len(left.ids), dtype=np.int64), np.zeros(len(right.ids), dtype=np.int64)
    ids, number = np.unique(np.concatenate([left.ids, right.ids]), return_inverse=True)
    at_a, at_b = number[: len(left.ids)], number[len(left.ids) :]
    roots, edges = _Forest(len(ids)), []
    for i, j in _hits(left.unit, right.unit, config.threshold):
        if same:
            once = left.ids[i] != right.ids[j]
            i, j = i[once], j[once]
        elif config.probes is not None:
            # A pair that its other cell finds as well is left to the cell of the lower number.
            first, last = (int(i[0]), int(i[-1]) + 1) if len(i) else (0, 0)
            probes = [np.frombuffer(p, "<i4") for p in left.probes[first:last]]
            table = np.full((len(probes), max(map(len, probes), default=0)), -1, dtype=np.int32)
            for k, p in enumerate(probes):
                table[k, : len(p)] = p
            twice = np.zeros(len(i), dtype=bool)
            for k in range(0, len(i), 1 << 18):
                part = slice(k, k + (1 << 18))
                twice[part] = (table[i[part] - first] == right.home[j[part]][:, None]).any(axis=1)
            once = (right.home[j] >= cell) | ~twice
            i, j = i[once], j[once]
        of_left += np.bincount(i, right.copies[j], len(left.ids)).astype(np.int64)
        if not same:
            of_right += np.bincount(j, left.copies[i], len(right.ids)).astype(np.int64)
        # A row's first partner joins it to the rest: hubs are settled in one step, other links only where they join groups.
        while len(i):
            _, first = np.unique(i, return_index=True)
            for k in first.tolist():
                if roots.join(int(at_a[i[k]]), int(at_b[j[k]])):
                    edges.append((int(left.ids[i[k]]), int(right.ids[j[k]])))
            met, back = np.unique(np.concatenate([at_a[i], at_b[j]]), return_inverse=True)
            root = np.array([roots.root(k) for k in met.tolist()])[back]
            open_ = root[: len(i)] != root[len(i) :]
            i, j = i[open_], j[open_]
    return of_left, of_right, edges


LINK = "a long, b long, weight long"
TILE = "cell int, block int, kind int, other int, side int, class_id long, copies long, home int, probes binary, unit binary"


def near_vectors(df: DataFrame, id_col: str, vector_col: str, config: CellConfig = CellConfig()) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id (smallest id reachable by links) and kept.

    Two vectors link if their cosine in double precision reaches the threshold;
    vectors of different lengths never do.  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing and are kept.  Equal
    vectors link with each other.  Every row is a vector of its own: rows that
    share an id are counted and grouped apart, and all rows with a group's smallest
    id are kept.  A null id is never the smallest; a group of null ids only has a
    null component_id and all its rows are kept.  Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A class is a direction to the last bit, so its members' cosines agree with all others'.
            packed: list[bytes | None] = [None] * batch.num_rows
            for at, x in unit_groups(batch.column("vector")):
                for k, v in zip(at.tolist(), x):
                    packed[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "unit"])

    unit = written(rows.mapInArrow(units, "id long, unit binary"), "vectors")
    digest = F.sha2("unit", 256)
    usable = unit.filter("unit is not null").withColumn("digest", digest)
    # Map-side combined: a third of all rows in one class is one partial row per task.
    found = usable.groupBy("digest").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    # Classes are numbered as they are written, since an id may stand for several vectors.
    classes = written(found.withColumn("dims", (F.octet_length("unit") / 8).cast("int")).withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    pieces = []
    for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect():  # one line per vector length
        pieces.append(_compare(classes.filter(F.col("dims") == r["dims"]), r["n"], r["dims"], config))
    counts = spark.createDataFrame([], "class_id long, links long")
    edges = spark.createDataFrame([], "a long, b long")
    for found in pieces:
        counts = counts.unionByName(found.filter("b is null").select(F.col("a").alias("class_id"), F.col("weight").alias("links")))
        edges = edges.unionByName(found.filter("b is not null").select("a", "b"))
    counts = counts.groupBy("class_id").agg(F.sum("links").alias("links"))
    parts = connected_components(edges, "a", "b").withColumnRenamed("node", "class_id")
    least = parts.join(classes.select("class_id", "least_id"), "class_id").groupBy("component").agg(F.min("least_id").alias("lowest"))
    lowest = parts.join(least, "component").select("class_id", "lowest")
    alone = classes.select("class_id", "least_id", "digest", "copies").join(counts, "class_id", "left").join(lowest, "class_id", "left")
    known = alone.select("digest", "copies", "links", F.coalesce("lowest", "least_id").alias("lowest"))
    member = unit.withColumn("digest", F.when(F.col("unit").isNotNull(), digest)).select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("lowest", "id")
    return member.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _compare(classes: DataFrame, n: int, dims: int, config: CellConfig) -> DataFrame:
    """(a, null, weight): a's links; (a, b, null): links that span all links."""
    spark = classes.sparkSession
    share = min(1.0, 1.2 * config.sample / n)
    sample = classes.filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(share * (1 << 20))).select("class_id", "unit").limit(config.sample).collect()
    x = np.array([np.frombuffer(r["unit"], "<f8") for r in sorted(sample, key=lambda r: r["class_id"])]).reshape(-1, dims)
    k = max(1, min(config.most_cells, -(-n // config.rows_per_cell), len(x)))
    centres = spherical_kmeans(x, k, config.rounds) if len(x) else np.eye(1, dims)
    shared = spark.sparkContext.broadcast(centres)  # at most ``most_cells`` vectors

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("unit").to_pylist()), "<f8").reshape(-1, dims)
            sims = v @ shared.value.T
            home = sims.argmax(axis=1)
            near = np.clip(sims[np.arange(len(v)), home], -1, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class_id", "copies", "unit")), pa.array(home.astype(np.int32)), pa.array(near)], ["class_id", "copies", "unit", "home", "near"])

    at_home = written(classes.select("class_id", "copies", "unit").mapInArrow(homes, "class_id long, copies long, unit binary, home int, near double"), "vector-homes")
    k = len(centres)
    rows_of, radius = np.zeros(k, dtype=np.int64), np.zeros(k)
    for c in at_home.groupBy("home").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect():  # one line per cell
        rows_of[c["home"]] = c["n"]
        radius[c["home"]] = np.arccos(c["near"])
    if config.probes is None:
        return _block_pairs(at_home, centres, rows_of, radius, n, dims, config)
    blocks = -(-rows_of // config.block)
    info = spark.sparkContext.broadcast((centres, blocks))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("unit").to_pylist()), "<f8").reshape(-1, dims)
            lists = _probes(v, batch.column("home").to_numpy(), *info.value, config)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.astype("<i4").tobytes() for p in lists], pa.binary()), pa.array([p.tolist() for p in lists], pa.list_(pa.int32()))], [*batch.schema.names, "probes", "cells"])

    rows = written(at_home.drop("near").mapInArrow(probed, "class_id long, copies long, unit binary, home int, probes binary, cells array<int>"), "vector-probes")
    guests = np.zeros(k, dtype=np.int64)
    for c in rows.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect():  # one line per cell
        guests[c["cell"]] = -(-c["n"] // config.block)
    # Tiles: two blocks of a cell (kind 0), or a block and one chunk of the cell's visitors (kind 1).
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column("home").to_pylist()
            mix = (batch.column("class_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out = []
            for r, (h, cells, m) in enumerate(zip(home, batch.column("cells").to_pylist(), mix.tolist())):
                b = m % int(blocks[h])
                out += [(r, h, min(b, j), 0, max(b, j), int(b > j)) for j in range(int(blocks[h]))]
                out += [(r, h, b, 1, g, 0) for g in range(int(guests[h]))]
                for c in cells:
                    g = m % int(guests[c])
                    out += [(r, c, j, 1, g, 1) for j in range(int(blocks[c]))]
            for start in range(0, len(out), 8192):
                t = np.array(out[start : start + 8192], dtype=np.int64)
                take = pa.array(t[:, 0])
                yield pa.RecordBatch.from_arrays([*(pa.array(t[:, c].astype(np.int32)) for c in range(1, 6)), *(batch.column(c).take(take) for c in ("class_id", "copies", "home", "probes", "unit"))], [x.split()[0] for x in TILE.split(", ")])

    return _products(rows.mapInArrow(tiles, TILE), config)


def _products(placed: DataFrame, config: CellConfig) -> DataFrame:
    """Links of every tile."""

    def product(group: pd.DataFrame) -> pd.DataFrame:
        same = bool(group["kind"].iat[0] == 0 and group["block"].iat[0] == group["other"].iat[0])
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        if same:
            right = left
        out = {"a": [], "b": [], "weight": []}
        if len(left) and len(right):
            sides = [
                _Side(np.frombuffer(b"".join(s["unit"]), "<f8").reshape(len(s), -1), *(s[c].to_numpy() for c in ("class_id", "copies", "home", "probes")))
                for s in (left, right)
            ]
            of_left, of_right, edges = _links(*sides, int(group["cell"].iat[0]), same, config)
            for side, of in zip(sides, (of_left, of_right)):
                at = np.flatnonzero(of)
                out["a"] += side.ids[at].tolist()
                out["b"] += [None] * len(at)
                out["weight"] += of[at].tolist()
            out["a"] += [a for a, _ in edges]
            out["b"] += [b for _, b in edges]
            out["weight"] += [None] * len(edges)
        return pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in out.items()})

    return written(placed.groupBy("cell", "block", "kind", "other").applyInPandas(product, LINK), "vector-links")


def _block_pairs(at_home: DataFrame, centre: np.ndarray, rows_of: np.ndarray, radius: np.ndarray, n: int, dims: int, config: CellConfig) -> DataFrame:
    """Links of all pairs of blocks that can hold partners; blocks are written once and read by the tasks."""
    spark = at_home.sparkSession
    side = max(1, min(WIDE * config.block, max(config.block, n // TILED), BLOCK_BYTES // (8 * dims)))
    # Cells side by side along the centroids' main direction share a block; a large cell has several of its own.
    order = np.argsort(centre @ np.linalg.svd(centre - centre.mean(axis=0), full_matrices=False)[2][0], kind="stable")
    first, parts = np.zeros(len(centre), dtype=np.int64), np.zeros(len(centre), dtype=np.int64)
    used, filled = 0, side
    for c in order[rows_of[order] > 0].tolist():
        parts[c] = -(-rows_of[c] // side)
        if filled + rows_of[c] > side:
            first[c], used, filled = used, used + parts[c], 0
        else:
            first[c] = used - 1
        filled = side if parts[c] > 1 else filled + rows_of[c]
    where = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(parts).tolist()], "home int, first int, parts int")  # one line per cell
    own = F.col("first") + F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    folder = scratch(spark, "vector-blocks")
    at_home.join(where, "home").withColumn("block", own).drop("first", "parts").repartition(partitions(spark), "block").write.partitionBy("block").parquet(folder)
    info = spark.sparkContext.broadcast((centre, radius, first, parts))
    # Around a circle of blocks each meets those up to half-way ahead: every pair once, equal work for every block.
    strips = -(-(used // 2 + 1) // STRIP)
    total = used * strips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs(folder, dims, used, *info.value, config)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from pairs.strip(number // strips, number % strips * STRIP)

    tasks = min(total, max(partitions(spark), -(-total // STRIP)))
    return written(spark.range(0, total, 1, tasks).mapInArrow(run, LINK), "vector-links")


class _Pairs:
    """Products of pairs of written blocks."""

    def __init__(self, folder: str, dims: int, used: int, centre: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray, config: CellConfig):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.dims, self.used, self.centre, self.radius, self.config = dims, used, centre, radius, config
        self.first, self.parts = first, parts

    def cells(self, block: int) -> np.ndarray:
        return np.flatnonzero((self.parts > 0) & (self.first <= block) & (block < self.first + self.parts))

    def read(self, block: int) -> _Side:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/block={block}", allow_not_found=True))
        paths = sorted(f.path for f in found if f.path.endswith(".parquet"))
        if not paths:  # a part of a cell that no class fell to
            none = np.empty(0, dtype=np.int64)
            return _Side(np.empty((0, self.dims)), none, none, none, near=np.empty(0))
        rows = pa.concat_tables(pq.ParquetFile(self.files.open_input_file(p)).read() for p in paths)
        unit = np.frombuffer(b"".join(rows["unit"].to_pylist()), "<f8").reshape(-1, self.dims)
        return _Side(unit, *(rows[c].to_numpy() for c in ("class_id", "copies", "home")), near=rows["near"].to_numpy())

    def apart(self, a: np.ndarray, b: np.ndarray) -> bool:
        """No cell of the one is near enough to a cell of the other."""
        angle = np.arccos(np.clip(self.centre[a] @ self.centre[b].T, -1, 1))
        return bool((angle > self.radius[a][:, None] + self.radius[b] + np.arccos(self.config.threshold) + EDGE).all())

    def fitting(self, side: _Side, cells: np.ndarray) -> np.ndarray:
        """Rows of which one of the cells can hold a partner."""
        threshold = self.config.threshold
        sims = side.unit @ self.centre[cells].T
        homes, at = np.unique(side.home, return_inverse=True)
        gap = np.maximum(2 - 2 * self.centre[homes] @ self.centre[cells].T, 0)
        plane = side.near[:, None] - sims <= (np.sqrt(1 - threshold**2) + EDGE) * np.sqrt(gap)[at] + EDGE
        reach = np.arccos(np.clip(sims, -1, 1)) <= self.radius[cells] + np.arccos(threshold) + EDGE
        return np.flatnonzero((plane & reach | (side.home[:, None] == cells)).any(axis=1))

    def strip(self, low: int, begin: int) -> Iterator[pa.RecordBatch]:
        ahead = [k for k in range(begin, min(begin + STRIP, self.used // 2 + 1)) if 2 * k != self.used or low < self.used // 2]
        cells, left = self.cells(low), None
        for k in ahead:
            other = (low + k) % self.used
            theirs = self.cells(other)
            if self.apart(cells, theirs):
                continue
            left = left or self.read(low)
            if k == 0:
                a = b = left
            else:
                right = self.read(other)
                a, b = left.only(self.fitting(left, theirs)), right.only(self.fitting(right, cells))
            if not len(a.ids) or not len(b.ids):
                continue
            of_a, of_b, edges = _links(a, b, 0, k == 0, self.config)
            for side, of in ((a, of_a), (b, of_b)):
                at = np.flatnonzero(of)
                yield pa.RecordBatch.from_arrays([pa.array(side.ids[at]), pa.nulls(len(at), pa.int64()), pa.array(of[at])], ["a", "b", "weight"])
            if edges:
                ends = np.array(edges, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.nulls(len(ends), pa.int64())], ["a", "b", "weight"])


def _probes(v: np.ndarray, home: np.ndarray, centre: np.ndarray, blocks: np.ndarray, config: CellConfig) -> list[np.ndarray]:
    """Cells other than the home that each vector visits."""
    order = np.argsort(-(v @ centre.T), axis=1, kind="stable")[:, : config.probes]
    return [o[(o != h) & (blocks[o] > 0)] for o, h in zip(order, home)]
