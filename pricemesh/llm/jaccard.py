"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word shingles, known by 128-bit digests made from digests of
their words; the join goes by the first half, sets are compared by the whole.  All
shingles have one global order, rare ones first.  If two sets reach the threshold, their prefixes of length
``n - need(n) + l`` share at least ``l`` tokens.  Each document picks its own
``l`` by the estimated cost of its candidates: a longer prefix costs a few more
tokens, and a partner must then share correspondingly more of them before the
pair is verified on the full sets.  For a pair the smaller ``l`` of both holds.

How it stays linear where many documents are alike:

* Equal sets are one class and only its first document is joined.
* Rarity comes from a table of counts of fixed size that covers all documents;
  it orders tokens and estimates costs, and nothing in the result depends on it.
* Tokens that no other prefix holds are counted per document: they bound the
  overlap of every pair, which removes most rows before any pair is made.
* In long lists everybody first meets only the list's most central document;
  what these links join is contracted, and pairs are then made across the
  remaining groups only.  The pairs left out lie inside one group already.
* The overlaps with a central document c bound those of all pairs around it: two
  sets share at most the smaller overlap with c and the smaller rest outside c.

No pair of different groups is left out by any of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricemesh.llm.common import MULTIPLIER, mixed, partitions, runs, strings, text_slices, written
from pricemesh.llm.segments import SegmentTable
from pricemesh.operators.components import connected_components

SLICE_BYTES = 512 << 10
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 5               # words of a shingle
    over: int = 4                # threshold over / under
    under: int = 5
    most_matches: int = 8        # longest extension of a prefix
    verify_cost: float = 20.0    # cost of verifying one candidate, in tokens scanned
    chance: float = 0.05         # partners expected even of a token that looks unshared
    count_bits: int = 20         # places of the count table
    filter_bits: int = 24        # bits of the filter that spares rereading documents without candidates
    long_list: int = 32          # lists above this meet their most central document first
    salts: int = 256             # parts that the list of a very frequent token is counted in


def _digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.ones(len(words), dtype=np.int64), np.frombuffer(raw, dtype="<u8").reshape(-1, 2)


WORDS = SegmentTable(_digests, 12 << 20)  # 128-bit digests of words


def _sorted(lanes: np.ndarray) -> np.ndarray:
    """Distinct rows of two 64-bit lanes, ordered by the first lane, then the second."""
    out = lanes[np.argsort(lanes[:, 0], kind="stable")]
    same = out[1:, 0] == out[:-1, 0]
    if not same.any():
        return out
    if (same & (out[1:, 1] != out[:-1, 1])).any():
        out = lanes[np.lexsort((lanes[:, 1], lanes[:, 0]))]
        same = (out[1:] == out[:-1]).all(axis=1)
    return out[np.concatenate([[True], ~same])]


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 128-bit shingle digests of every text, as two 64-bit lanes.

    A text of fewer words is one shingle of all its words; without words, or
    null, it is empty.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    begin, end = runs(~SPACE[data])
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.empty(0, dtype=np.int64)
    borders = np.concatenate([[0], np.searchsorted(begin, ends)]).tolist()
    out = []
    with np.errstate(over="ignore"):
        h = WORDS(data, begin, end)[1]
        m = max(0, len(h) - words + 1)
        every = np.zeros((m, 2), dtype=np.uint64)
        for k in range(words):
            every = every * MULTIPLIER + h[k : k + m]
        every = mixed(every + np.uint64(words))
        for a, b in zip(borders, borders[1:]):
            if b - a >= words:
                out.append(_sorted(every[a : b - words + 1]))
            elif b > a:
                one = np.zeros(2, dtype=np.uint64)
                for x in h[a:b]:
                    one = one * MULTIPLIER + x
                out.append(mixed((one + np.uint64(b - a)).reshape(1, 2)))
            else:
                out.append(np.empty((0, 2), dtype=np.uint64))
    return out


def common(u: np.ndarray, v: np.ndarray) -> int:
    """How many rows two sorted sets share."""
    both = np.concatenate([u, v])
    both = both[np.argsort(both[:, 0], kind="stable")]
    same = both[1:, 0] == both[:-1, 0]
    if (same & (both[1:, 1] != both[:-1, 1])).any():  # another shingle with the same first lane
        both = np.concatenate([u, v])
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        same = (both[1:] == both[:-1]).all(axis=1)
    return int(np.count_nonzero(same))


PROFILE = "doc_id long, n_shingles long, digest binary, block int, counts binary"
COUNT_BLOCK = 1 << 14


def _profile(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """One row per document (size and digest of its set), and per task its part of the count table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << config.count_bits, dtype=np.int32)
        shift = np.uint64(64 - config.count_bits)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(strings(part.column("text")), config.words)
                counts += np.bincount((np.concatenate(sets)[:, 0] >> shift).astype(np.int64), minlength=len(counts)).astype(np.int32)
                n = len(sets)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
                )
        if counts.any():
            pieces = counts.reshape(-1, min(COUNT_BLOCK, len(counts)))
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array([p.tobytes() for p in pieces], pa.binary())], names)

    names = [x.split()[0] for x in PROFILE.split(", ")]
    return written(docs.mapInArrow(run, PROFILE), "jaccard-profile")


def _count_table(profile: DataFrame, config: JaccardConfig) -> np.ndarray:
    """Counts of all documents' shingles by the leading bits of their hashes; its size is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(c, dtype=np.int32).astype(np.int64)
                total[b] = total[b] + part if b in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["block", "counts"])

    parts = profile.filter("block is not null").select("block", "counts")
    # Few long rows: they are dealt out by block and summed as they stream by.
    summed = parts.repartition(partitions(profile.sparkSession), "block").mapInArrow(add, "block int, counts binary").collect()
    table = np.zeros(1 << config.count_bits, dtype=np.int64)
    for r in summed:
        piece = np.frombuffer(r["counts"], dtype=np.int64)
        table[r["block"] * len(piece) :][: len(piece)] = piece
    return table


def prefix(tokens: np.ndarray, table: np.ndarray, usual: float, config: JaccardConfig) -> tuple[np.ndarray, np.ndarray, int]:
    """(prefix tokens in global order, their estimated counts, matches asked for) of one set of tokens.

    ``usual`` is the mean of the count table.
    """
    n = len(tokens)
    count = table[(tokens >> np.uint64(64 - config.count_bits)).astype(np.int64)]
    order = np.argsort(count, kind="stable")
    tokens, count = tokens[order], count[order]
    need = -(-config.over * n // config.under)
    shortest = n - need + 1
    shared = np.maximum(count - usual - 4 * np.sqrt(usual), 0) + config.chance
    matches = np.arange(1, min(config.most_matches, need) + 1)
    cost = shortest + matches + config.verify_cost * np.cumsum(shared)[shortest + matches - 2] / matches
    best = int(matches[cost.argmin()])
    end = shortest + best - 1
    return tokens[:end], count[:end], best


POSTING = "key long, token long, doc long, n int, pos int, matches int"


def _postings(docs: DataFrame, table: np.ndarray, config: JaccardConfig) -> DataFrame:
    """Prefix tokens of every document that can link with a different set.

    ``key`` is the token, or a part of it for tokens so frequent that their list
    is counted in parts; ``token`` is null where it equals the key.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    usual = float(table.mean())
    frequent = 4 * usual + 1000
    least = config.under - 1  # smaller sets reach the threshold only when equal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                ids = part.column("doc_id").to_pylist()
                found = []
                for i, s in zip(ids, shingle_sets(strings(part.column("text")), config.words)):
                    if len(s) >= least and i is not None:
                        found.append((i, len(s), *prefix(s[:, 0], shared.value, usual, config)))
                if not found:
                    continue
                sizes = np.array([len(f[2]) for f in found])
                token = np.concatenate([f[2] for f in found])
                doc = np.repeat(np.array([f[0] for f in found], dtype=np.int64), sizes)
                often = np.concatenate([f[3] for f in found]) > frequent
                salt = mixed(doc.astype(np.uint64)) % np.uint64(config.salts)
                key = np.where(often, mixed(token ^ salt), token).astype(np.uint64)
                first = np.cumsum(sizes) - sizes
                pos = np.arange(len(token)) - np.repeat(first, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(token.view(np.int64), mask=~often),
                        pa.array(doc),
                        pa.array(np.repeat([f[1] for f in found], sizes).astype(np.int32)),
                        pa.array(pos.astype(np.int32)),
                        pa.array(np.repeat([f[4] for f in found], sizes).astype(np.int32)),
                    ],
                    [x.split()[0] for x in POSTING.split(", ")],
                )

    return docs.mapInArrow(run, POSTING)


def _need(config: JaccardConfig, n: str) -> Column:
    """Least overlap of a set of size ``n`` with any partner."""
    return F.expr(f"({config.over}L * {n} + {config.under - 1}) div {config.under}")


def _lists(docs: DataFrame, heads: DataFrame, table: np.ndarray, config: JaccardConfig) -> DataFrame:
    """Postings of tokens that at least two classes hold, with ``miss``: prefix tokens before it that nobody shares."""
    counted = _postings(docs, table, config).withColumn("k", F.count("*").over(W.partitionBy("key")))
    some = counted.filter("k > 1 or token is not null").select(F.coalesce("token", "key").alias("token"), "doc", "n", "pos", "matches")
    shared = written(some.join(heads.select(F.col("head").alias("doc")).distinct(), "doc", "left_semi"), "jaccard-shared")
    lists = shared.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    kept = shared.join(lists, "token")
    before = F.row_number().over(W.partitionBy("doc").orderBy("pos", "token")) - 1
    rows = kept.withColumn("miss", F.greatest(F.col("pos") - before, F.lit(0))).filter(F.col("n") - F.col("miss") >= _need(config, "n"))
    return written(rows.select("token", "doc", "n", "miss", "matches", "k"), "jaccard-lists")


def _possible(config: JaccardConfig, a: str, b: str) -> Column:
    """Sizes and unshared tokens still allow the threshold: overlap * (over + under) >= over * (sum of sizes)."""
    o, u = config.over, config.under
    return F.expr(
        f"{u}L * least({a}.n, {b}.n) >= {o}L * greatest({a}.n, {b}.n)"
        f" and {o + u}L * least({a}.n - {a}.miss, {b}.n - {b}.miss) >= {o}L * ({a}.n + {b}.n)"
    )


def _counted(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many prefix tokens as the more modest of both asks for."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("matches").alias("matches")).filter("shared >= matches").select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, config: JaccardConfig) -> DataFrame:
    """Every pair with the overlap of its full sets and whether they reach the threshold."""
    spark = docs.sparkSession
    pairs = written(pairs, "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    # A bit table of fixed size turns most documents without candidates away; what it lets through by chance, the joins drop.
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << config.filter_bits))
    words = (
        wanted.select(bit.alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (config.filter_bits - 6), dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            keep = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            for part in text_slices(batch.filter(pa.array(keep.astype(bool))), "text", SLICE_BYTES):
                found = shingle_sets(strings(part.column("text")), config.words)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([s.tobytes() for s in found], pa.binary())], ["doc", "tokens"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("doc"), "text").withColumn("bit", bit)
    tokens = written(rows.mapInArrow(sets, "doc long, tokens binary"), "jaccard-sets")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, overlap = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                u, v = (np.frombuffer(z, dtype=np.uint64).reshape(-1, 2) for z in (x, y))
                inter = common(u, v)
                overlap.append(inter)
                keep.append(config.under * inter >= config.over * (len(u) + len(v) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(overlap, pa.int64()), pa.array(keep, pa.bool_())], ["a", "b", "inter", "linked"])

    full = (
        pairs.join(tokens.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a")
        .join(tokens.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return written(full.mapInArrow(judge, "a long, b long, inter long, linked boolean"), "jaccard-links")


def _bounded(lists: DataFrame, centres: DataFrame, stars: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists that more than one group has, with each document's group, one central document it was verified
    against, the overlap with it, and at most how many of its other tokens a partner in this list can share."""
    hubs = centres.select(F.col("doc").alias("centre"), F.col("n").cast("long").alias("inter")).distinct()
    both = stars.select(F.col("a").alias("doc"), F.col("b").alias("centre"), "inter").unionByName(stars.select(F.col("b").alias("doc"), F.col("a").alias("centre"), "inter"))
    met = both.join(hubs.select("centre"), "centre", "left_semi")
    met = met.unionByName(hubs.select(F.col("centre").alias("doc"), "centre", "inter"))
    # Neighbours should agree on their centre: the one that most documents were verified against.
    size = met.groupBy("centre").agg(F.count("*").alias("size"))
    own = met.join(size, "centre").groupBy("doc").agg(F.max(F.struct("size", "centre", "inter")).alias("best")).select("doc", F.col("best.centre").alias("centre"), F.col("best.inter").alias("inter"))
    placed = lists.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("group", F.coalesce("component", "doc")).drop("component")
    mixed_lists = placed.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("token")
    placed = placed.join(mixed_lists, "token", "left_semi").join(own, "doc", "left")
    # Unshared tokens ahead of this one are outside the centre only where the centre has this token in its prefix too.
    holds = lists.select("token", F.col("doc").alias("centre"), F.lit(True).alias("held")).join(hubs.select("centre"), "centre", "left_semi")
    placed = placed.join(holds, ["token", "centre"], "left")
    rest = F.col("n") - F.col("inter") - F.when(F.col("held"), F.col("miss")).otherwise(0)
    return written(placed.select("token", "doc", "n", "miss", "matches", "group", "centre", "inter", rest.alias("rest")), "jaccard-mixed")


def jaccard_groups(df: DataFrame, id_col: str, text_col: str, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles and component_id (smallest id reachable by links).

    Two documents link if their sets' intersection is at least ``over / under`` of
    the union.  Null texts and texts without words have no shingles, link with
    nothing and are components of their own.  Equal sets always link.  An id that
    repeats is one document: with several texts it has the links of all of them.
    A row without an id takes part in no link but with its equals.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = _profile(docs, config)
    rows = profile.filter("block is null").select("doc_id", "n_shingles", "digest")
    table = _count_table(profile, config)
    heads = written(rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("head")), "jaccard-heads")
    lists = _lists(docs, heads, table, config)

    # Long lists: every document against the one with the fewest unshared tokens.
    long = lists.filter(F.col("k") > config.long_list)
    centre = long.groupBy("token").agg(F.min(F.struct("miss", "doc", "n", "matches")).alias("c")).select("token", F.col("c.doc").alias("doc"), F.col("c.n").alias("n"), F.col("c.miss").alias("miss"), F.col("c.matches").alias("matches"))
    stars = (
        long.alias("x").join(centre.alias("y"), "token").filter((F.col("x.doc") != F.col("y.doc")) & _possible(config, "x", "y"))
        .select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"), F.least("x.matches", "y.matches").alias("matches"))
    )
    links = None
    if not long.isEmpty():
        stars = _verified(docs, _counted(stars), config)
        links = stars.filter("linked").select("a", "b")
        groups = written(connected_components(links, "a", "b"), "jaccard-stars")
        lists = _bounded(lists, centre, stars, groups)
    else:
        none = F.lit(None).cast("long")
        lists = lists.select("token", "doc", "n", "miss", "matches", F.col("doc").alias("group"), none.alias("centre"), none.alias("inter"), none.alias("rest"))

    # All lists: pairs across groups.
    o, u = config.over, config.under
    around = F.expr(f"not (x.centre <=> y.centre and x.centre is not null) or {o + u}L * (least(x.inter, y.inter) + least(x.rest, y.rest)) >= {o}L * (x.n + y.n)")
    across = (
        lists.alias("x").join(lists.alias("y"), "token").filter((F.col("x.doc") < F.col("y.doc")) & (F.col("x.group") != F.col("y.group")) & _possible(config, "x", "y") & around)
        .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.least("x.matches", "y.matches").alias("matches"))
    )
    found = _verified(docs, _counted(across), config).filter("linked").select("a", "b")
    edges = found if links is None else links.unionByName(found)

    # An id with several texts joins the classes of all of them.
    twice = rows.filter("digest is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi and doc_id is not null").select("doc_id")
    joined = rows.join(twice, "doc_id").join(heads, "digest").filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    parts = connected_components(edges.unionByName(joined), "a", "b").withColumnRenamed("node", "head")
    placed = rows.join(heads, "digest", "left").join(parts, "head", "left")
    return placed.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "head", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str, text_col: str, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """``df`` with one document of each group, the one whose id is the component; all columns as they were.

    Of rows that repeat such an id, the first by text and then by place stays.  Rows
    without an id are groups of their own and stay.
    """
    groups = jaccard_groups(df, id_col, text_col, config)
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct()
    kept = df.join(gone, df[id_col] == gone["gone_id"], "left_anti")
    again = groups.filter(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("again_id")).agg(F.count("*").alias("n")).filter("n > 1").select("again_id")
    if again.isEmpty():
        return kept
    single = kept.join(again, kept[id_col] == again["again_id"], "left_anti")
    many = kept.join(again, kept[id_col] == again["again_id"], "left_semi")
    columns = df.columns
    lead = F.struct(F.col(text_col).alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    first = many.groupBy(id_col).agg(F.min(lead).alias("_lead"))
    return single.unionByName(first.select(*[F.col(f"_lead.c{k}").alias(c) for k, c in enumerate(columns)]))
