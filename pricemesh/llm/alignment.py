"""Alignment of two tokenizers by interval coalescing.

All tokens of both tokenizers are byte intervals of one text.  Sorted by begin,
with the running maximum of their ends, they fall into groups: a group breaks where
a token begins at or after the maximum of all before it.  Inside a group the tokens
that overlap are expanded to pairs; pairs that also end together are links.

Corpus-wide counts of linked id pairs are summed per task, then per pair.  The
counts are written as slices of a bounded number of pairs, and documents look their
links up slice by slice, so no task ever holds more than one slice and no link is
shuffled; more distinct pairs make more passes, not larger ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricemesh.llm.common import ranges, scratch, strings, text_slices, written
from pricemesh.llm.pieces import META, encoder
from pricemesh.llm.segments import SegmentTable

SLICE_BYTES = 256 << 10
SLICE_PAIRS = 2_000_000   # distinct id pairs that a task holds at a time, 17 bytes each
TASK_PAIRS = 500_000      # distinct id pairs that a task counts before it passes them on

#: Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 0x100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


class ByteLevelEncoder:
    """Ids and byte lengths by a byte-level tokenizer file; special tokens inside texts are ordinary text.

    Texts are cut where a lone blank stands between two characters that are not white
    space: there the tokenizer's pattern always begins a new piece.  Every distinct
    segment is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = self.tokenizer.get_vocab_size()
        self.bytes: list[bytes] = [b""] * self.size
        for word, i in vocabulary.items():
            if all(c in BYTE_OF for c in word):  # added tokens are none of these
                self.bytes[i] = bytes(BYTE_OF[c] for c in word)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.table = SegmentTable(self._encode)

    def _encode(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)]
        return np.array([len(f) for f in found], dtype=np.int64), np.array([i for f in found for i in f], dtype=np.int32)

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many in each text) of texts that lie back to back and begin at ``starts``."""
        cut = _cuts(data)
        cut[starts] = True
        begin = np.flatnonzero(cut)
        counts, ids = self.table(data, begin, np.append(begin[1:], len(data)))
        return ids, np.add.reduceat(counts, np.searchsorted(begin, starts)) if len(starts) else np.empty(0, dtype=np.int64)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Lone blanks with no white space of any kind at either side."""
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n < 3:
        return cut
    at = np.flatnonzero(data[1 : n - 1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    graph = (data > 0x20) & (data != 0x7F)
    # White space beyond ASCII begins with C2, E1, E2 or E3, so characters that do are left alone.
    odd = np.isin(data, [0xC2, 0xE1, 0xE2, 0xE3])
    fine = graph[at - 1] & graph[at + 1] & ~odd[at + 1]
    fine &= (before < 0x80) | ~(odd[np.maximum(at - 2, 0)] | odd[np.maximum(at - 3, 0)])
    cut[at[fine & (after != 0x20)]] = True
    return cut


def _piece_bytes(coder) -> tuple[list[bytes], np.ndarray]:
    """Bytes of every piece: the meta symbol as a blank, byte pieces as their byte."""
    processor = coder.library
    out = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(META, " ").encode() for i, p in ((i, processor.id_to_piece(i)) for i in range(processor.get_piece_size()))]
    return out, np.array([len(b) for b in out], dtype=np.int64)


def coalesce(starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all intervals by (begin, kind) and the group number of each in that order."""
    order = np.lexsort((kind, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(fresh) - 1


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of overlapping intervals; each side is in order and without gaps or overlaps of its own."""
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_starts, a_ends, side="left")
    counts = np.maximum(last - first, 0)
    return np.repeat(np.arange(len(a_starts)), counts), ranges(first, counts)


class Aligner:
    """Both tokenizers and what their ids stand for."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevelEncoder(a_path), encoder(b_path)
        self.b_bytes, self.b_lengths = _piece_bytes(self.b)
        self.b_size = len(self.b_bytes)
        a_flat, b_flat = b"".join(self.a.bytes), b"".join(self.b_bytes)
        self.pools = [(np.frombuffer(x, dtype=np.uint8), np.concatenate([[0], np.cumsum(n)[:-1]]), n) for x, n in ((a_flat, self.a.lengths), (b_flat, self.b_lengths))]
        # Ids as text behind each separator: none, of the same kind, of the other kind, of the next group.
        self.words = [[f"{sep}{i}" for i in range(max(self.a.size, self.b_size))] for sep in ("", ",", "|", ";")]

    def _joined(self, which: int, ids: np.ndarray) -> np.ndarray:
        pool, first, lengths = self.pools[which]
        return pool[ranges(first[ids], lengths[ids])]

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray] | None]:
        """Per text (tokens of A, of B, groups, groups as text, overlapping pairs of A and B ids, which of them end together).

        None where a text is null or empty or either tokenizer's bytes are not the blank and the text.
        """
        out: list[tuple | None] = [None] * len(texts)
        who = [k for k, t in enumerate(texts) if t]
        if not who:
            return out
        raw = [b" " + texts[k].encode() for k in who]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        a_ids, a_counts = self.a(data, starts)
        b_found = [f[0] for f in self.b.encode([texts[k] for k in who], bos=False, eos=False, spans=False)]
        b_ids, b_counts = np.concatenate(b_found).astype(np.int64), np.array([len(f) for f in b_found], dtype=np.int64)

        # Texts whose tokens do not spell them have none.
        a_lengths, b_lengths = self.a.lengths[a_ids], self.b_lengths[b_ids]
        a_text, b_text = np.repeat(np.arange(len(who)), a_counts), np.repeat(np.arange(len(who)), b_counts)
        good = (np.bincount(a_text, a_lengths, len(who)) == sizes) & (np.bincount(b_text, b_lengths, len(who)) == sizes)
        keep_a, keep_b, keep_d = good[a_text], good[b_text], np.repeat(good, sizes)
        left = data[keep_d]
        for which, ids, text in ((0, a_ids[keep_a], a_text[keep_a]), (1, b_ids[keep_b], b_text[keep_b])):
            differ = self._joined(which, ids) != left
            if differ.any():
                good[np.unique(np.repeat(np.arange(len(who))[good], sizes[good])[differ])] = False
                return self._again(texts, who, good, out)
        if not good.all():
            return self._again(texts, who, good, out)

        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        a_starts, b_starts = a_ends - a_lengths, b_ends - b_lengths
        kind = np.concatenate([np.zeros(len(a_ids), dtype=np.int8), np.ones(len(b_ids), dtype=np.int8)])
        order, group = coalesce(np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends]), kind)
        text = np.concatenate([a_text, b_text])[order]
        # Within a group first A, then B; both sides stay in order.
        inside = np.lexsort((kind[order], group))
        order, group, text = order[inside], group[inside], text[inside]
        kind, ids = kind[order], np.concatenate([a_ids, b_ids])[order]
        mark = np.ones(len(order), dtype=np.int8)
        mark[1:][kind[1:] != kind[:-1]] = 2
        mark[1:][group[1:] != group[:-1]] = 3
        new_text = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        mark[new_text] = 0
        words = self.words
        spelled = [words[m][i] for m, i in zip(mark.tolist(), ids.tolist())]
        n_groups = np.bincount(text[np.concatenate([[True], group[1:] != group[:-1]])], minlength=len(who))

        pa_, pb_ = overlaps(a_starts, a_ends, b_starts, b_ends)
        together = a_ends[pa_] == b_ends[pb_]
        pair_text = a_text[pa_]
        borders = np.searchsorted(pair_text, np.arange(len(who) + 1))
        bounds = np.append(new_text, len(order))
        codes = a_ids[pa_].astype(np.int64) * self.b_size + b_ids[pb_]
        for k, doc in enumerate(who):
            x, y = borders[k], borders[k + 1]
            out[doc] = (int(a_counts[k]), int(b_counts[k]), int(n_groups[k]), "".join(spelled[bounds[k] : bounds[k + 1]]), codes[x:y], together[x:y])
        return out

    def _again(self, texts: list[str | None], who: list[int], good: np.ndarray, out: list) -> list:
        """Aligned without the texts that turned out to have no tokens."""
        fine = [k for k, g in zip(who, good) if g]
        for k, found in zip(fine, self.align([texts[k] for k in fine])):
            out[k] = found
        return out


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


#: Links of a document: sorted pair codes as differences of 64 bits, compressed; their numbers likewise.
ROWS = "part int, seq long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, codes binary, times binary, code long, n long"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _aligned(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, groups: bool) -> DataFrame:
    """A line per document, then lines (pair code, links in these documents); written to the shared folder."""
    kind = df.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, {ROWS}"
    names = ["id", *(x.split()[0] for x in ROWS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, id_type = TaskContext.get().partitionId(), 0, None
        coder = aligner(a_path, b_path)
        held: list[np.ndarray] = []
        codes, numbers = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def counted() -> None:
            nonlocal codes, numbers
            every = np.concatenate([codes, *[h[0] for h in held]])
            amounts = np.concatenate([numbers, *[h[1] for h in held]])
            codes, inverse = np.unique(every, return_inverse=True)
            numbers = np.zeros(len(codes), dtype=np.int64)
            np.add.at(numbers, inverse, amounts)
            held.clear()

        def passed_on() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(codes), 50_000):
                c, n = codes[k : k + 50_000], numbers[k : k + 50_000]
                empty = [pa.nulls(len(c), t) for t in (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(c), pa.array(n)], names)

        waiting = 0
        for batch in batches:
            id_type = batch.column(0).type
            for piece in text_slices(batch, "text", SLICE_BYTES):
                rows = []
                for found in coder.align(strings(piece.column("text"))):
                    if found is None:
                        rows.append((0, 0, 0, 0, "", "", None, None))
                        continue
                    n_a, n_b, n_groups, spelled, pairs, together = found
                    links, times = np.unique(pairs[together], return_counts=True)
                    held.append((links, times))
                    waiting += len(links)
                    rows.append((n_a, n_b, n_groups, int(together.sum()), spelled if groups else None, hashlib.sha256(spelled.encode()).hexdigest(), _pack(np.diff(links, prepend=0)), _pack(times.astype(np.uint32))))
                n = len(rows)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names
                )
                seq += n
                if waiting > TASK_PAIRS:
                    counted()
                    waiting = 0
                    if len(codes) > TASK_PAIRS:
                        yield from passed_on()
                        codes, numbers = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        counted()
        if len(codes):
            yield from passed_on()

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return written(rows.mapInArrow(run, schema), "align-rows")


def _tables(rows: DataFrame, b_size: int, slice_pairs: int) -> tuple[str, int]:
    """Counts of all pairs and whether they are their B id's highest, in slices of about ``slice_pairs`` pairs; (folder, slices)."""
    spark = rows.sparkSession
    counts = written(rows.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "align-counts")
    slices = max(1, -(-counts.count() // slice_pairs))
    b_id = F.col("code") % b_size
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("best"))  # one line per id of B's vocabulary
    marked = counts.withColumn("b", b_id).join(best, "b").select("code", "n", (F.col("n") == F.col("best")).alias("best"), F.pmod(F.xxhash64("code"), F.lit(slices)).cast("int").alias("slice"))
    folder = scratch(spark, "align-slices")
    marked.repartition("slice").write.partitionBy("slice").parquet(folder)
    return folder, slices


@lru_cache(maxsize=1)
def _slice(folder: str, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    where, root = fs.FileSystem.from_uri(f"{folder}/slice={number}")
    files = [f.path for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(where.open_input_file(f), columns=["code", "n", "best"], partitioning=None) for f in files]
    if not tables:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    table = pa.concat_tables(tables)
    codes = table["code"].to_numpy()
    order = np.argsort(codes)
    return codes[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]


def align_tokens(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, groups: bool = True, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """One row per input row: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups and groups_sha256.

    A is a byte-level tokenizer file and encodes a blank and the text; B is a
    SentencePiece model that puts the blank itself.  Byte offsets at which tokens of
    both end cut the tokens into groups, written ``a1,a2|b1;a3|b2,b3`` by ids.
    Overlapping tokens that end together are a link; the count of an id pair is the
    number of its links in all rows.  n_best: links whose pair has the highest count
    of all pairs of its B id, ties included; count_sum: their counts added up.

    Null and empty texts, and texts that either tokenizer does not spell byte by byte,
    have zeros and empty strings.  Ids may repeat or be null: rows count one by one.
    A long text is aligned whole, in one piece.  An empty table gives an empty
    result; other columns are ignored.  ``groups`` False leaves the groups' text out.
    """
    rows = _aligned(df, id_col, text_col, a_path, b_path, groups)
    b_size = encoder(b_path).library.get_piece_size()
    folder, slices = _tables(rows, b_size, slice_pairs)
    docs = rows.filter("seq is not null")

    def looked_up(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, counts, best = _slice(folder, number)
            for batch in batches:
                sums, bests = [], []
                for raw, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist()):
                    if raw is None or not len(codes):
                        sums.append(0)
                        bests.append(0)
                        continue
                    links, amount = np.cumsum(_unpack(raw, "i8")), _unpack(times, "u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(codes, links), len(codes) - 1)
                    here = codes[at] == links
                    sums.append(int((counts[at] * amount)[here].sum()))
                    bests.append(int(amount[here & best[at]].sum()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], [*keep, "n_best", "count_sum"])

        return run

    keep = ["id", "part", "seq", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_best long, count_sum long"
    found = docs.select(*keep, "codes", "times").mapInArrow(looked_up(0), schema)
    if slices > 1:
        for number in range(1, slices):
            more = docs.select(*[c if c != "groups" else F.lit(None).cast("string").alias("groups") for c in keep], "codes", "times").mapInArrow(looked_up(number), schema)
            found = found.unionByName(more)
        # Every row has one line per slice; the numbers add up.
        found = found.groupBy("part", "seq").agg(*[F.max(c).alias(c) for c in keep if c not in ("part", "seq")], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
