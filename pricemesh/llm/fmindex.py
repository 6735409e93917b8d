"""Benchmark decontamination by one FM-index per training shard.

A shard is a run of whole documents inside one task, up to a bounded number of
words.  Its text is a sequence of word numbers; words that no benchmark item
uses cannot be part of a match, so a run of them is stored as one break, and so
is the end of a document.  The index is the usual one: suffix order, Burrows-
Wheeler transform, a wavelet matrix for ranks, and sampled suffix positions.
All benchmark windows walk backwards through it together, as arrays.  Nothing
leaves a task but one row per document; the only shared data is the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricemesh.llm.common import ranges, strings, text_slices

WINDOW = 13
SHARD_BYTES = 8 << 20
SAMPLE = 16                  # every 16th position keeps its suffix position
BENCHMARK_BYTES = 256 << 20  # most benchmark text that is sent to the executors

#: Bytes that belong to a word: 0-9, a-z and everything above 0x7F; A-Z is lowered first, the rest separates.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


@dataclass
class Phrases:
    """Benchmark windows as word numbers (from 1), grouped by length."""

    numbers: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (windows x length, item index of each window)
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        """An item of fewer words than the window is one window; without words it is none.  Equal windows are kept per item."""
        numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple, None]] = {}
        items = [str(k) for k, _ in rows]
        for i, (_, text) in enumerate(rows):
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for s in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {})[(*ids[s : s + n], i)] = None
        by_length = {}
        for n, keys in found.items():
            a = np.array(list(keys), dtype=np.int64).reshape(-1, n + 1)
            by_length[n] = (a[:, :n], a[:, n])
        return cls(numbers, by_length, items)


class _Bits:
    """A bit vector with ranks: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in positions before each ``i``."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class _Wavelet:
    """Wavelet matrix over symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.rows.append(_Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            one = bit.astype(bool)
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``i``, element by element."""
        begin, end = np.zeros_like(i), i.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            b, e = self.rows[k].ones(begin), self.rows[k].ones(end)
            begin = np.where(one, self.zeros[k] + b, begin - b)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - begin

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at ``i`` and its rank before ``i``."""
        symbol, begin, at = np.zeros_like(i), np.zeros_like(i), i.copy()
        for k in range(self.levels):
            one = self.rows[k].get(at)
            b, a = self.rows[k].ones(begin), self.rows[k].ones(at)
            begin = np.where(one, self.zeros[k] + b, begin - b)
            at = np.where(one, self.zeros[k] + a, at - a)
            symbol = (symbol << 1) | one
        return symbol, at - begin


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; 0 is a break, lower than all else and unlike any other break.

    The first sort compares as many symbols as fit into 64 bits; groups that are
    still tied are sorted again by the ranks that far ahead, doubling each time.
    A comparison ends at the next break, so few rounds are needed.
    """
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    stop = np.zeros(n, dtype=bool)  # a break was passed: what follows is not compared
    for k in range(h):
        ahead = np.zeros(n, dtype=np.int64)
        if k < n:
            ahead[: n - k] = text[k:]
        ahead[stop] = 0
        key = (key << bits) | ahead
        stop |= ahead == 0
    order = np.argsort(key, kind="stable")  # suffixes that met a break stay in the order of position
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.empty(0, bool)
    # Those that met a break are decided: their order is by position.
    done = stop[order]
    new |= done | np.concatenate([[True], done[:-1]]) if n else new
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    while True:
        tied = np.flatnonzero(~new | np.concatenate([~new[1:], [False]])) if n else np.empty(0, int)
        if not len(tied):
            return order
        who = order[tied]
        ahead = np.where(who + h < n, rank[np.minimum(who + h, n - 1)], -1)
        group = start[tied]
        again = np.lexsort((ahead, group))
        order[tied] = who[again]
        ahead, group = ahead[again], group[again]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
        new[tied] = fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[tied]] = start[tied]
        h *= 2


class FMIndex:
    """Index over one shard.  ``text`` holds word numbers and single breaks (0), and ends with a break."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        order = suffix_order(text)
        self.size = n
        self.wavelet = _Wavelet(text[order - 1], max(1, int(symbols).bit_length()))  # order 0 wraps to the last break
        counts = np.bincount(text, minlength=symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # Positions after a break are sampled as well, so that no walk has to cross one.
        keep = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.marked = _Bits(keep.astype(np.uint8))
        self.positions = order[keep]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of all windows (rows of word numbers) by backward search."""
        low = np.zeros(len(windows), dtype=np.int64)
        high = np.full(len(windows), self.size, dtype=np.int64)
        alive = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            c = windows[alive, k]
            low[alive] = self.first[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.first[c] + self.wavelet.rank(c, high[alive])
            none = low[alive] >= high[alive]
            high[alive[none]] = low[alive[none]]
            alive = alive[~none]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back to a sampled one, all at once."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        waiting = np.flatnonzero(~self.marked.get(at))
        while len(waiting):
            symbol, rank = self.wavelet.access(at[waiting])
            at[waiting] = self.first[symbol] + rank
            steps[waiting] += 1
            waiting = waiting[~self.marked.get(at[waiting])]
        return self.positions[self.marked.ones(at)] + steps


@dataclass
class Hits:
    """Per document of a shard: number of words, merged removal spans in words, items found."""

    words: np.ndarray
    spans: list[list[tuple[int, int]]]
    items: list[list[str]]


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans (touching ones join); both arrays sorted by begin."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    return begin[starts], reach[np.concatenate([starts[1:] - 1, [len(begin) - 1]])]


def scan_shard(texts: list[str | None], phrases: Phrases) -> Hits:
    """Index the documents of one shard and find every window in them."""
    get = phrases.numbers.get
    parts = [np.fromiter([get(w, 0) for w in words_of(t)], dtype=np.int64) for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    # A break ends each document; the position of a word in the whole shard is kept per stored symbol.
    full = np.concatenate([np.append(p, 0) for p in parts]) if parts else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    stored = (full != 0) | np.concatenate([[True], full[:-1] != 0]) if len(full) else np.empty(0, bool)
    place = np.flatnonzero(stored)
    text = full[place]
    if phrases.by_length and len(text) and text.any():
        index = FMIndex(text, len(phrases.numbers))
        begins, ends, owners = [], [], []
        for length, (windows, of) in phrases.by_length.items():
            low, high = index.search(windows)
            at = place[index.locate(ranges(low, high - low))]
            begins.append(at)
            ends.append(at + length)
            owners.append(np.repeat(of, high - low))
        begin, end, owner = (np.concatenate(x) for x in (begins, ends, owners))
        if len(begin):
            doc = np.searchsorted(starts, begin, side="right") - 1
            for key in np.unique(doc * len(phrases.items) + owner).tolist():
                items[key // len(phrases.items)].append(phrases.items[key % len(phrases.items)])
            order = np.argsort(begin, kind="stable")
            # Spans of two documents never touch: the break lies between them.
            b, e = _merged(begin[order], end[order])
            for d, x, y in zip((np.searchsorted(starts, b, side="right") - 1).tolist(), b.tolist(), e.tolist()):
                spans[d].append((x - int(starts[d]), y - int(starts[d])))
    return Hits(counts, spans, items)


def gather_phrases(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> Phrases:
    """The benchmark, which is a stated query set: its size is measured before it is fetched."""
    from pyspark.sql import functions as F

    plain = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > BENCHMARK_BYTES:
        raise ValueError(f"benchmark of {size} bytes; split it into sets of at most {BENCHMARK_BYTES} and unite the results")
    return Phrases.of(sorted(((r["item"], r["text"]) for r in plain.collect()), key=lambda r: (str(r[0]), r[1] or "")), window)


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>"


def find_contamination(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, items (sorted strings) and spans (word positions, merged).

    A null or empty text has no words.  Null items' texts have no windows.
    Repeated documents are judged row by row, ids are only carried; two items
    under one id are one entry of ``items``.
    """
    phrases = docs.sparkSession.sparkContext.broadcast(gather_phrases(benchmark, item_col, item_text, window))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, SHARD_BYTES):
                hits = scan_shard(strings(part.column(text_col)), phrases.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col),
                        pa.array(hits.words, pa.int64()),
                        pa.array([sum(e - b for b, e in s) for s in hits.spans], pa.int64()),
                        pa.array([sorted(set(x)) for x in hits.items], pa.list_(pa.string())),
                        pa.array([[{"begin": b, "end": e} for b, e in s] for s in hits.spans], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                    ],
                    [id_col, "n_words", "n_hit", "items", "spans"],
                )

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, {RESULT}")


def contaminated(words: int, hit: int) -> bool:
    """The contract's rule: some word is hit, and at least one in twenty."""
    return hit > 0 and 20 * hit >= words


def drop_contaminated(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were."""
    phrases = docs.sparkSession.sparkContext.broadcast(gather_phrases(benchmark, item_col, item_text, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, SHARD_BYTES):
                hits = scan_shard(strings(part.column(text_col)), phrases.value)
                keep = [not contaminated(int(n), sum(e - b for b, e in s)) for n, s in zip(hits.words, hits.spans)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
