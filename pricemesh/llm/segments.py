"""Encodings of byte spans, each distinct span encoded once per table.

Spans are grouped by a hash, and every member of a group is then compared byte by
byte with the group's first; so are spans with those known from earlier calls.
Where a comparison fails, the spans of that call are told apart by their bytes
alone.  Results never depend on the hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pricemesh.llm.common import ranges, span_hashes

#: Encodes spans: how many values each has, then all values (rows of a fixed number of columns).
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def same_spans(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether all pairs of spans of these lengths hold the same bytes."""
    return bool((a[ranges(a_begin, lengths)] == b[ranges(b_begin, lengths)]).all())


class SegmentTable:
    """Remembers encoded spans until ``most`` bytes are held, then starts anew."""

    def __init__(self, encode: Encode, most: int = 24 << 20):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)   # hashes, sorted
        self.entry = np.empty(0, dtype=np.int32)   # their entries
        self.begins = np.zeros(1, dtype=np.int64)  # bytes of entry e: pool[begins[e] : begins[e + 1]]
        self.pool = np.empty(0, dtype=np.uint8)
        self.firsts = np.zeros(1, dtype=np.int64)  # values of entry e
        self.values: np.ndarray | None = None

    @property
    def held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.entry, self.begins, self.pool, self.firsts)) + (0 if self.values is None else self.values.nbytes)

    def _add(self, keys: np.ndarray, spans: list[bytes]) -> None:
        counts, values = self.encode(spans)
        n = len(self.begins) - 1
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(s) for s in spans])])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(spans), dtype=np.uint8)])
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(counts)])
        self.values = values if self.values is None else np.concatenate([self.values, values])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.entry = keys[order], np.concatenate([self.entry, np.arange(n, n + len(spans), dtype=np.int32)])[order]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the hashes, and which are known."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.entry[at], self.keys[at] == keys

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values each span has, and the values of all spans; spans are in order and do not overlap."""
        if self.held > self.most:
            self.clear()
        lengths = end - begin
        distinct, first, inverse = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        entry, known = self._find(distinct)
        exact = bool((lengths == lengths[first][inverse]).all()) and same_spans(data, begin, data, begin[first][inverse], lengths)
        if exact and known.any():
            mine = entry[known]
            exact = bool((self.begins[mine + 1] - self.begins[mine] == lengths[first][known]).all()) and same_spans(data, begin[first][known], self.pool, self.begins[mine], lengths[first][known])
        if not exact:
            return self._by_bytes(data, begin, end)
        if not known.all():
            who = first[~known]
            self._add(distinct[~known], [data[b:e].tobytes() for b, e in zip(begin[who].tolist(), end[who].tolist())])
            entry, _ = self._find(distinct)
        mine = entry[inverse]
        counts = self.firsts[mine + 1] - self.firsts[mine]
        values = self.values if self.values is not None else self.encode([])[1]
        return counts, values[ranges(self.firsts[mine], counts)]

    def _by_bytes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans: dict[bytes, int] = {}
        at = np.array([spans.setdefault(data[b:e].tobytes(), len(spans)) for b, e in zip(begin.tolist(), end.tolist())], dtype=np.int64)
        counts, values = self.encode(list(spans))
        firsts = np.cumsum(counts) - counts
        return counts[at], values[ranges(firsts[at], counts[at])]
