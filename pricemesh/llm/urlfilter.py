"""URL rules by a sorted digest array.

The rule list becomes one file: sorted 64-bit xxhash keys, offsets, and the rule
strings themselves.  It is written once to the shared folder, handed to every
executor as a session file, memory-mapped there and probed by vectorised binary
search.  Every key that hits is confirmed against the stored string, so a
collision of digests cannot decide a verdict.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemesh.llm.common import scratch, strings, text_slices

MAGIC = b"URLRULE1"
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def digest_file(rules: list[Rule]) -> bytes:
    """Header, sorted keys, offsets, path lengths and label counts of the rules, verdicts and strings.  Of equal rules the first one counts."""
    unique = {}
    for r in rules:
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"verdict {r.verdict!r}")
        unique.setdefault(_key_bytes(r.host, r.path), r)
    pairs = sorted((xxhash.xxh64_intdigest(k), k, r.verdict == "block") for k, r in unique.items())
    blob = b"".join(k for _, k, _ in pairs)
    lengths = sorted({len(r.path) for r in unique.values()})
    labels = sorted({r.host.count(".") + 1 for r in unique.values()})
    head = np.array([len(pairs), len(lengths), len(labels)], dtype="<u8").tobytes()
    return b"".join(
        [
            MAGIC,
            head,
            np.array([p[0] for p in pairs], dtype="<u8").tobytes(),
            np.concatenate([[0], np.cumsum([len(p[1]) for p in pairs])]).astype("<u8").tobytes(),
            np.array(lengths, dtype="<u8").tobytes(),
            np.array(labels, dtype="<u8").tobytes(),
            np.array([p[2] for p in pairs], dtype="u1").tobytes(),
            blob,
        ]
    )


def _key_bytes(host: str, path: str) -> bytes:
    return host.encode() + b"\x00" + path.encode()


class DigestArray:
    """A memory-mapped rule file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != MAGIC:
            raise ValueError(f"{path} is no rule file")
        view = memoryview(self._map)
        n, kinds, counts = np.frombuffer(view, "<u8", 3, 8).tolist()
        at = 32
        self.keys = np.frombuffer(view, "<u8", n, at)
        self.offsets = np.frombuffer(view, "<u8", n + 1, at := at + 8 * n)
        self.path_lengths = np.frombuffer(view, "<u8", kinds, at := at + 8 * (n + 1)).tolist()
        self.label_counts = np.frombuffer(view, "<u8", counts, at := at + 8 * kinds).tolist()
        self.blocks = np.frombuffer(view, "u1", n, at := at + 8 * counts)
        self.blob = at + n

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Index of each candidate's rule, -1 where there is none."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), dtype=np.uint64, count=len(candidates))
        found = np.full(len(candidates), -1, dtype=np.int64)
        if not len(self.keys) or not len(keys):
            return found
        at = np.searchsorted(self.keys, keys)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        for i in hits.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal digests stand side by side
                if self.stored(j) == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def stored(self, j: int) -> bytes:
        return self._map[self.blob + int(self.offsets[j]) : self.blob + int(self.offsets[j + 1])]


def _candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[bytes]:
    """Host suffixes of as many labels and path prefixes of the lengths that rules have, longest rule first."""
    suffixes, at, seen = [], len(host), 0
    while at >= 0 and seen < labels[-1] if labels else False:
        at, seen = host.rfind(".", 0, at), seen + 1
        if seen in labels:
            suffixes.append(host[at + 1 :])
    prefixes = [path[:k] for k in lengths if k <= len(path)]
    every = [(s, p) for s in suffixes for p in prefixes]
    every.sort(key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))
    return [_key_bytes(s, p) for s, p in every]


def _judge(rules: DigestArray, hosts: list[str], paths: list[str], default: str) -> tuple[list, list]:
    groups = [_candidates(h, p, rules.path_lengths, rules.label_counts) if h else [] for h, p in zip(hosts, paths)]
    found = rules.find([c for g in groups for c in g])
    texts, verdicts, at = [], [], 0
    for g in groups:
        hit = found[at : at + len(g)]
        at += len(g)
        first = int(hit[np.argmax(hit >= 0)]) if len(g) and (hit >= 0).any() else -1
        texts.append(rules.stored(first).replace(b"\x00", b"").decode() if first >= 0 else None)
        verdicts.append(default if first < 0 else "block" if rules.blocks[first] else "allow")
    return texts, verdicts


def split_url(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lowered) and path of a URL column; both empty for null or without ``://``."""
    c = F.col(url)
    rest = F.when(F.instr(c, "://") > 0, F.substr(c, F.instr(c, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def publish(spark: SparkSession, rules: list[Rule], label: str = "urlrules") -> str:
    """Write the rule file to the shared folder and hand it to all executors; returns its session name."""
    path = scratch(spark, label) + ".bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(digest_file(rules))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule (null where none fits) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins, of equally long ones that with the longer host.  Null
    urls and urls without ``://`` have an empty host and path and get ``default``.
    Hosts and paths of any length are fine: only suffixes of as many labels and
    prefixes of as many characters as some rule has are looked up.  Ids may repeat or
    be null; other columns are ignored; an empty table or an empty rule list is fine.
    """
    name = publish(df.sparkSession, rules)
    host, path = split_url(url_col)
    kind = df.schema[id_col].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            for part in text_slices(batch, "path", SLICE_BYTES):
                texts, verdicts = _judge(array, strings(part.column("host")), strings(part.column("path")), default)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column("host"), part.column("path"), pa.array(texts, pa.string()), pa.array(verdicts, pa.string())],
                    [id_col, "host", "path", "rule", "verdict"],
                )

    plain = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    return plain.mapInArrow(probe, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
