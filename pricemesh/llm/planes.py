"""Token ids in bit-plane shuffled files.

Documents are range-partitioned by id, so partition k holds the k-th stretch of
the corpus; each task encodes its stretch and writes one file.  Ids are cut into
blocks of a fixed number; a block is transposed into bit or byte planes, each
plane is compressed with zstandard, and a chunk index in the footer gives the
place of every plane.  One row per document (file, offset in it, length) is all
that leaves the task besides the file.  Files carry the attempt's name and only
those named by the index are read, so a retried task does no harm.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.llm.common import partitions, runs, scratch, strings, text_slices, written
from pricemesh.llm.segments import SegmentTable

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
SLICE_BYTES = 1 << 20
CACHED_BYTES = 64 << 20  # of encoded words that one Python worker remembers


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first; planes of zeros at the top are left out."""
    if kind == "byte":
        planes = [p.tobytes() for p in np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)]
    else:
        top = int(ids.max(initial=0)).bit_length()
        planes = [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(top)]
    while planes and not any(planes[-1]):
        planes.pop()
    return planes


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    out = np.zeros(count, dtype="<u4")
    for k, p in enumerate(planes):
        if kind == "byte":
            out |= np.frombuffer(p, np.uint8).astype("<u4") << np.uint32(8 * k)
        else:
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=count).astype("<u4") << np.uint32(k)
    return out


class PlaneWriter:
    """Appends ids to one file; closing writes the chunk index and its length."""

    def __init__(self, sink, kind: str = "bit", block: int = BLOCK):
        if kind not in ("bit", "byte"):
            raise ValueError(f"plane kind {kind!r}")
        self.sink, self.kind, self.block = sink, kind, block
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.at, self.count, self.chunks = len(MAGIC), 0, []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        sink.write(MAGIC)

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.count += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.waiting)
            whole = len(every) // self.block * self.block
            for k in range(0, whole, self.block):
                self._write(every[k : k + self.block])
            self.waiting, self.held = [every[whole:]], len(every) - whole

    def _write(self, ids: np.ndarray) -> None:
        sizes = []
        for p in to_planes(ids, self.kind):
            packed = self.squeeze.compress(p)
            self.sink.write(packed)
            sizes.append(len(packed))
        self.chunks.append([self.at, sizes])
        self.at += sum(sizes)

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.waiting))
        foot = json.dumps({"kind": self.kind, "block": self.block, "count": self.count, "chunks": self.chunks}).encode()
        self.sink.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.sink.close()


class PlaneReader:
    """Random access to a file of planes by its chunk index."""

    def __init__(self, source):
        size = source.size()
        source.seek(size - 16)
        length, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("no file of id planes")
        source.seek(size - 16 - length)
        foot = json.loads(source.read(length))
        self.source, self.kind, self.block, self.count, self.chunks = source, foot["kind"], foot["block"], foot["count"], foot["chunks"]
        self.expand = zstandard.ZstdDecompressor()
        self._held: tuple[int, np.ndarray] | None = None

    def chunk(self, k: int) -> np.ndarray:
        if self._held is None or self._held[0] != k:
            at, sizes = self.chunks[k]
            self.source.seek(at)
            count = min(self.block, self.count - k * self.block)
            size = count if self.kind == "byte" else -(-count // 8)
            raw, planes, o = self.source.read(sum(sizes)), [], 0
            for s in sizes:
                planes.append(self.expand.decompress(raw[o : o + s], max_output_size=size))
                o += s
            self._held = (k, from_planes(planes, count, self.kind))
        return self._held[1]

    def read(self, start: int, count: int) -> np.ndarray:
        parts = []
        while count:
            k, o = divmod(start, self.block)
            part = self.chunk(k)[o : o + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(parts) if parts else np.empty(0, dtype="<u4")


#: The lower-casing word tokenizer whose plain words can go straight to its model (fixed values of that tokenizer's definition).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Letters that composition leaves alone and that lower one to one, then ASCII punctuation other than the apostrophe.
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")
#: Byte-level alphabet: printable Latin-1 bytes stand for themselves, the other bytes follow from 0x100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LEVEL = {b: chr(b) for b in PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
BYTE_LEVEL = {c: "".join(LEVEL[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder:
    """Encodes texts with a tokenizer that never merges across white space.

    Texts are cut at plain white space, each distinct word is encoded once by the
    library and its ids are placed wherever the word occurs.  Plain words (Latin
    letters, then ASCII punctuation) go straight to the library's model; all
    others pass its normalizer and splitter as well.  Whether a tokenizer may be
    treated so is read from its definition; any other one gets whole texts.
    """

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = SegmentTable(self._encode, cached)
        self.by_word = self._known(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _known(spec: dict) -> bool:
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != WORD_NORMALIZERS or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            return False
        split, level = splits
        return (
            split["pattern"] == {"Regex": WORD_PATTERN} and split["behavior"] == "Removed" and split["invert"] is True
            and level["add_prefix_space"] is False and level["use_regex"] is False and spec.get("post_processor") is None
            and all("<" in t["content"] and not set(" \t\r\n") & set(t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        )

    def _pieces(self, words: list[str]) -> list[list[int]]:
        tokenize, plain = self.model.tokenize, PLAIN_WORD.fullmatch

        class Known(dict):
            def __missing__(self, core: str) -> list[int]:
                self[core] = ids = [t.id for t in tokenize(core if core.isascii() else core.translate(BYTE_LEVEL))]
                return ids

        known, out, rest = Known({"": []}), [], []
        for w in words:
            m = plain(w)
            if m and "<|" not in w:
                core, marks = m.groups()
                out.append(known[core.lower()] + known[marks] if marks else known[core.lower()])
            else:
                rest.append((len(out), w))
                out.append([])
        for (k, _), e in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        collecting = gc.isenabled()
        gc.disable()  # very many small lists, none of them in a cycle
        try:
            ids = self._pieces([w.decode() for w in words])
        finally:
            if collecting:
                gc.enable()
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return counts, np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(counts.sum()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raw = [t.encode("utf-8") for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        begin, end = runs(~BLANK[data])
        counts, ids = self.table(data, begin, end)
        # Where each text's words, and so its ids, begin.
        ends = np.cumsum([len(r) + 1 for r in raw])
        upto = np.concatenate([[0], np.cumsum(counts)])
        return np.split(ids, upto[np.searchsorted(begin, ends)[:-1]]) if texts else []


#: The white space at which texts are cut; more kinds lie inside the pieces and are the library's business.
BLANK = np.isin(np.arange(256), list(b" \n\t\r"))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def library_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """An encoder for ``write_planes``: each worker loads the tokenizer file of that path."""
    return lambda texts: _encoder(path).encode(texts)


INDEX = "doc_id long, part int, seq int, file string, at long, n_tokens long"


def write_planes(df: DataFrame, id_col: str, text_col: str, encode: Callable[[list[str]], list[np.ndarray]], end_id: int | None, folder: str | None = None, kind: str = "bit", block: int = BLOCK) -> DataFrame:
    """Encode every text and write the ids in ascending order of ``id_col``; returns the document index.

    The index has doc_id, part, seq (place in the part), file, folder, at (offset
    in the file), n_tokens and start (ids of all documents before it).  Null texts
    are empty and still get ``end_id``; equal ids stay together in any order, null
    ids come first; an empty table writes nothing.
    """
    spark = df.sparkSession
    folder = folder or scratch(spark, "planes")
    tail = np.array([] if end_id is None else [end_id], dtype="<u4")
    names = [x.split()[0] for x in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part:06d}-{context.taskAttemptId()}.planes"
        out, seq = None, 0
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE_BYTES):
                out = out or PlaneWriter(where.open_output_stream(f"{root}/{name}", compression=None), kind, block)
                counts, first = [], out.count
                for ids in encode([t or "" for t in strings(piece.column("text"))]):
                    out.append(ids)
                    out.append(tail)
                    counts.append(len(ids) + len(tail))
                counts = np.array(counts, dtype=np.int64)
                n = len(counts)
                columns = [piece.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n, dtype=np.int32)), pa.array([name] * n), pa.array(first + np.cumsum(counts) - counts), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names)
                seq += n
        if out:
            out.close()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    index = written(ordered.mapInArrow(write, INDEX), "planes-index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one line per file
    before, at = [], 0
    for r in totals:
        before.append((r["part"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return index.join(offsets, "part").select("doc_id", "part", "seq", F.lit(folder).alias("folder"), "file", "at", (F.col("before") + F.col("at")).alias("start"), "n_tokens")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_planes(index: DataFrame, ids: bool = True) -> DataFrame:
    """Read documents back through the index: doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit; null if not asked for)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if (r["folder"], r["file"]) != opened:
                    where, root = fs.FileSystem.from_uri(r["folder"])
                    opened, reader = (r["folder"], r["file"]), PlaneReader(where.open_input_file(f"{root}/{r['file']}"))
                data = reader.read(r["at"], r["n_tokens"]).tobytes()
                rows.append((r["doc_id"], r["start"], len(data) // 4, zlib.crc32(data), data if ids else None))
                held += len(data) if ids else 0
                if held > SLICE_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    spark = index.sparkSession
    return index.repartition(partitions(spark), "folder", "file").sortWithinPartitions("folder", "file", "at").mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])
