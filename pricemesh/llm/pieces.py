"""SentencePiece encoding that keeps, for every piece, its bytes in the original text.

Text is normalised here: at each place the longest prefix found in the model's
compiled character map is replaced, and every normalised byte remembers where it
came from.  The normalised text is then cut where no piece of the vocabulary can
reach across, each distinct segment is encoded once by the library, and piece
lengths are summed back through the alignment.  Models, texts or characters for
which cutting would not be safe are encoded as whole texts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.llm.common import strings, text_slices
from pricemesh.llm.segments import SegmentTable

SLICE_BYTES = 512 << 10
CACHED_BYTES = 24 << 20  # of encoded segments that one Python worker remembers
META = "▁"              # how the models write a blank


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 bytes and a pool of replacements."""

    def __init__(self, blob: bytes):
        self.empty = not blob
        if not self.empty:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that is a prefix of ``data[at:]``."""
        if self.empty:
            return None
        units, found = self.units, None
        node = self._child(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\x00", found[1])]

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


def _width(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """Normalised text with blanks still as blanks, and the original offset of each of its bytes (one more at the end)."""

    def __init__(self, charmap: CharMap, dummy: bool, squeeze: bool):
        self.charmap, self.dummy, self.squeeze = charmap, dummy, squeeze
        self.plain = charmap.empty and not squeeze

    def _pieces(self, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(raw):
            hit = self.charmap.longest(raw, at)
            if hit is None:
                n = _width(raw[at])
                yield at, n, raw[at : at + n]
            else:
                n = hit[0]
                yield at, n, hit[1]
            at += n

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode("utf-8")
        out, align, blank, end = bytearray(), [], self.squeeze, 0
        begun = False
        for at, n, new in self._pieces(raw):
            if self.squeeze and blank:
                new = new.lstrip(b" ")
            if not new:
                continue
            if not begun:
                begun = True
                if self.dummy:
                    out += b" "
                    align.append(at)
            out += new
            align += [at] * len(new)
            blank, end = self.squeeze and new.endswith(b" "), at + n
        while self.squeeze and out.endswith(b" ") and len(out) > 0:
            out.pop()
            end = align.pop()
        align.append(end)
        return bytes(out), np.array(align, dtype=np.int64)


class PieceEncoder:
    """Encoder for one model file."""

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalizer = Normalizer(CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        kinds = model.SentencePiece
        words = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        # Cutting is safe if blanks only ever lead a piece and nothing is matched ahead of the merges.
        self.safe = (
            spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(META in p.lstrip(META) for p in words) and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        )
        self.lone_line = not any("\n" in p for p in words)
        # The same model for text that is normalised already.
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        spec.precompiled_charsmap = b""
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.safe = self.safe and self.bare.encode(" a") == [x for x in self.bare.encode(META + "a")]
        # Bytes of the original that a piece stands for: blanks are one byte there, byte pieces one, unknowns are asked for.
        self.lengths = np.array(
            [1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else 0 if p.type == kinds.CONTROL else len(p.piece.replace(META, " ").encode()) for p in model.pieces], dtype=np.int64
        )
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.table = SegmentTable(self._encode, cached)

    def _sizes(self, segment: bytes, ids: list[int]) -> list[int]:
        sizes = [int(self.lengths[i]) for i in ids]
        unknown = [k for k, s in enumerate(sizes) if s < 0]
        if unknown:
            pieces = self.bare.encode(segment.decode(), out_type="immutable_proto").pieces
            for k in unknown:
                sizes[k] = len(pieces[k].surface.encode())
        return sizes

    def _encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of normalised segments, as the two columns of one array."""
        found = self.bare.encode([s.decode("utf-8") for s in segments], num_threads=1)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(counts.sum()))
        sizes = self.lengths[ids]
        if (sizes < 0).any():
            sizes = np.array([n for s, i in zip(segments, found) for n in self._sizes(s, i)], dtype=np.int64)
        return counts, np.stack([ids, sizes.astype(np.int32)], axis=1)

    def _segments(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and piece sizes (in bytes, blanks as one) of normalised, non-empty texts."""
        whole = b"".join(texts)
        data = np.frombuffer(whole, dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        blank = data == 0x20
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        if self.lone_line:
            line = data == 0x0A
            cut |= line
            cut[1:] |= line[:-1]
        if len(data):
            cut[np.concatenate([[0], ends[:-1]])] = True
        begin = np.flatnonzero(cut)
        end = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
        counts, values = self.table(data, begin, end)
        upto = np.concatenate([[0], np.cumsum(counts)])
        borders = upto[np.searchsorted(begin, ends)[:-1]]
        return np.split(values[:, 0], borders), np.split(values[:, 1], borders)

    def _whole(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A normalised text that must not be cut."""
        ids = self.bare.encode(text.decode())
        sizes = [len(x) for x in self._surfaces(text.decode(), ids)]
        return np.array(ids, dtype="<i4"), np.array(sizes, dtype=np.int64)

    def _surfaces(self, text: str, ids: list[int]) -> Iterator[bytes]:
        """Normalised bytes of each piece; a literal meta symbol and a blank look alike in a piece, so the text decides."""
        raw, at = text.encode(), 0
        proto = None
        for k, i in enumerate(ids):
            if self.lengths[i] < 0:
                proto = proto or self.bare.encode(text, out_type="immutable_proto").pieces
                n = len(proto[k].surface.encode())
            elif self.library.is_byte(i):
                n = 1
            else:
                n = 0
                for c in self.library.id_to_piece(i):
                    n += 1 if c == META and raw[at + n : at + n + 1] == b" " else len(c.encode())
            yield raw[at : at + n]
            at += n

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True, spans: bool = True) -> list[tuple[np.ndarray, ...]]:
        """(ids, begins, ends) of every text, or (ids,) without spans; begins and ends are bytes of the original.

        End symbols are empty spans at the edges.
        """
        norm: list[tuple[bytes, np.ndarray | None]] = []
        for t in texts:
            if not t:
                norm.append((b"", None))
            elif self.normalizer.plain:
                norm.append(((b" " if self.normalizer.dummy else b"") + t.encode("utf-8"), None))
            else:
                norm.append(self.normalizer.normalise(t))
        meta = META.encode()
        cut = [k for k, (n, _) in enumerate(norm) if n and self.safe and meta not in n]
        ids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if cut:
            a, b = self._segments([norm[k][0] for k in cut])
            ids = dict(zip(cut, zip(a, b)))
        nothing = (np.empty(0, dtype="<i4"), np.empty(0, dtype=np.int64))
        out = []
        for k, (n, align) in enumerate(norm):
            i, sizes = ids[k] if k in ids else self._whole(n) if n else nothing
            if not spans:
                out.append((np.concatenate([[self.bos] if bos else [], i, [self.eos] if eos else []]).astype("<i4"),))
                continue
            ends = np.cumsum(sizes, dtype=np.int64)
            begins = ends - sizes
            if align is not None:
                begins, ends = align[begins], align[ends]
            elif self.normalizer.dummy and len(ends):  # the blank put in front is no byte of the original
                begins, ends = np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)
            last = int(ends[-1]) if len(ends) else 0
            head, tail = ([self.bos], [0]) if bos else ([], []), ([self.eos], [last]) if eos else ([], [])
            out.append((
                np.concatenate([head[0], i, tail[0]]).astype("<i4"),
                np.concatenate([head[1], begins, tail[1]]).astype(np.int32),
                np.concatenate([head[1], ends, tail[1]]).astype(np.int32),
            ))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([i.tolist() for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


RESULT = "ids binary, begins array<int>, ends array<int>, decoded string"


def encode_pieces(df: DataFrame, id_col: str, text_col: str, model: str, bos: bool = True, eos: bool = True, decode: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, ids (little-endian 32-bit), begins, ends (bytes of the original text) and decoded text.

    ``model`` is the path of a model file that every executor has.  A null text is
    an empty one: nothing but the end symbols.  Ids may repeat or be null; other
    columns are ignored; an empty table gives an empty result.  A very long text is
    encoded whole, in a batch of its own.  ``decode`` False leaves ``decoded`` null.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                found = coder.encode([t or "" for t in strings(part.column("text"))], bos, eos)
                counts = np.array([len(f[0]) for f in found])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([f[0].tobytes() for f in found], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[1] for f in found]))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[2] for f in found]))),
                        pa.array(coder.decode([f[0] for f in found]), pa.string()) if decode else pa.nulls(len(found), pa.string()),
                    ],
                    [id_col, "ids", "begins", "ends", "decoded"],
                )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")
