"""Seekable Zstandard bundles of WARC records.

Every task writes one archive: records grouped into independent zstd frames,
then a seek table in a skippable frame (the layout of Zstandard's seekable
format), then nothing else, so any zstd tool can read the file.  An index table
maps each record id to (file, frame, offset inside the frame, length).  A
retried task writes a new file under its own attempt name; only files named by
the index are ever read, so a lost executor leaves no wrong record behind.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.llm.common import partitions, scratch, text_slices, written

FRAME_BYTES = 1 << 20       # records are added to a frame until it holds this much
SKIPPABLE = 0x184D2A5E      # fixed value of the seekable format
SEEKABLE = 0x8F92EAB1       # fixed value of the seekable format
CRLF = b"\r\n"

INDEX = "id long, file string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer for frames given as (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of every frame, from the end of an open random-access file."""
    source.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    source.seek(size - 9 - 8 * count)
    sizes = np.frombuffer(source.read(8 * count), "<u4").reshape(count, 2).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes[:, 0])])[:count]
    return [(int(o), int(c), int(d)) for o, (c, d) in zip(offsets, sizes)]


def record(kind: str, record_id: int, uri: str, date: str, payload: bytes, digest: str, refers_to: int | None, refers_uri: str | None) -> bytes:
    """A WARC/1.1 record.  A revisit has no payload but names the record it repeats."""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        f"WARC-Record-ID: <urn:page:{record_id}>".encode(),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + uri.encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Payload-Length: " + str(len(payload)).encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    block = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + CRLF
    if kind == "revisit":
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>".encode(),
            b"WARC-Refers-To-Target-URI: " + (refers_uri or "").encode(),
        ]
    else:
        block += payload
    head.append(b"Content-Length: " + str(len(block)).encode())
    return CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    headers = {k.decode(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(CRLF + CRLF)[2]


def _clean(uri: str | None) -> str:
    """A header value holds no line break."""
    return (uri or "").replace("\r", "%0D").replace("\n", "%0A")


def decided(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """id, uri, payload, digest, refers_to and refers_uri: which rows repeat an equal payload of at least ``least`` bytes.

    The row with the largest id is the response.  The table of repeated payloads
    is made from digests alone (map-side combined); the payloads meet it in one
    outer join that adaptive execution may split or broadcast by measured size.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "utf-8"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("uri"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max_by(F.struct("id", "uri"), "id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", F.col("first.id").alias("first_id"), F.col("first.uri").alias("first_uri"))
    )
    joined = rows.join(repeated, "digest", "left")
    again = F.col("first_id") != F.col("id")
    return joined.select("id", "uri", "payload", "digest", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_uri")).alias("refers_uri"))


def write_archives(df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str | None = None, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per task below ``folder`` (a URI all executors reach) and return the index table.

    A null payload is empty.  Payloads of at least ``least`` bytes that repeat
    become revisits of the row with the largest id; rows that repeat that id as
    well are responses of their own.  Ids must not be null to be found again; a
    null id is written and indexed under null.  An empty table gives an empty
    index.  Very long payloads fill a frame of their own.
    """
    folder = folder or scratch(df.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.zst"
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=True)
        out, at, frames = None, 0, []
        buffer, waiting, filled = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, at, buffer, waiting, filled
            out = out or where.open_output_stream(f"{root}/{name}", compression=None)
            raw = b"".join(buffer)
            packed = squeeze.compress(raw)
            out.write(packed)
            rows = [(i, name, len(frames), at, len(packed), o, n) for i, o, n in waiting]
            frames.append((len(packed), len(raw)))
            at += len(packed)
            buffer, waiting, filled = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names)

        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for part in text_slices(batch, "payload", FRAME_BYTES):
                for i, uri, payload, digest, first, first_uri in zip(*(part.column(k).to_pylist() for k in ("id", "uri", "payload", "digest", "refers_to", "refers_uri"))):
                    data = record("response" if first is None else "revisit", i, _clean(uri), date, payload, digest, first, _clean(first_uri))
                    waiting.append((i, filled, len(data)))
                    buffer.append(data)
                    filled += len(data)
                    if filled >= FRAME_BYTES:
                        yield flush()
        if buffer:
            yield flush()
        if out:
            out.write(seek_table(frames))
            out.close()

    rows = decided(df, id_col, url_col, payload_col, least)
    return written(rows.mapInArrow(write, INDEX).withColumn("folder", F.lit(folder)), "warc-index")


READ = "id long, uri string, kind string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read records back through the index: one seek and one frame at a time.

    Rows are (id, uri, kind, payload_bytes, payload_digest, refers_to, payload).
    The payload's digest is computed from the bytes read and compared with the
    record's header; a revisit has a null payload and the full payload's size and digest from its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        key, raw, opened, source, table = None, b"", None, None, []
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if (r["folder"], r["file"]) != opened:
                    where, root = fs.FileSystem.from_uri(r["folder"])
                    source = where.open_input_file(f"{root}/{r['file']}")
                    table, opened, key = read_seek_table(source, source.size()), (r["folder"], r["file"]), None
                if r["frame"] != key:
                    offset, packed, size = table[r["frame"]]
                    source.seek(offset)
                    raw, key = expand.decompress(source.read(packed), max_output_size=size), r["frame"]
                    if len(raw) != size:
                        raise ValueError(f"frame {key} in {r['file']} is damaged")
                head, payload = parse(raw[r["record_offset"] : r["record_offset"] + r["record_bytes"]])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = head["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"record {r['id']} in {r['file']} is damaged")
                first = int(head["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
                rows.append((r["id"], head["WARC-Target-URI"], kind, int(head["WARC-Payload-Length"]), digest, first, payload if payloads and kind == "response" else None))
                held += len(payload) if payloads else 0
                if held > 4 * FRAME_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    # Frames stay together and in order; a file with many records is spread by its frames.
    spread = index.repartition(partitions(index.sparkSession), "folder", "file", F.expr("frame div 16")).sortWithinPartitions("folder", "file", "frame", "record_offset")
    return spread.mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])
