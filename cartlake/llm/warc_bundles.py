"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at a bundle's end holds the
seek table (sizes of all frames) and each bundle carries an index from record identifiers to frame and offset.
Of records with equal payloads of at least ``min_bytes``, the one with the smallest identifier is the response
and the others are revisits that refer to it. Bundles are rows of a stored table, of bounded size, written by
independent tasks.

Defined cases: null html is an empty payload; payloads below ``min_bytes`` are all responses; rows with a null
page_id are responses of their own and never referred to; of repeated rows with one page_id the payloads are
equal or not: each row is a record, and a payload's rows with the response's own id are responses too; empty
tables give empty results; null urls are written as an empty target; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.llm.columns import _arrow, map_batches, need, record
from cartlake.llm.staging import staged

BUNDLES = "bundle string, content binary, entries array<struct<record_id: string, page_id: bigint, frame: int, offset: bigint, length: bigint>>"
READ = "page_id long, record_id string, record_type string, refers_to long, block_bytes long, block_digest string, named_digest string"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format


def classify(pages: DataFrame, *, min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest, and refers_to (null for responses). Hot payloads meet as counts, not as rows."""
    rows = need(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_bytes
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(first.withColumnRenamed("digest", "same"), large & (F.col("digest") == F.col("same")), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def _record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Target-URI: {' '.join((url or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        lines.insert(3, f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def page_urn(page_id: int) -> str:
    """The record identifier of a page."""
    return f"<urn:page:{page_id}>"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists compressed and plain sizes of the frames before it."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    sizes = struct.iter_unpack("<II" + "4x" * (width == 12), content[-9 - n * width : -9])
    table, at = [], 0
    for packed, _ in sizes:
        table.append((at, packed))
        at += packed
    return table


def read_frame(content: bytes, table: list[tuple[int, int]], frame: int) -> bytes:
    """One frame's plain bytes; no other frame is touched."""
    at, size = table[frame]
    return zstandard.ZstdDecompressor().decompress(content[at : at + size])


def write_bundles(records: DataFrame, *, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 24, level: int = 3) -> DataFrame:
    """Bundles of the classified records, stored in the shared folder. A task holds one bundle at a time."""
    kinds = _arrow(BUNDLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        content, frames, entries, frame, size = [], [], [], [], 0

        def close_frame() -> None:
            nonlocal size
            plain = b"".join(frame)
            content.append(packer.compress(plain))
            frames.append((len(content[-1]), len(plain)))
            frame.clear()
            size += len(content[-1])

        def close_bundle() -> pa.RecordBatch:
            nonlocal size
            whole = b"".join(content) + seek_table(frames)
            out = record({"bundle": [hashlib.sha256(whole).hexdigest()[:32]], "content": [whole], "entries": [entries[:]]}, kinds)
            content.clear(), frames.clear(), entries.clear()
            size = 0
            return out

        plain = 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to, unnamed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record_id = page_urn(page_id) if page_id is not None else f"<urn:unnamed:{digest[:16]}-{unnamed}>"
                data = _record(record_id, page_id, url, payload, digest, refers_to)
                entries.append({"record_id": record_id, "page_id": page_id, "frame": len(frames), "offset": plain, "length": len(data)})
                frame.append(data)
                plain += len(data)
                if plain >= frame_bytes:
                    close_frame()
                    plain = 0
                    if size >= bundle_bytes:
                        yield close_bundle()
        if frame:
            close_frame()
        if frames:
            yield close_bundle()

    ordered = records.sortWithinPartitions("page_id", "digest").withColumn("unnamed", F.monotonically_increasing_id())
    return staged(ordered.select("page_id", "url", "payload", "digest", "refers_to", "unnamed").mapInArrow(run, BUNDLES), "warc")


def read_records(bundles: DataFrame) -> DataFrame:
    """What the bundles hold, record by record, each found by frame and offset; digests are of the bytes read."""

    def work(batch: pa.RecordBatch):
        for content, entries in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            table, at, plain, rows = read_seek_table(content), -1, b"", []
            for entry in entries:
                if entry["frame"] != at:
                    at = entry["frame"]
                    plain = read_frame(content, table, at)
                rows.append(_parse(plain[entry["offset"] : entry["offset"] + entry["length"]]))
            yield {n.split()[0]: [r[i] for r in rows] for i, n in enumerate(READ.split(", "))}

    return map_batches(bundles.select("bundle", "content", "entries"), work, READ)


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(named["Content-Length"])].partition(b"\r\n\r\n")[2]
    refers = named.get("WARC-Refers-To")
    page = named.get("WARC-Page-ID")
    return None if page is None else int(page), named["WARC-Record-ID"], named["WARC-Type"], None if refers is None else int(refers[10:-1]), len(payload), hashlib.sha256(payload).hexdigest(), named["WARC-Payload-Digest"].partition(":")[2]


def lookup(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """record_id and data of the named records: the index picks bundle, frame and offset, and one frame is opened for each."""
    index = bundles.select("bundle", F.inline("entries"))
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length", "record_id")).alias("wanted"))

    def work(batch: pa.RecordBatch):
        for content, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table = read_seek_table(content)
            yield {"record_id": [p["record_id"] for p in places], "data": [read_frame(content, table, p["frame"])[p["offset"] : p["offset"] + p["length"]] for p in places]}

    return map_batches(bundles.join(wanted, "bundle").select("content", "wanted"), work, "record_id string, data binary")


def archive_pages(pages: DataFrame, *, min_bytes: int = 100) -> DataFrame:
    """Writes the pages' records, reads the bundles back and resolves each revisit to its response's payload."""
    read = staged(read_records(write_bundles(classify(pages, min_bytes=min_bytes))), "records")
    responses = read.where("record_type = 'response' and page_id is not null").groupBy(F.col("named_digest").alias("digest")).agg(F.min("page_id").alias("first_id"), F.min_by("block_bytes", "page_id").alias("bytes"), F.min_by("block_digest", "page_id").alias("found"))
    revisits = read.where("record_type = 'revisit'").join(responses, F.col("named_digest") == F.col("digest"), "left")
    columns = ["page_id", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(*columns, F.col("block_bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest")).unionByName(revisits.select(*columns, F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest")))
