"""Media columns: GIF files in a binary column and their timed frames with colour histograms.

``store_payloads`` writes bytes as GIF pixels, one palette index a byte, in frames of bounded size.
``gif_frames`` decodes any GIF column, one row a frame, and ``payload_features`` reads stored payloads back.

Defined cases: null text is empty and becomes one line of blanks; a null or broken file gives one row without a
frame and with its error; equal payloads give equal files and features; rows repeat as given; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.llm import gif
from cartlake.llm.columns import map_batches, need, utf8

WIDTH, FRAME_LINES = 192, 64
STORED = "doc_id long, n_bytes long, media binary"
FRAMES = "media_id long, frame int, start_ms long, delay_ms long, width int, height int, disposal int, transparent boolean, red array<long>, green array<long>, blue array<long>, rgb binary, error string"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long, red array<long>, green array<long>, blue array<long>"


def _fit(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b" ")


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF file that holds the text's UTF-8 bytes, padded by blanks to whole lines."""
    size = WIDTH * FRAME_LINES

    def work(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = part.column(1).to_pylist()
            files = [gif.encode([p[i : i + size] for i in range(0, len(p), size)], WIDTH) for p in map(_fit, texts)]
            yield {"doc_id": part.column(0), "n_bytes": list(map(len, texts)), "media": files}

    return map_batches(need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), utf8()), work, STORED)


def gif_frames(media: DataFrame, id_column: str = "media_id", file_column: str = "media", *, keep_pixels: bool = False) -> DataFrame:
    """One row for each composed frame of each file: its times, its colour histograms and, if asked for, its pixels."""
    names = FRAMES.replace("array<long>", "array").split(", ")

    def work(batch: pa.RecordBatch):
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            start = 0
            try:
                for k, frame in enumerate(gif.decode(data or b"")):
                    bins = gif.histogram(frame.rgb)
                    height, width, _ = frame.rgb.shape
                    rows.append((key, k, start, frame.delay_ms, width, height, frame.disposal, frame.transparent, bins[:8], bins[8:16], bins[16:], frame.rgb.tobytes() if keep_pixels else None, None))
                    start += frame.delay_ms
            except (ValueError, IndexError, OSError) as broken:
                rows = [(key, *[None] * 11, str(broken))]
            except Exception as broken:  # struct.error of a cut header
                rows = [(key, *[None] * 11, f"cut short: {broken}")]
            yield {n.split()[0]: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_batches(need(media, id_column, file_column).toDF("media_id", "media"), work, FRAMES)


def payload_features(stored: DataFrame) -> DataFrame:
    """What the stored files hold, read back through palette and composition, with digests and colour histograms."""

    def work(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 64):
            yield {n.split()[0]: c for n, c in zip(FEATURES.split(", "), zip(*(one(*r) for r in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)), strict=True), strict=True)}

    def one(doc: int | None, n_bytes: int, media: bytes) -> tuple:
        parts, bins, length = [], np.zeros(20, np.int64), 0
        frames = 0
        for frame in gif.decode(media):
            # The canvas is as high as the highest frame; the last one may fill only its top.
            red, green, blue = (frame.rgb[..., c].reshape(-1) for c in range(3))
            parts.append((red >> 5 << 5 | green >> 5 << 2 | blue >> 6).tobytes())
            length, frames = length + frame.delay_ms, frames + 1
        size = max(1, -(-n_bytes // WIDTH)) * WIDTH
        whole = b"".join(parts)[:size]
        index = np.frombuffer(whole, np.uint8)
        for c, (shift, mask, base, n) in enumerate(((5, 7, 0, 8), (2, 7, 8, 8), (0, 3, 16, 4))):
            bins[base : base + n] = np.bincount(index >> shift & mask, minlength=n)
        return doc, n_bytes, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, (frames, length, *bins.tolist()))), frames, length, bins[:8].tolist(), bins[8:16].tolist(), bins[16:].tolist()

    return map_batches(need(stored, "doc_id", "n_bytes", "media"), work, FEATURES)
