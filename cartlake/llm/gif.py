"""GIF: encoding of indexed pixels and decoding of files into timed, composed frames."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Frame(NamedTuple):
    """The canvas as shown for ``delay_ms``."""

    delay_ms: int
    disposal: int
    transparent: bool
    rgb: np.ndarray  # height x width x 3


def colour_cube() -> np.ndarray:
    """256 colours, one for each byte: three bits of red, three of green, two of blue."""
    index = np.arange(256)
    return np.stack([(index >> 5) * 36, (index >> 2 & 7) * 36, (index & 3) * 85], axis=1).astype(np.uint8)


@functools.cache
def _widths(depth: int) -> np.ndarray:
    """Bits of the codes after a clear code: a code's width follows from how many there were, as each of them adds an entry."""
    entries = (1 << depth) + 1 + np.arange(1 << 13)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, depth + 1, 12)


def lzw_encode(pixels: bytes, depth: int = 8) -> bytes:
    """Variable-width LZW codes of the pixels, packed from the low bit on; the table is a tree of dictionaries that hold their code at -1."""
    clear = 1 << depth
    codes, next_code, node = [clear], clear + 2, None
    roots, append = [{-1: i} for i in range(clear)], codes.append
    for pixel in pixels[:1]:
        node = roots[pixel]
    for pixel in pixels[1:]:
        longer = node.get(pixel)
        if longer:
            node = longer
            continue
        append(node[-1])
        if next_code < 4096:
            node[pixel] = {-1: next_code}
            next_code += 1
        else:
            append(clear)
            roots, next_code = [{-1: i} for i in range(clear)], clear + 2
        node = roots[pixel]
    if node:
        append(node[-1])
    append(clear + 1)
    code_of, places = np.asarray(codes, np.uint16), np.arange(len(codes))
    last_clear = np.maximum.accumulate(np.where(code_of[:-1] == clear, places[:-1], 0))
    width_of = np.concatenate([[depth + 1], _widths(depth)[np.minimum(places[1:] - last_clear - 1, (1 << 13) - 1)]])
    bits = (code_of[:, None] >> np.arange(12, dtype=np.uint16) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width_of[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, depth: int, n_pixels: int) -> bytes:
    """Pixels of a code stream; one that ends before the image is full is an error, what exceeds the image is left out.

    The codes up to the next clear code are cut out of the stream together, since their widths are known beforehand.
    """
    clear, widths = 1 << depth, _widths(depth)
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    bits, stream = 8 * len(data), np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    out: list[bytes] = []
    table, before, done, pos, since = literals[:], b"", 0, 0, 0
    while done < n_pixels:
        width = widths[since : since + 4096] if since < 4096 else np.full(4096, 12)
        width = width[: (bits - pos) // (depth + 1) + 1]
        at = pos + np.cumsum(width) - width
        at = at[at + width <= bits]
        if not len(at):
            raise ValueError(f"the code stream ends after {done} of {n_pixels} pixels")
        width, byte = width[: len(at)], at >> 3
        codes = (stream[byte] | stream[byte + 1] << 8 | stream[byte + 2] << 16) >> (at & 7) & (1 << width) - 1
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        pieces: list[bytes] = []
        append, grow, size = pieces.append, table.append, len(table)
        for code in codes[:n].tolist():
            if code < size:
                piece = table[code]
            elif before and code == size < 4096:
                piece = before + before[:1]
            elif done + sum(map(len, pieces)) >= n_pixels:
                break
            else:
                raise ValueError(f"LZW code {code} before it is defined")
            if before and size < 4096:
                grow(before + piece[:1])
                size += 1
            append(piece)
            before = piece
        out += pieces
        done += sum(map(len, pieces))
        last = min(n, len(codes) - 1)
        pos, since = int(at[last] + width[last]), since + n
        if n < len(codes):
            if codes[n] != clear and done < n_pixels:
                raise ValueError(f"the code stream ends after {done} of {n_pixels} pixels")
            table, before, since = literals[:], b"", 0
    return b"".join(out)[:n_pixels]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(frames: list[bytes], width: int, *, delay_cs: int = 10, palette: np.ndarray | None = None) -> bytes:
    """A file whose frames hold these pixel indices, row by row, each replacing the top of the canvas."""
    heights = [len(f) // width for f in frames]
    colours = colour_cube() if palette is None else palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, max(heights), 0xF7, 0, 0), colours.astype(np.uint8).tobytes()]
    for pixels, height in zip(frames, heights, strict=True):
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08" + _blocks(lzw_encode(pixels)))
    return b"".join(out) + b"\x3b"


def decode(data: bytes) -> Iterator[Frame]:
    """Composed frames of a file: palettes, interlacing, transparency and disposal applied; a broken or cut file is an error
    where the damage is reached."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, clear_index = 0, 0, None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = sub_blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            at = after
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, palette = at + 10, shared
            if flags & 0x80:
                n = 3 << (flags & 7) + 1
                palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
            if palette is None:
                raise ValueError("an image without any palette")
            depth = data[at]
            codes, at = sub_blocks(at + 1)
            index = np.frombuffer(lzw_decode(codes, depth, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(index)
                plain[order] = index
                index = plain
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            shown = index[: area.shape[0], : area.shape[1]]
            colours = palette[np.minimum(shown, len(palette) - 1)]
            area[:] = colours if clear_index is None else np.where((shown == clear_index)[..., None], area, colours)
            yield Frame(delay * 10, disposal, clear_index is not None, canvas.copy())
            if disposal == 2:
                area[:] = 0
            elif before is not None:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
        else:
            raise ValueError(f"unknown block {data[at]:#x}")
    if at >= len(data):
        raise ValueError("the file ends without its trailer")


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Pixels of each of 8 reds, 8 greens and 4 blues."""
    pixels = rgb.reshape(-1, 3)
    return np.concatenate([np.bincount(pixels[:, c] >> s, minlength=256 >> s) for c, s in ((0, 5), (1, 5), (2, 6))])
