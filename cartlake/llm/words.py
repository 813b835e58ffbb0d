"""Words and shingles of texts as 64-bit hashes, computed over many texts at once in numpy.

Words are runs of bytes other than space and \\x09-\\x0D of the text's UTF-8 form, ASCII letters in lower case.
A word is read in blocks of eight bytes; the hash is mixed after each, so that no sum of a word's bytes decides it.
Words of more than ``LONG`` bytes take a digest of their bytes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
LONG = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HELD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # bits of n bytes


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer that makes every bit of a hash depend on every other."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the place of each text's first word (with the end as last entry)."""
    whole = b" ".join([*texts, b""]).lower() + bytes(8)
    joined = np.frombuffer(whole, np.uint8)[:-8]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    change = np.flatnonzero(np.diff(~_SPACE[joined], prepend=False, append=False))
    starts, lengths = change[::2], change[1::2] - change[::2]
    eight = np.ndarray(len(joined), "<u8", whole, strides=(1,))  # the eight bytes from each place on
    hashes = mix(lengths.astype(np.uint64) * _BASE)
    on, at = np.flatnonzero(lengths <= LONG), 0
    while len(on):
        left = lengths[on] - at
        hashes[on] = mix((hashes[on] ^ (eight[starts[on] + at] & _HELD[np.minimum(left, 8)])) * _BASE)
        on, at = on[left > 8], at + 8
    for i in np.flatnonzero(lengths > LONG):
        hashes[i] = _digest(whole[starts[i] : starts[i] + lengths[i]])
    return hashes, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, by their first word."""
    n = len(hashes) - length + 1
    total = np.zeros(max(0, n), np.uint64)
    for j in range(length) if n > 0 else ():
        total = mix(total * _BASE + hashes[j : j + n])
    return total


def shingle_sets(texts: list[bytes], length: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text: runs of ``length`` words, or all its words if fewer, or nothing."""
    for lo, hi in blocks(texts):
        hashes, first = hash_words(texts[lo:hi])
        all_runs = runs(hashes, length)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= length:
                yield np.unique(all_runs[a : b - length + 1])
            else:
                yield runs(hashes[a:b] + np.uint64(b - a), b - a) if b > a else np.zeros(0, np.uint64)
