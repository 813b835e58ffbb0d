"""Sum-of-squares packing of tokenised documents into fixed-size sequences.

``token_pieces`` tokenises whole texts and cuts only what is longer than a sequence.
``pack_pieces`` places the pieces: a full piece is a sequence of its own; every other piece goes, within
one of many hash groups, where the sum over residual gaps of the squared number of open bins becomes
smallest. Groups hold a bounded number of pieces whatever the input's size, so no task grows with it.

Defined cases: null text is empty and yields the end token alone; empty tables give empty results; each
input row is a document of its own, also when rows or ids repeat or the id is null; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.llm.columns import map_batches, need, utf8
from cartlake.llm.staging import staged

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
CACHE_BYTES = 48 << 20  # of a generation of remembered words; two are held
ENTRY_BYTES = 160  # of a remembered word, beside its characters and ids
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _letters(word: bytes) -> int:
    """2 for a word of letters, in lower case too; 1 for one whose last character is a letter, in lower case too; else 0."""
    if word.isalpha():
        return 2
    if word.isascii():
        return int(word[-1:].isalpha())
    text = word.decode("utf-8", "replace")
    lower = text.lower()
    return 2 if text.isalpha() and lower.isalpha() else int(text[-1:].isalpha() and lower[-1:].isalpha())


class WordIds:
    """Token ids of whitespace-free words as little-endian bytes, remembered up to a fixed number of bytes:
    when the younger generation of words is full it becomes the older one, and words met again move to the new one.

    The tokenizer lower-cases, drops white space, and joins neither characters across it nor letters with
    punctuation, so a text's ids are its words' ids, and "word..." has those of "word" and of "..." where the word's lower
    case ends in a letter (that of U+0130 ends in a mark, which joins the punctuation). A text that names one of
    the vocabulary's own added tokens is given to the tokenizer as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = re.compile(b"|".join(re.escape(t.content.lower().encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(tokens.values(), default=0) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + ENTRY_BYTES

    def _encode_letters(self, words: list[bytes]) -> None:
        """Words of letters, many in one call: each is one run of letters, so its ids end where an id ends a word."""
        for at in range(0, len(words), 1 << 14):
            part = words[at : at + (1 << 14)]
            texts = [b" ".join(part[k : k + 512]).decode() for k in range(0, len(part), 512)]
            if not all(unicodedata.is_normalized("NFC", t) for t in texts):
                self._encode_alone(part)
                continue
            ids = np.asarray([i for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in coded.ids], "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(part):
                self._encode_alone(part)
                continue
            plain = ids.tobytes()
            self.known.update(zip(part, map(plain.__getitem__, map(slice, [0, *ends], ends)), strict=True))
            self.held += len(plain) + sum(map(len, part)) + ENTRY_BYTES * len(part)

    def _encode_alone(self, words: list[bytes]) -> None:
        """Many words in one call: a token's place in the joined text tells its word."""
        joined, plain = [], []
        for word in words:
            text = word.decode("utf-8", "replace")
            if text.isascii() or unicodedata.is_normalized("NFC", text) and not re.search(r"\s", text):
                joined.append(text), plain.append(word)
            else:
                self._keep(word, self._whole(text))
        for at in range(0, len(plain), 512):
            part = joined[at : at + 512]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in part)])
            ids = np.asarray(coded.ids, "<u4")
            cuts = np.searchsorted(np.fromiter((o[0] for o in coded.offsets), np.int64, len(ids)), starts)
            for k, word in enumerate(plain[at : at + 512]):
                self._keep(word, ids[cuts[k] : cuts[k + 1]].tobytes())

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        if self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        new = words.difference(self.known)
        for word in new.intersection(self.older):
            self._keep(word, self.older.pop(word))
        letters, alone, tailed = set(), set(), []
        for word in new.difference(self.known):
            core = word.rstrip(MARKS)
            if (kind := _letters(core)) and len(core) < len(word):
                tailed.append((word, core, word[len(core) :]))
                alone.add(tailed[-1][2])
            else:
                core, kind = word, kind if core == word else 0
            (letters if kind == 2 else alone).add(core)
        self._encode_letters([w for w in letters if w not in self.known])
        self._encode_alone([w for w in alone if w not in self.known])
        for word, core, tail in tailed:
            self._keep(word, self.known[core] + self.known[tail])

    def encode(self, texts: list[bytes]) -> Iterable[bytes]:
        for at in range(0, len(texts), 500):
            lower = [t.lower() for t in texts[at : at + 500]]
            special = [self.added.search(t) is not None for t in lower]
            split = [[] if s else t.split() for t, s in zip(lower, special, strict=True)]
            self.learn(set().union(*split))
            for text, s, words in zip(texts[at : at + 500], special, split, strict=True):
                yield self._whole(text.decode("utf-8", "replace")) if s else b"".join(map(self.known.__getitem__, words))


_loaded: dict[str, WordIds] = {}


def _forget() -> None:
    """Between tasks a worker keeps one generation of words only."""
    for encoder in _loaded.values():
        encoder.older = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each Python worker and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, vocabulary: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: place, length and checksum of its token ids."""
    end, width = np.asarray([end_id], "<u4").tobytes(), capacity * 4

    def work(batch: pa.RecordBatch):
        out: dict[str, list] = {n: [] for n in ("row_id", "doc_id", "piece", "start", "length", "ids_crc32")}
        rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, doc, coded in zip(rows, ids, word_ids(vocabulary).encode(batch.column(2).to_pylist()), strict=True):
            coded += end
            for k, at in enumerate(range(0, len(coded), width)):
                part = coded[at : at + width]
                for name, value in zip(out, (row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(value)
        yield out

    rows = need(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), utf8().alias("utf8"))
    return map_batches(rows, work, PIECES, done=_forget)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each item, in the order given; ties go to the smallest remaining gap.

    ``open_bins[g]`` counts open bins with gap g. Moving one of them to gap g-s changes the sum of squares by
    2(open_bins[g-s] - open_bins[g] + 1), where closed bins (gap 0) and unopened ones (gap capacity) count nothing.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.int64(1 << 60)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        here, left = open_bins[s:], open_bins[: capacity - s + 1]
        change = np.where(here > 0, 2 * (left - here + 1), never)
        change[0] = 1 - 2 * here[0] if here[0] else never  # the bin closes
        change[-1] = 2 * left[-1] + 1 if s < capacity else -1  # a new bin opens
        gap = s + int(change.argmin())
        if gap == capacity:
            bin_, opened = opened, opened + 1
        else:
            bin_ = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = bin_, capacity - gap
        if gap > s:
            stacks[gap - s].append(bin_)
            open_bins[gap - s] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, *, capacity: int = 4096, group_pieces: int = 20_000) -> DataFrame:
    """Sequence and offset for each piece. ``pieces`` must be a stored table: it is read more than once."""
    n_groups = max(1, round(pieces.where(F.col("length") < capacity).count() / group_pieces))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"] = group["grp"].to_numpy() * (1 << 32) + bins
        group["offset"] = offsets
        return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    full = pieces.where(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).withColumn("grp", F.pmod(F.xxhash64("row_id", "piece"), F.lit(n_groups)))
    return full.unionByName(rest.groupBy("grp").applyInPandas(place, PACKED))


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 4096, end_id: int = 1, group_pieces: int = 20_000) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(staged(token_pieces(docs, vocabulary, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity, group_pieces=group_pieces)
