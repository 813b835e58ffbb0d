"""Token counts without tokens: Viterbi over a unigram vocabulary that carries only score and count.

A text is normalised as the vocabulary's tokenizer does (a dummy space in front, spaces as U+2581) and cut
before each run of U+2581: no piece of the vocabulary has that sign after another character, so the best path
of a text is the best paths of its units joined, and units repeat. Within a unit an Aho-Corasick automaton
lists, for each end, the pieces that end there, and the recursion keeps for each end the best score and its
number of pieces. Tie rules are the tokenizer's: among equal scores the earliest start (the longest last piece)
stays; a character without a piece of its own costs the lowest score less ``unknown_penalty`` and replaces
a path only if better; with byte fallback it counts one token for each of its UTF-8 bytes.

Defined cases: null or empty text has no tokens and score 0; equal texts have equal counts; repeated rows and
null ids are kept as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.llm.columns import map_batches, need

COUNTS = "doc_id long, n_chars long, n_units long, n_tokens long, n_unknown long, score double"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHE_UNITS = 400_000


class UnigramCounter:
    """Counts and scores of units over (piece, score) pairs; remembers a bounded number of short units."""

    def __init__(self, pieces: list[tuple[str, float]], *, byte_fallback: bool = True, unknown_penalty: float = 10.0) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - unknown_penalty
        self.longest = max(len(piece) for piece, _ in pieces)
        self.byte_fallback = byte_fallback
        self.whole = any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces)
        self.known: dict[str, tuple[float, int, int]] = {}

    def unit(self, text: str) -> tuple[float, int, int]:
        """Best score, its pieces, and how many of its characters have no piece; holds as many ends as a piece is long."""
        size = self.longest + 1
        score, count, odd, was_odd = [0.0] * size, [0] * size, [0] * size, [False] * size
        matches = self.automaton.iter(text)
        last, found = next(matches, (-1, None))
        for at, character in enumerate(text):
            here, before = (at + 1) % size, at % size
            best, single = None, False
            while found is not None and last == at:
                length, own = found
                single |= length == 1
                start = (at + 1 - length) % size
                if best is None or score[start] + own > best:
                    best, state = score[start] + own, (count[start] + 1, odd[start], False)
                last, found = next(matches, (-1, None))
            if not single and (best is None or score[before] + self.unknown > best):
                more = len(character.encode("utf-8", "replace")) if self.byte_fallback else int(not was_odd[before])
                best, state = score[before] + self.unknown, (count[before] + more, odd[before] + 1, True)
            score[here], (count[here], odd[here], was_odd[here]) = best, state
        end = len(text) % size
        return score[end], count[end], odd[end]

    def lookup(self, text: str) -> tuple[float, int, int]:
        found = self.known.get(text)
        if found is None:
            found = self.unit(text)
            if len(text) <= 64:
                if len(self.known) >= CACHE_UNITS:
                    self.known.clear()
                self.known[text] = found
        return found

    def text(self, text: str) -> tuple[int, int, int, float]:
        """Units, tokens, characters without a piece, and score of a whole text."""
        if not text:
            return 0, 0, 0, 0.0
        normal = SPACE + text.replace(" ", SPACE)
        units = [normal] if self.whole else UNIT.findall(normal)
        found = list(map(self.lookup, units))
        return len(units), sum(f[1] for f in found), sum(f[2] for f in found), sum(f[0] for f in found)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a sentencepiece model file with their scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    ordinary = (model.SentencePiece.NORMAL, model.SentencePiece.USER_DEFINED)
    return [(p.piece, p.score) for p in model.pieces if p.type in ordinary]


_loaded: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """One counter for each Python worker and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = UnigramCounter(vocabulary(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_chars, n_units, n_tokens, n_unknown and score of each whole text; a map without any shuffle."""

    def work(batch: pa.RecordBatch):
        count = counter(vocabulary_path).text
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = list(zip(*map(count, texts), strict=True))
        yield {"doc_id": batch.column(0), "n_chars": list(map(len, texts)), "n_units": rows[0], "n_tokens": rows[1], "n_unknown": rows[2], "score": rows[3]}

    return map_batches(need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), work, COUNTS)
