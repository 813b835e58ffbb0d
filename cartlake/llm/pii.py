"""Personal data behind disguises: transducers that rewrite a text and remember where each character came from.

Plain identifiers (emails, IP addresses, card and phone numbers) are found in the text as it stands. Texts that show
signs of a disguise are put on a ``Tape``, a sequence of characters each with the source characters that it stands for,
and pass through transducers, tape to tape: look-alike characters become ASCII and invisible ones go; digits spelled in
four languages ("double five" too) become digits; "at" and "dot", in brackets or spelled between the parts of an address,
become signs. What the same detectors find on the last tape, over something rewritten, is mapped back to the source's
characters. Plain spans always stay; a disguised span that reaches beyond a plain one of its kind is added beside it.

A bare "at" before a plain domain counts only after a local part with a digit, dot or sign in it, or after a word such as
"mail" or "contact"; "arroba" and "arobase" always do. Not covered: numbers spelled as tens, other languages' words.

Defined cases: null text is empty and holds nothing; equal texts have equal spans; rows repeat as given; null ids stay
null; empty tables give empty results; texts of any length are read whole, in time that grows with their
length; other columns are ignored by ``find_spans`` and kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.llm.columns import map_batches, need

KINDS = ("email", "ip", "card", "phone")
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long, n_disguised long"

# Characters that look like ASCII ones, beyond those that Unicode itself maps to them.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L", "։": ".", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
# Digits as words, for 0 to 9, in English, German, French and Spanish.
DIGIT_WORDS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "zwo", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)
DIGIT_OF = {word: str(n) for n, words in enumerate(DIGIT_WORDS) for word in words}


def _lookalikes() -> dict[int, str]:
    table = {ord(a): b for a, b in LOOKALIKES.items()}
    for code in (*range(0xFF01, 0xFF5F), 0xFE6B, 0xFE52, *range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if not plain.isascii() and (digit := unicodedata.decimal(chr(code), None)) is not None:
            plain = str(digit)
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    return table


HOMOGLYPHS = _lookalikes()
# Words for the two signs, words that announce an address, and last parts of domains that no sentence ends with.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "punto", "point")
CUES = ("mail", "email", "e-mail", "mailto", "contact", "contacto", "kontakt", "write", "reach", "correo", "courriel", "adresse", "address", "schreib", "schreiben", "escribe", "contactez")
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz name io dev app ai co de fr uk eu ch ca au nl be se no dk pl ru cn jp kr br mx ar cl pt gr cz hu ro ie nz za tv cc example test invalid".split())

_WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
_AT, _DOT = "(?:" + "|".join(AT_WORDS) + ")", "(?:" + "|".join(DOT_WORDS) + ")"
_STEP = r"[\s,-]{1,3}"
_UNIT = rf"(?:(?:double|triple){_STEP})?(?:{_WORD}|[0-9]{{1,4}})(?!\w)"
_SPELLED = re.compile(rf"(?<!\w)(?:plus{_STEP}|\+)?{_UNIT}(?:{_STEP}(?:{_UNIT}|{_DOT}(?!\w))){{3,}}", re.IGNORECASE)
_SPELLED_SIGN = re.compile(rf"(?<!\w)(?:(?:{_WORD}|double|triple){_STEP}(?:{_WORD}|[0-9]|{_DOT}(?!\w))|[0-9]{{1,4}}{_STEP}(?:{_DOT}{_STEP}(?:[0-9]|{_WORD})|{_WORD}(?!\w)))", re.IGNORECASE)
_SPELLED_PART = re.compile(r"[^\W\d_]+|[0-9]+|\+|[\s,-]+", re.IGNORECASE)
_BRACKETED = re.compile(rf"[\[({{<]\s?({_AT}|{_DOT}|[.@])\s?[\])}}>]", re.IGNORECASE)
_INVISIBLE = re.compile("[­​-‍⁠﻿]+")
_SPELLED_DOT = rf"(?:\s{{1,3}}{_DOT}\s{{1,3}}|_{_DOT}_)"
_SEPARATOR = re.compile(_SPELLED_DOT, re.IGNORECASE)
_BARE_AT = re.compile(rf"\s{{1,3}}{_AT}\s{{1,3}}|_{_AT}_|\s{{0,3}}@\s{{0,3}}", re.IGNORECASE)
_AFTER_AT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_SPELLED_DOT})[A-Za-z0-9-]{{1,63}}){{1,8}}", re.IGNORECASE)
_BEFORE_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9%+-]{{1,64}}(?:(?:[._]|{_SPELLED_DOT})[A-Za-z0-9%+-]{{1,64}}){{0,8}}$", re.IGNORECASE)
_BARE_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\.|{_SPELLED_DOT})[0-9]{{1,3}}){{3}}(?![\w.])", re.IGNORECASE)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, place of the kind, end


def _emails(text: str) -> list[Span]:
    """From each sign outwards, so that long runs without one cost nothing."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start, after = at, at + 1
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, domain.end()))
            last = after = domain.end()
        at = text.find("@", after)
    return found


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"] if len(text) <= 38 else []
    return 14 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def _is_phone(text: str) -> bool:
    return sum(map(text.count, "0123456789")) in range(10, 16)


def _ips(text: str) -> Iterator[re.Match | tuple[int, int]]:
    """Every four numbers of a run of dotted numbers, from its start on; each character is read a few times at most."""
    for run in _DOTTED.finditer(text):
        parts = [m.span() for m in _NUMBER.finditer(text, *run.span())]
        for i in range(0, len(parts) - 3, 4):
            yield parts[i][0], parts[i + 3][1]


def base_spans(text: str) -> list[Span]:
    """Identifiers of each kind in the text as it stands, by start and then kind."""
    found = _emails(text) + [(start, 1, end) for start, end in _ips(text) if _is_ip(text[start:end])]
    for kind, pattern, holds in ((2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds(m.group())]
    return sorted(found)


class Tape:
    """Characters, and for each of them the source characters that it stands for and whether it was rewritten."""

    def __init__(self, text: str, begin: np.ndarray, end: np.ndarray, rewritten: np.ndarray) -> None:
        self.text, self.begin, self.end, self.rewritten = text, begin, end, rewritten

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text))
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def mapped(self, table: dict[int, str]) -> Tape:
        """Single characters replaced by others."""
        new = self.text.translate(table)
        changed = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4") != np.frombuffer(new.encode("utf-32-le", "surrogatepass"), "<u4")
        return Tape(new, self.begin, self.end, self.rewritten | changed)

    def edited(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Stretches replaced; each new character stands for all of its stretch. Of overlapping edits the first stays."""
        if not edits:
            return self
        texts, pieces, done = [], [], 0  # pieces: length here, first and last source place, whether kept
        for start, end, new in [*sorted(edits), (len(self.text), len(self.text), "")]:
            if start >= done:
                texts += [self.text[done:start], new]
                pieces += [(start - done, done, 0, True), (len(new), start, end - 1, False)]
                done = end
        lengths, first, last, kept = (np.array(x) for x in zip(*pieces, strict=True))
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        kept, first = np.repeat(kept, lengths), np.repeat(first, lengths)
        lo = first + place * kept
        return Tape("".join(texts), self.begin[lo], self.end[np.where(kept, lo, np.repeat(last, lengths))], self.rewritten[lo] | ~kept)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span here, and whether it holds something rewritten or passes over something left out."""
        lo, hi = int(self.begin[start]), int(self.end[end - 1])
        return lo, hi, bool(self.rewritten[start:end].any()) or hi - lo != end - start


def _has_lookalike(text: str) -> bool:
    """Whether some character stands for an ASCII one; texts in Latin-1 can only hold the no-break space."""
    try:
        return not text.isascii() and b"\xa0" in text.encode("latin-1")
    except UnicodeEncodeError:
        return not HOMOGLYPHS.keys().isdisjoint(map(ord, set(text)))


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn runs of digits as words into digits, without the gaps between them."""
    edits = []
    for m in _SPELLED.finditer(text):
        times = 1
        for p in _SPELLED_PART.finditer(text, *m.span()):
            word = p.group().lower()
            if word in ("double", "triple"):
                times, new = 2 if word == "double" else 3, ""
            elif word in DIGIT_OF:
                times, new = 1, DIGIT_OF[word] * times
            elif word.isdigit():
                times, new = 1, word[0] * (times - 1) + word if times > 1 else word
            else:
                new = "+" if word == "plus" else "." if word in DOT_WORDS else "+" if word == "+" else ""
            edits.append((p.start(), p.end(), new))
    return edits


def bracketed_signs(text: str) -> list[tuple[int, int, str]]:
    """Edits for signs in brackets, with a space on either side."""
    edits = []
    for m in _BRACKETED.finditer(text):
        lo = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
        hi = m.end() + (m.end() < len(text) and text[m.end()].isspace())
        edits.append((lo, hi, "@" if m[1] == "@" or m[1].lower() in AT_WORDS else "."))
    return edits


def _dots(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(d.start(), d.end(), ".") for d in _SEPARATOR.finditer(text, start, end)]


def bare_signs(text: str) -> list[tuple[int, int, str]]:
    """Edits for signs spelled between what can be the parts of an address."""
    edits = []
    for at in _BARE_AT.finditer(text):
        sign = at.group().strip().strip("_").lower()
        domain = _AFTER_AT.match(text, at.end())
        if domain is None:
            continue
        window = text[max(0, at.start() - 100) : at.start()]
        local = _BEFORE_AT.search(window)
        if local is None:
            continue
        dots = _dots(text, domain.start(), domain.end())
        first = at.start() - len(window) + local.start()
        known = re.split(rf"\.|{_SPELLED_DOT}", domain.group(), flags=re.IGNORECASE)[-1].lower() in DOMAIN_ENDS
        if sign == "at":
            clear = any("dot" in text[a:b].lower() or "punkt" in text[a:b].lower() for a, b, _ in dots)
            cued = window[: local.start()].lower().replace(":", " ").split()[-3:]
            likely = re.search(r"[0-9._%+]", local.group()) is not None or any(w in CUES for w in cued)
            taken = clear or known and (bool(dots) or likely)
        else:
            taken = sign != "@" or bool(dots) or known and at.group() != "@"
        if taken:
            edits += [*_dots(text, first, at.start()), (at.start(), at.end(), "@"), *dots]
    for m in _BARE_IP.finditer(text):
        edits += _dots(text, m.start(), m.end())
    return edits


def rewritten(text: str) -> Tape | None:
    """The last tape of a text, or nothing where no transducer changes it."""
    tape, lookalike = None, _has_lookalike(text)
    if lookalike:
        tape = Tape.of(text).mapped(HOMOGLYPHS)
    if not text.isascii() and (gone := [(*m.span(), "") for m in _INVISIBLE.finditer(text)]):
        tape = (tape or Tape.of(text)).edited(gone)
    plain = tape.text if tape else text
    lower = plain.lower()
    dots = any(w in lower for w in DOT_WORDS)
    if (dots or not DIGIT_OF.keys().isdisjoint(lower.replace("-", " ").replace(",", " ").split())) and _SPELLED_SIGN.search(plain) and (edits := spelled_digits(plain)):
        tape = (tape or Tape.of(text)).edited(edits)
        plain = tape.text
    for transducer in (bracketed_signs, bare_signs):
        if edits := transducer(plain):
            tape = (tape or Tape.of(text)).edited(edits)
            plain = tape.text
    return tape


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after rewriting, in source characters; those within a plain span of their kind are not new."""
    tape = rewritten(text)
    if tape is None:
        return []
    found: list[Span] = []
    plain = [[(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))]
    for start, kind, end in base_spans(tape.text):
        lo, hi, changed = tape.source(start, end)
        if changed and not any(s <= lo and hi <= e for s, e in plain[kind]):
            # A typographic dash after a plain address does not lengthen it.
            if not any(s == lo and tape.text[start + e - s : start + e - s + 1] == "-" for s, e in plain[kind] if kind < 2):
                found.append((lo, kind, hi))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans by start and then kind."""
    base = base_spans(text)
    return base, sorted({*base, *disguised_spans(text, base)}) if base else sorted(disguised_spans(text, base))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """Spans of each whole text and their numbers by kind; a map without any shuffle."""

    def work(batch: pa.RecordBatch):
        found = [all_spans(t or "") for t in batch.column(1).to_pylist()]
        counts = {f"n_{kind}": [sum(s[1] == k for s in spans) for _, spans in found] for k, kind in enumerate(KINDS)}
        yield {"doc_id": batch.column(0), **counts, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(s) for _, s in found], "n_base": [len(b) for b, _ in found], "n_disguised": [len(s) - len(b) for b, s in found]}

    return map_batches(need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), work, FOUND)


def mask(text: str) -> str:
    """The text with each identifier replaced by its kind; overlapping ones share one mark."""
    out, done = [], 0
    for start, kind, end in all_spans(text)[1]:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def masked(docs: DataFrame) -> DataFrame:
    """The same rows and columns, the text without its identifiers, and ``n_chars`` as long as the text is then."""
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def work(batch: pa.RecordBatch):
        texts = batch.column(at).to_pylist()
        new = [t if t is None else mask(t) for t in texts]
        if length is not None:  # a stated length follows the text where that changes
            counts = [len(b) if a != b else n for a, b, n in zip(texts, new, batch.column(length).to_pylist(), strict=True)]
            batch = batch.set_column(length, batch.schema.field(length), pa.array(counts, batch.schema.field(length).type))
        yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return map_batches(docs, work, docs.schema)
