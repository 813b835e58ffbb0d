"""Language identification by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's features are its byte n-grams of one to four bytes (ASCII letters in lower case, white space as one
kind), hashed into ``BUCKETS``. A text's vector is the average of its n-grams' embeddings; a linear softmax
gives probabilities of the languages and of a background class, which is learned from made texts: sampled texts whose
letters are shuffled, drawn anew or moved to another script. Both layers are trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents (``per_language`` of each language in expectation, chosen by a hash of
the id, each whole and as an excerpt of a few words, and as many made texts as of one language). A fifth of the sample calibrates: the temperature, by the loss against
smoothed targets (which has its least value at a finite temperature, also where classes part cleanly), and the rejection
threshold on the background's log odds. A text is rejected if these exceed the threshold; a text in several known
languages has a low score but is no background, and stays. Prediction reads whole texts.

Defined cases: null text, and text without a letter, is ``und`` with score 0 and rejected; rows whose language is
null teach nothing; with no labelled row at all every text is ``und``; equal texts get equal predictions; rows
repeat as given; empty tables give empty results; a very long text is read in chunks; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.llm.columns import map_batches, need

BITS = 14
BUCKETS = 1 << BITS
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 20
#: First letter and number of letters of scripts that made texts are moved to.
SCRIPTS = ((0x430, 32), (0x3B1, 25), (0x561, 38), (0x5D0, 27), (0x627, 36), (0x905, 53), (0xE01, 46), (0x10D0, 33), (0x3041, 86), (0x30A1, 90), (0x4E00, 20_000), (0xAC00, 11_000))
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


class Model(NamedTuple):
    """The collapsed model: each bucket's logits and the intercepts (the background's last), and the calibration."""

    languages: list[str]
    logits: np.ndarray
    intercepts: np.ndarray
    temperature: float
    threshold: float

    def scores(self, bucket: np.ndarray, share: np.ndarray) -> np.ndarray:
        return share @ self.logits[bucket] + self.intercepts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def background_odds(z: np.ndarray) -> np.ndarray:
    """Log odds of the last class against all others."""
    top = z[..., :-1].max(axis=-1, keepdims=True)
    return z[..., -1] - top[..., 0] - np.log(np.exp(z[..., :-1] - top).sum(axis=-1))


def made_text(text: str, seed: int) -> str:
    """A text of no language: the letters shuffled, drawn anew, or moved to another script."""
    rng = np.random.default_rng(seed)
    kind = int(rng.integers(4))
    letters = [i for i, c in enumerate(text) if c.isalpha()]
    if kind == 0:
        new = [text[letters[j]] for j in rng.permutation(len(letters))]
    else:
        start, size = (0x61, 26) if kind == 1 else SCRIPTS[int(rng.integers(len(SCRIPTS)))]
        new = [chr(start + int(j)) for j in rng.integers(size, size=len(letters))]
    out = list(text)
    for i, c in zip(letters, new, strict=True):
        out[i] = c
    return "".join(out)


def has_letter(text: str) -> bool:
    found = LETTER.search(text)
    return found is not None and (found.group().isalpha() or any(map(str.isalpha, text)))


def gram_counts(data: bytes) -> np.ndarray:
    """How many of the text's n-grams fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), CHUNK):
        part = _FOLD[np.frombuffer(data[max(0, at - 3) : at + CHUNK], np.uint8)]
        fresh = at - max(0, at - 3)  # n-grams that end before this place were counted with the chunk before
        hashes = np.full(len(part), 0x811C9DC5, np.uint32)
        for n in range(4):
            if len(part) <= n:
                break
            hashes = (hashes[: len(part) - n] ^ part[n:]) * np.uint32(0x9E3779B1)
            hashes ^= hashes >> np.uint32(15)
            counts += np.bincount(hashes[max(0, fresh - n) :] * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS), minlength=BUCKETS)
            # the next order starts one place earlier in the text: its hash extends this one
    return counts


def held_out(remainder: int = 2, parts: int = 4) -> Column:
    """Whether a document is kept out of all learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def excerpt(text: str, seed: int) -> str:
    """Three to twelve words from anywhere in the text, so that short texts are learned beside whole ones."""
    words, rng = text.split(" "), np.random.default_rng(seed)
    n = int(rng.integers(3, 13))
    at = int(rng.integers(max(1, len(words) - n + 1)))
    found = " ".join(words[at : at + n])
    return found if has_letter(found) else text


def _training_rows(docs: DataFrame, per_language: int) -> tuple[DataFrame, int]:
    """The sampled rows and the number of languages."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row a language; their shares are part of the filter, so that no text is shuffled.
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return labelled.select("doc_id", "text", "lang").limit(0), 0
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, per_language / n)))[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.where(draw < share).select("doc_id", "text", "lang"), len(counts)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Used buckets and their shares of the text's n-grams."""
    counts = gram_counts(text.encode("utf-8", "replace"))
    used = np.flatnonzero(counts)
    return used, counts[used] / counts.sum()


def gradient_step(embeddings: np.ndarray, weights: np.ndarray, intercepts: np.ndarray, bucket: np.ndarray, share: np.ndarray, target: int, step: float) -> None:
    """One step down the loss -log p(target), in place; embeddings, of which many share a text, take longer ones, intercepts shorter."""
    vector = share @ embeddings[bucket]
    error = softmax(vector @ weights + intercepts)
    error[target] -= 1
    pull = weights @ error
    weights -= step * np.outer(vector, error)
    intercepts -= 0.1 * step * error
    embeddings[bucket] -= step * len(bucket) ** 0.5 * np.outer(share, pull)


def fit(docs: DataFrame, *, per_language: int = 600, dimension: int = 16, epochs: int = 8, rate: float = 0.5, keep_weight: float = 100.0, seed: int = 7) -> Model | None:
    """A model from about ``per_language`` whole documents of each language: their features, not their texts, come to the driver."""
    rows, n_languages = _training_rows(need(docs, "doc_id", "text", "lang"), per_language)

    def work(batch: pa.RecordBatch):
        out: dict[str, list] = {"doc_id": [], "lang": [], "bucket": [], "share": []}
        for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not text or not has_letter(text):
                continue
            mark = zlib.crc32(text.encode("utf-8", "replace"))
            own = [text, excerpt(text, mark)]
            made = [(None, made_text(t, mark)) for t in own] if mark % n_languages == 0 else []
            for name, content in [*((lang, t) for t in own), *made]:
                bucket, share = features(content)
                for column, value in zip(out, (doc, name, bucket.astype("<u2").tobytes(), share.astype("<f4").tobytes()), strict=True):
                    out[column].append(value)
        yield out

    sampled = map_batches(rows, work, "doc_id long, lang string, bucket binary, share binary")
    found = _gathered(sampled)
    languages = sorted({r[1] for r in found if r[1] is not None})
    if not languages:
        return None
    place = {name: i for i, name in enumerate([*languages, None])}
    examples = [(bucket, share, place[lang]) for _, lang, bucket, share in found]
    train, check = [e for i, e in enumerate(examples) if i % 5], [e for i, e in enumerate(examples) if not i % 5]
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1, 1, (BUCKETS, dimension)) / dimension
    weights, intercepts = np.zeros((dimension, len(place))), np.zeros(len(place))
    steps, total = 0, epochs * max(1, len(train))
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            gradient_step(embeddings, weights, intercepts, *train[i], rate * (1 - steps / total))
            steps += 1
    model = Model(languages, embeddings @ weights, intercepts, 1.0, 0.0)
    rows_z = np.stack([model.scores(bucket, share) for bucket, share, _ in check or train])
    truth = np.array([t for _, _, t in check or train])
    temperature = fitted_temperature(rows_z, truth)
    odds = background_odds(rows_z / temperature)
    made = truth == len(languages)
    return model._replace(temperature=temperature, threshold=fitted_threshold(odds[~made], odds[made], keep_weight))


def _gathered(sampled: DataFrame) -> list[tuple[int, str | None, np.ndarray, np.ndarray]]:
    """The examples in a fixed order: id, language, buckets, shares. They are slices of two buffers, whose memory goes back as a whole."""
    buckets, shares, rows = bytearray(), bytearray(), []
    for r in sampled.toLocalIterator():
        rows.append((r.doc_id or 0, r.lang, len(buckets) // 2, len(r.bucket) // 2))
        buckets += r.bucket
        shares += r.share
    bucket, share = np.frombuffer(buckets, "<u2"), np.frombuffer(shares, "<f4")

    def order(r: tuple) -> tuple:
        return r[0], r[1] is None, r[1] or "", r[3]

    rows.sort(key=order)
    like = (list(g) for _, g in groupby(rows, order))
    ordered = (r for g in like for r in (sorted(g, key=lambda r: share[r[2] : r[2] + r[3]].tobytes()) if len(g) > 1 else g))
    return [(doc, lang, bucket[at : at + n], share[at : at + n]) for doc, lang, at, n in ordered]


def smoothed_loss(z: np.ndarray, truth: np.ndarray, temperature: float) -> float:
    """Mean loss against targets of (n + 1) / (n + 2) for a class of n rows, the rest spread evenly over the others."""
    n = np.bincount(truth, minlength=z.shape[1])[truth]
    rest = 1 / (n + 2) / max(1, z.shape[1] - 1)
    scaled = (z - z.max(axis=1, keepdims=True)) / temperature
    log_p = scaled - np.log(np.exp(scaled).sum(axis=1, keepdims=True))
    own = log_p[np.arange(len(truth)), truth]
    return float(-(own * (n + 1) / (n + 2) + rest * (log_p.sum(axis=1) - own)).mean())


def fitted_temperature(z: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least smoothed loss, which is convex in its inverse."""
    lo, hi = 1e-6, 1e6
    for _ in range(200):
        a, b = 1 / (1 / hi + (1 / lo - 1 / hi) / 3), 1 / (1 / hi + (1 / lo - 1 / hi) * 2 / 3)
        if smoothed_loss(z, truth, a) < smoothed_loss(z, truth, b):
            lo = b
        else:
            hi = a
    return lo


def fitted_threshold(texts: np.ndarray, made: np.ndarray, keep_weight: float) -> float:
    """The log odds that err least, a rejected text counting ``keep_weight`` times as much as an accepted made one; the middle of a gap."""
    ends = np.unique(np.concatenate([texts, made]))
    if not len(texts) or not len(made):
        return float("inf")
    cuts = np.concatenate([ends[:1] - 1, (ends[1:] + ends[:-1]) / 2, ends[-1:] + 1])
    cost = keep_weight * (texts[:, None] > cuts).mean(axis=0) + (made[:, None] <= cuts).mean(axis=0)
    return float(cuts[np.flatnonzero(cost == cost.min())[-1]])


def identify(text: str | None, model: Model | None) -> tuple[str, float, bool]:
    """Language, calibrated probability, and whether the text is rejected."""
    if model is None or not text or not has_letter(text):
        return "und", 0.0, True
    z = model.scores(*features(text)) / model.temperature
    best = int(z[:-1].argmax())
    return model.languages[best], float(softmax(z)[best]), bool(background_odds(z) > model.threshold)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row; from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        rows = [identify(t, shared.value) for t in batch.column(2).to_pylist()]
        yield {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[2] for r in rows]}

    return map_batches(need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), held_out(), "text"), work, PREDICTED)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose text the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch):
        keep = [not identify(t, shared.value)[2] for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, work, docs.schema)
