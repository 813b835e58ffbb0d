"""Operators that map texts: token counts, media columns, personal data, language ID."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
SMALL = "/root/testdata/sf0.001"

from cartlake.llm import gif, language_id, media_columns, pii, token_counts
from cartlake.llm.queries import QUERIES, vocabulary_path


def brute_unigram(counter, text):
    """Best (score, count) over all segmentations of a short text, by plain recursion."""
    pieces = {p: s for p, (_, s) in ((k, counter.automaton.get(k)) for k in counter.automaton.keys())}
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            s = pieces.get(text[start:end])
            if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                best[end] = (best[start][0] + s, best[start][1] + 1)
        if text[end - 1] not in pieces:
            s, n = best[end - 1]
            if best[end] is None or s + counter.unknown > best[end][0]:
                best[end] = (s + counter.unknown, n + len(text[end - 1].encode()))
    return best[-1]


def test_viterbi_equals_recursion_and_tokenizer():
    from tokenizers import Tokenizer, models

    small = token_counts.UnigramCounter([("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -3.0), ("aba", -5.0)])
    rng = random.Random(1)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert small.unit(text)[:2] == brute_unigram(small, text)
    pieces = token_counts.vocabulary(vocabulary_path("piece_bpe_32k.model"))
    counter = token_counts.UnigramCounter(pieces)
    library = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + pieces, unk_id=0, byte_fallback=True))
    for text in ("Hello  world", "été ▁x\n\n", "日本語 😀", "a" * 40, " "):
        assert counter.text(text)[1] == len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(odd, none):
    rows = token_counts.count_tokens(odd, vocabulary_path("piece_bpe_32k.model")).collect()
    assert len(rows) == 12 and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert token_counts.count_tokens(none, vocabulary_path("piece_bpe_32k.model")).count() == 0


def test_lzw_round_trip():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"a" * 70_000, bytes(rng.integers(0, 256, 50_000, np.uint8)), b"abcabcab" * 9000):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_frames_palettes_transparency_and_disposal():
    def block(data):
        return gif._blocks(gif.lzw_encode(data, 2))

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + bytes([0x91, 0, 0]) + palette

    def image(pixels, *, control=b"", left=0, width=2, height=2, flags=0):
        return control + b"\x2c" + bytes([left, 0, 0, 0, width, 0, height, 0, flags, 2]) + block(bytes(pixels))

    def control(disposal, delay, clear=None):
        return b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0]) + b"\0"

    data = head + image([1, 1, 2, 2], control=control(1, 5)) + image([3, 0], control=control(2, 7, 0), width=1) + image([2], control=control(3, 9), width=1, height=1) + image([0, 1, 2, 3], control=control(0, 1)) + b"\x3b"
    shown = [[tuple(p) for p in f.rgb.reshape(-1, 3)] for f in gif.decode(data)]
    k, r, g, b = (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)
    assert shown == [[r, r, g, g], [b, r, g, g], [g, r, k, g], [k, r, g, b]]
    assert [f.delay_ms for f in gif.decode(data)] == [50, 70, 90, 10]


def test_interlaced_equals_plain():
    pixels = np.arange(9 * 4, dtype=np.uint8).reshape(9, 4)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    body = gif.encode([pixels.tobytes()], 4)
    at = body.index(b"\x2c\0\0\0\0")
    laced = body[: at + 9] + b"\x40\x08" + gif._blocks(gif.lzw_encode(pixels[order].tobytes())) + b"\x3b"
    assert (next(gif.decode(laced)).rgb == next(gif.decode(body)).rgb).all()


def test_stored_payloads(odd, none):
    stored = media_columns.store_payloads(odd)
    rows = media_columns.payload_features(stored).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in rows:
        data = texts[r.doc_id]
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert len(rows) == 12 and media_columns.payload_features(media_columns.store_payloads(none)).count() == 0
    frames = media_columns.gif_frames(stored, "doc_id", "media").where("media_id = 9").collect()
    assert [f.start_ms for f in sorted(frames, key=lambda f: f.frame)] == [100 * i for i in range(len(frames))] and len(frames) > 1
    broken = odd.selectExpr("doc_id as media_id", "cast(text as binary) as media")
    assert all(r.error for r in media_columns.gif_frames(broken).collect())


def plain_base(text):
    """The contract's patterns, tried one after another."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and (sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(spans)


def test_base_spans_equal_patterns(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = random.Random(5)
    texts += ["".join(rng.choice("a@.1+- ()0é") for _ in range(60)) for _ in range(400)] + ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "@@a@b.c"]
    for text in texts:
        assert pii.base_spans(text) == plain_base(text)


@pytest.mark.parametrize(("text", "found"), [
    ("mail jo.doe [at] ex [dot] com now", ["email:jo.doe [at] ex [dot] com"]), ("write jane at mail dot example dot org", ["email:jane at mail dot example dot org"]), ("host 10[.]0[.]0[.]1 up", ["ip:10[.]0[.]0[.]1"]),
    ("ｊｏ＠ｅｘ．ｃｏｍ", ["email:ｊｏ＠ｅｘ．ｃｏｍ"]), ("plus four four two oh seven nine four six oh nine five", ["phone:plus four four two oh seven nine four six oh nine five"]), ("jo\u200b@ex.com", ["email:jo\u200b@ex.com"]),
    ("jοhn@ex.com", ["email:jοhn@ex.com", "email:hn@ex.com"]), ("ja\u200bne@ex.com", ["email:ja\u200bne@ex.com", "email:ne@ex.com"]), ("jane_at_ex_dot_com", ["email:jane_at_ex_dot_com"]),
    ("at 1 9 2 dot 1 6 8 dot 1 dot 1 now", ["ip:1 9 2 dot 1 6 8 dot 1 dot 1"]), ("jo at example punkt com", ["email:jo at example punkt com"]), ("ask jo.doe at example.com", ["email:jo.doe at example.com"]),
    ("jo arroba ejemplo punto es", ["email:jo arroba ejemplo punto es"]), ("mail jo at example.org", ["email:jo at example.org"]), ("plus four four double two oh seven nine four six oh nine", ["phone:plus four four double two oh seven nine four six oh nine"]),
    ("jo@ex.com\u2013see", ["email:jo@ex.com"]), ("write jo @ ex.com", ["email:jo @ ex.com"]), ("jο at exаmple dot cοm", ["email:jο at exаmple dot cοm"]),
    ("look at example.com or one two three dots", []), ("meet at dot", []), ("look at the point where", []), ("at home.Then 5 at best.Or one point two", []), ("we met at 10 point five", []),
])
def test_disguises_map_back(text, found):
    base, spans = pii.all_spans(text)
    assert set(base) <= set(spans)
    assert [f"{pii.KINDS[k]}:{text[s:e]}" for s, k, e in spans] == found


def planted_disguises(rng):
    """For each kind of disguise a function from a plain identifier to its disguised form."""
    names = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    spell = lambda t: " ".join(names[int(c)] if c.isdigit() else {"+": "plus", ".": "dot"}[c] for c in t)
    greek = str.maketrans("aeopx", "аеорх")
    email = lambda: f"{''.join(rng.choices('abcdeopx', k=6))}{rng.randint(1, 99)}@{''.join(rng.choices('aeopst', k=5))}.{rng.choice(['com', 'org', 'de', 'example'])}"
    return {
        "look-alikes": (email, lambda t: t.translate(greek)), "wide": (email, lambda t: "".join(chr(ord(c) + 0xFEE0) for c in t)), "invisible": (email, lambda t: t[:2] + "\u200b" + t[2:]),
        "brackets": (email, lambda t: t.replace("@", " [at] ").replace(".", " (dot) ")), "bare": (email, lambda t: t.replace("@", " at ").replace(".", " dot ")), "underscores": (email, lambda t: t.replace("@", "_at_").replace(".", "_dot_")), "at only": (email, lambda t: t.replace("@", " at ")),
        "german": (email, lambda t: t.replace("@", " at ").replace(".", " punkt ")), "spanish": (email, lambda t: t.replace("@", " arroba ").replace(".", " punto ")), "spaced": (email, lambda t: t.replace("@", " @ ")),
        "spelled phone": (lambda: "+" + "".join(rng.choices("0123456789", k=12)), spell), "spelled address": (lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), spell), "dotted address": (lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda t: t.replace(".", " dot ")),
    }


def test_planted_disguises_are_found_and_masked():
    rng = random.Random(7)
    words = "the la der on un said über from été plain word and".split()
    for name, (plain, disguise) in planted_disguises(rng).items():
        hits = 0
        for _ in range(100):
            hidden = disguise(plain())
            before = " ".join(rng.choices(words, k=rng.randint(0, 9)) + ["xyz "])
            text = before + hidden + " " + " ".join(["xyz"] + rng.choices(words, k=rng.randint(0, 9)))
            hits += any((s, e) == (len(before), len(before) + len(hidden)) for s, _, e in pii.all_spans(text)[1]) and hidden not in pii.mask(text)
        assert hits >= 90, (name, hits)


def test_tapes_compose():
    tape = pii.Tape.of("aο[at]b").mapped(pii.HOMOGLYPHS).edited([(2, 6, "@")]).edited([(0, 1, ""), (2, 3, "xy")])
    assert tape.text == "oxyb" and tape.source(0, 1) == (1, 2, True) and tape.source(1, 2) == (2, 6, True) and tape.source(3, 4) == (6, 7, False)


def test_long_runs_take_linear_time():
    for text in ("1" * 1_000_000, "1." * 500_000, "a" * 1_000_000, "+1((" * 250_000, "a@b" * 300_000, "one " * 200_000, "x at y.z" * 100_000, "a_at_b" * 100_000):
        began = time.process_time()
        pii.all_spans(text)
        assert time.process_time() - began < 4


def test_masking_keeps_rows_and_columns(odd, none):
    made = pii.masked(odd)
    assert made.columns == odd.columns and made.count() == 12 and pii.masked(none).count() == 0
    seven = made.where("doc_id = 7").first().text
    assert "jo@ex.org" not in seven and "4111" not in seven and "<PHONE>" in seven and "<IP>" in seven


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.predict(odd, model).where("doc_id in (3, 4, 10)").collect()} == {"und"}
    assert language_id.fit(none) is None and {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert 1e-5 < model.temperature < 1e5 and np.isfinite(model.threshold) and not any(r.score == 1 for r in held)
    assert sum(r.rejected for r in rows) <= 2
    rng = random.Random(3)
    salad = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(40))
    for text in ("Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", salad):
        assert language_id.identify(text, model)[2]
    texts = {lang: next(r.text for r in docs.collect() if r.lang == lang and 200 < len(r.text) < 2000) for lang in model.languages}
    assert not language_id.identify(" ".join(texts.values()), model)[2]
    kept = language_id.accepted(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4, 10)").count() == 0


def test_gradient_temperature_and_threshold_equal_brute_force():
    rng = np.random.default_rng(1)
    shapes = ((30, 4), (4, 3), (3,))
    parts = [rng.normal(size=s) for s in shapes]
    bucket, share = np.array([2, 5, 9]), np.array([0.5, 0.3, 0.2])

    def loss(parts):
        return -np.log(language_id.softmax(share @ parts[0][bucket] @ parts[1] + parts[2])[1])

    moved = [p.copy() for p in parts]
    language_id.gradient_step(*moved, bucket, share, 1, 1e-6)
    for k, scale in ((0, 3**0.5), (1, 1), (2, 0.1)):
        for at in np.ndindex(shapes[k]):
            nudged = [p.copy() for p in parts]
            nudged[k][at] += 1e-6
            assert abs((loss(nudged) - loss(parts)) / 1e-6 * scale + (moved[k] - parts[k])[at] / 1e-6) < 1e-4
    z, truth = rng.normal(size=(200, 3)), rng.integers(0, 3, 200)
    z[np.arange(200), truth] += 3
    grid = np.geomspace(0.01, 100, 4001)
    best = grid[np.argmin([language_id.smoothed_loss(z, truth, t) for t in grid])]
    assert abs(language_id.fitted_temperature(z, truth) / best - 1) < 0.01
    apart = np.eye(3)[truth]
    assert 1e-3 < language_id.fitted_temperature(apart, truth) < 1
    assert language_id.fitted_threshold(np.array([-5.0, -3]), np.array([1.0, 2]), 100) == -1
    assert language_id.fitted_threshold(np.array([-5.0, 1.5]), np.array([1.0, 2]), 100) == 1.75


def test_chunked_grams_equal_whole(monkeypatch):
    data = b"The cat sat on the mat. " * 9
    whole = language_id.gram_counts(data)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert (language_id.gram_counts(data) == whole).all()


def test_all_ten_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
