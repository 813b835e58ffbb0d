"""Token files, the prefix trie and hard negatives against brute force, on given and odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from oracle import SMALL, compare
from pyspark.sql import functions as F

import corpus_pipeline
from cartlake.functions.ordered import along, placed
from cartlake.llm import gif, hard_negatives, media_columns, near_dedup, packing, prefix_trie, token_files
from cartlake.llm.queries import ORACLES, QUERIES, vocabulary_path

WORDS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(WORDS))


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_hyperplane_tree_negatives"])
def test_query(spark, name):
    assert compare(spark, SMALL, QUERIES[name], ORACLES[name]) == ""


def laid_out(tokenizer, rows):
    """(doc_id, start, n_tokens, crc) of rows in order, and all ids."""
    out, ids = [], []
    for doc, text in rows:
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, len(ids), len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
        ids += own
    return out, ids


def test_token_files_hold_the_library_ids(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wanted, _ = laid_out(tokenizer, [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, SMALL).collect())) == wanted


def test_token_files_of_odd_rows(spark, odd, none, tokenizer):
    path = vocabulary_path(WORDS)
    more = odd.withColumns({"start": F.lit("x"), "row": F.lit(1), "hash": F.lit(0), "utf8": F.lit(None).cast("string")})
    files = token_files.write_tokens(more, path)
    found = token_files.read_tokens(files).collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    wanted, ids = laid_out(tokenizer, rows)
    assert collections.Counter(map(tuple, found)) == collections.Counter(wanted)
    windows = [(1, 0, 10), (2, 5, 0), (3, len(ids) - 3, 50), (4, -4, 6), (5, 0, len(ids) + 9), (6, len(ids), 5), (7, None, 3)]
    read = {r.window_id: list(r.ids) for r in token_files.token_windows(files, spark.createDataFrame(windows, "window_id long, start long, length long")).collect()}
    assert read == {w: part for w, s, n in windows[:6] if (part := ids[max(0, s) : max(0, s + n)])}
    empty = token_files.write_tokens(none, path)
    assert token_files.read_tokens(empty).count() == 0
    assert token_files.token_windows(empty, spark.createDataFrame(windows, "window_id long, start long, length long")).count() == 0


def test_ids_of_wide_vocabularies_take_four_bytes(spark, tokenizer):
    path = vocabulary_path(WORDS)
    docs = spark.createDataFrame([(2, "one two"), (1, "three")], "doc_id long, text string")
    files = token_files.write_tokens(docs, path, end_id=70_000)
    ids = [*tokenizer.encode("three", add_special_tokens=False).ids, 70_000, *tokenizer.encode("one two", add_special_tokens=False).ids, 70_000]
    window = token_files.token_windows(files, spark.createDataFrame([(1, 0, 100)], "window_id long, start long, length long")).first()
    assert files.width == 4 and window.ids == ids and token_files.id_width(path) == 2


def test_words_whose_lower_case_has_several_characters(tokenizer):
    coder = packing.WordIds(vocabulary_path(WORDS))
    several = [c for c in map(chr, range(0x110000)) if len(c.lower()) > 1]
    texts = ["İ.", "İ. x", "İ, İ! İ?", "aİ; b", *(f"{c}{end} x{c}{end}" for c in several for end in ".,;:!?")]
    for text, coded in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, lengths = collections.defaultdict(list), {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        made = [*own.get(base, [])[:h], *turns[h:]]
        lengths[c] = len(made)
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, convs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(convs) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if lengths[c] == len(n))
        out.append((min(convs), len(n), min(members[n[:-1]]) if n else None, len(convs), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, hi string, place long"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATIONS).repartition(3)


def trie_of(spark, rows, **options):
    turns, convs = prefix_trie.grafted(prefix_trie.ordered_turns(turns_of(spark, rows)))
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, convs, **options).collect()))


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost")]
    for conv in [*range(-7, 60), 1003, 1004]:
        if conv % 11 == 3:
            continue
        rows += [(conv, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["user", None, "bot"]), rng.choice([None, "", "hi", "été", "x" * 40 + rng.choice("ab")])) for _ in range(rng.choice([1, 1, 2, 3, 5, 12]))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)] + rows[5:9]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert prefix_trie.rebuilt_trie(turns_of(spark, [(None, 1, "a", "b")])).count() == 0


def test_trie_of_long_conversations_and_a_full_screen(spark, monkeypatch):
    """Several blocks of positions in a conversation, many blocks of ends in a node, and a screen that tells nothing apart."""
    rows = [(c, t, "user", f"t{t}" if t < 50 or c == 0 else f"{c}-{t}") for c in (0, 5) for t in range(70)] + [(c, 0, "user", "hello") for c in range(1000, 1400)]
    wanted = brute_trie(rows)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    monkeypatch.setattr(prefix_trie, "MOST_BLOCKS", 3)
    monkeypatch.setattr(prefix_trie, "SLICE", 64)
    assert trie_of(spark, rows, block=16) == wanted
    assert trie_of(spark, rows, most_cells=64) == wanted


def test_screen_proves_singletons_only(spark):
    rows = spark.range(20_000).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("depth"), F.xxhash64(F.col("id") % 15_000).alias("hi"), F.xxhash64(F.col("id") % 15_000, F.lit(1)).alias("lo"))
    marked = prefix_trie.screened(rows)
    assert marked.where("single and (conv_id < 5000 or conv_id >= 15000)").count() == 0
    assert marked.where("single").count() > 9_000  # of the 10,000 that are


def test_places_and_running_values(spark):
    rows = [(i % 7, i * 37 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(5)
    found = [(r.k, r.v, r.i) for r in placed(df, ["k", "v", "i"]).orderBy("place").collect()]
    assert found == sorted(rows)
    assert [r.place for r in placed(df, ["k", "v", "i"]).orderBy("place").collect()] == list(range(500))
    dense = spark.range(1000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("p"), F.col("id").alias("v"))
    for backwards in (False, True):
        got = along(dense, "k", "p", {"v": (F.sum, lambda a, b: a + b)}, backwards=backwards, block=16).collect()
        for r in got:
            span = range(r.p, (999 - r.k) // 3 + 1) if backwards else range(r.p + 1)
            assert r.v == sum(3 * p + r.k for p in span)


def brute_negatives(rows):
    """Rows (vec_id, label, vector) to the query's rows, by scanning all."""
    kept = []
    for vec, label, x in rows:
        if vec is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for i, (anchor, label, x) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), vec, other == label) for j, (vec, other, y) in enumerate(kept) if j != i)
        for s, positive, _ in [r for r in scored if r[2]][:5]:
            fits = [(vec, -t) for t, vec, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(anchor, positive, n, vec, -s, t) for n, (vec, t) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, leaf string, block int, row_id string"


def test_negatives_equal_brute_force(spark):
    """Clusters, a group of equal vectors, repeated and missing ids, bad and short vectors, on trees of one and two levels."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 4)), [float(v) for v in (centres[i % 6] + rng.normal(size=8) * 0.3).astype(np.float32)]) for i in range(900)]
    rows += [(2000 + i, i % 3, [0.5] * 8) for i in range(300)] + [rows[100], rows[100], rows[7]]
    rows += [(None, 1, [1.0] * 8), (5000, None, [1.0] * 8), (5100, 1, None), (5200, 1, [1.0, None] + [0.0] * 6), (5300, 1, [float("nan")] * 8), (5400, 1, [float("inf")] * 8), (5500, 1, []), (5600, 2, [9.0, -3.0]), (5700, 1, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(4)
    wanted = brute_negatives(rows)
    for leaf_rows, block_rows in ((4096, 4096), (100, 50), (2, 64)):
        found = hard_negatives.hard_negatives(df, leaf_rows=leaf_rows, block_rows=block_rows)
        assert sorted(map(tuple, found.collect())) == wanted
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id = 5700")).count() == 0


def test_tree_drops_leaves_and_loses_none(spark):
    """Leaves out of reach are dropped, and each row within a window lies in a leaf that is kept."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 3)) * 4
    rows = spark.createDataFrame([(i, i % 5, [float(v) for v in centres[i % 12] + rng.normal(size=3) * 0.2]) for i in range(3000)], "vec_id long, label int, embedding array<float>")
    held = hard_negatives.prepared(rows)
    tree = hard_negatives.fit(held, leaf_rows=50)
    all_rows = held.toPandas()
    plain = hard_negatives.stacked(list(all_rows["vec"]), tree.width)
    leaves = tree.leaf_of(tree.lifted(plain, all_rows["norm"].to_numpy()))
    visited = 0
    for i in range(0, 3000, 100):
        own = plain @ plain[i]
        high = np.sort(own)[-50]
        low = np.sort(own)[-150]
        whole = all_rows["norm"][i] + tree.top
        anchor = np.append(plain[i], 0.0)[None]
        kept = tree.reachable(anchor, np.sqrt(np.maximum(0, whole - 2 * np.asarray([high]))), np.sqrt(np.maximum(0, whole - 2 * np.asarray([low]))))
        assert set(leaves[(own >= low) & (own <= high)]) <= set(kept)
        visited += len(kept)
    assert visited < 0.5 * 30 * tree.leaves


def test_scores_beyond_doubles():
    big = np.asarray([[float(1 << 29), 1.0, 3.0]])
    assert hard_negatives.scores(big, big)[0, 0] == (1 << 58) + 10


WORDY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def test_unlike_texts_of_one_id_stay(spark, odd, none):
    """Each text of a repeated id is judged for itself; equal rows and near copies leave one; rows without an id stay."""
    rows = [(3, WORDY, "a", 1), (3, "something else that has nothing in common with the other text of this id", "b", 2), (3, WORDY, "c", 3), (7, WORDY + " more", "d", 4), (9, "alone", "e", 5), (None, WORDY, "f", 6), (4, None, "g", 7), (4, "", "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place int").repartition(3)
    found = sorted(near_dedup.without_duplicates(df, percent=80).collect(), key=lambda r: r.place)
    assert found[0].text == WORDY and found[0].doc_id == 3 and [r.place for r in found if r.place not in (1, 3)] == [2, 5, 6, 7, 8] and len(found) == 6
    assert near_dedup.without_duplicates(odd).columns == odd.columns and near_dedup.without_duplicates(none).count() == 0
    single = spark.createDataFrame([(1, WORDY, 5), (2, WORDY, 6), (None, "x", 7)], "doc_id long, text string, gone_id int")
    assert sorted(r.gone_id for r in near_dedup.without_duplicates(single).collect()) == [5, 7]


def test_cut_and_broken_files_give_one_error_row(spark, none):
    """Wherever a file of two frames is cut, it gives one row that says so, and no frame."""
    whole = gif.encode([bytes(range(192)) * 8, bytes(reversed(range(192))) * 4], 192)
    cut = [whole[:n] for n in (0, 5, 12, 400, 800, len(whole) // 2, len(whole) - 120, len(whole) - 3, len(whole) - 1)]
    broken = [b"no gif", whole[:-1] + b"\x55\x3b", None]
    media = spark.createDataFrame([(i, f) for i, f in enumerate([*cut, *broken, whole])], "media_id int, media binary")
    found = {}
    for r in media_columns.gif_frames(media).collect():
        found.setdefault(r.media_id, []).append(r)
    last = len(cut) + len(broken)
    assert all(len(found[i]) == 1 and found[i][0].error and found[i][0].frame is None for i in range(last))
    assert len(found[last]) == 2 and not any(r.error for r in found[last])
    assert media_columns.gif_frames(media.limit(0)).count() == 0


def test_fixed_bytes_of_the_format():
    """The code stream of a picture of ten by ten pixels in four colours, as descriptions of the format give it."""
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    assert gif.lzw_decode(stream, 2, 100) == bytes(int(c) for row in rows for c in row)


def test_pipeline_of_odd_empty_and_given_tables(spark, odd, none, tmp_path):
    """``run`` on nulls, repeats, clashing names and nothing; on the given table its pieces are whole and gapless."""
    odd.withColumnsRenamed({"block": "component"}).write.parquet(f"{tmp_path}/odd/documents.parquet")
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in rows} <= {1, 2, 5, 6, 7, 8, 9, None} and not {3, 4, 10} & {r.doc_id for r in rows}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    packed = collections.defaultdict(list)
    for r in pieces:
        packed[r.sequence_id].append((r.offset, r.length))
    assert len({r.doc_id for r in pieces}) > 100
    for held in packed.values():
        ends = [0, *(o + n for o, n in sorted(held))]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 4096
