"""Operators that relate rows: mixing, near-dedup, WARC, suffix tree, winnowing, packing, and the pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

import corpus_pipeline
from cartlake.llm import columns, mixing, near_dedup, packing, suffix_tree, warc_bundles, winnowing, words
from cartlake.llm.queries import QUERIES, vocabulary_path
from cartlake.llm.staging import small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def water_fill(sizes):
    """Targets by sharing again and again what caps cut off."""
    weight = {s: (i % 3) + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        more = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, m in more.items():
            if target[s] + m > 3 * sizes[s]:
                left += target[s] + m - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
            else:
                target[s] += m
    return target


def check_mix(rows, texts):
    sizes = collections.Counter()
    for r, (source, text) in zip(rows, texts, strict=True):
        assert r.size == len(WORD.findall(text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[source] += r.size
    target, taken = water_fill(sizes), collections.Counter()
    for r, (source, _) in zip(rows, texts, strict=True):
        assert r.source_size == sizes[source] and math.isclose(r.target, target[source], abs_tol=1e-6)
        taken[source] += r.taken
    return sizes, target, taken


def test_mix_meets_targets(spark):
    docs = documents(spark)
    by_id = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    found = QUERIES["op3_splitting_tree_mix"](spark, SMALL).collect()
    sizes, target, taken = check_mix(found, [by_id[r.doc_id] for r in found])
    # Ten documents a source, of very different sizes.
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in sizes)
    larger = [(r.source, r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").orderBy("doc_id").collect()]
    more = sorted(QUERIES["op3_splitting_tree_mix"](spark, LARGER).collect(), key=lambda r: r.doc_id)
    _, goal, given = check_mix(more, larger)
    assert all(abs(given[s] - goal[s]) <= 0.001 * goal[s] for s in goal)
    again = {r.doc_id: (r.taken, r.shards) for r in QUERIES["op3_splitting_tree_mix"](spark, SMALL).collect()}
    assert again == {r.doc_id: (r.taken, r.shards) for r in found}


def test_shards_are_disjoint_draws_of_exact_quotas(spark):
    """Each draw of a block lies in one shard, whole blocks stay together, and shards get the tree's counts of blocks."""
    docs = documents(spark)
    rows = mixing.mix(docs, block_words=400, shard_blocks=8).collect()
    assert all(len({d.epoch for d in r.draws}) == len(r.draws) <= 3 for r in rows)
    shards = {d.shard for r in rows for d in r.draws}
    assert len(shards) > 8
    made = mixing.mixed_rows(docs, block_words=400, shard_blocks=8)
    assert made.count() == sum(len(r.draws) for r in rows)
    sized = docs.select("source", mixing.word_count("text").alias("size"), F.xxhash64(F.lit(11), "doc_id", "text").alias("row_key")).cache()
    sources, plan = mixing.mix_plan(sized, block_words=400, shard_blocks=8, seed=11)
    draws = [(p.source_rank, p.block, d.epoch, d.shard) for p in plan.collect() for d in p.draws]
    assert len({d[:3] for d in draws}) == len(draws)
    per_shard = collections.Counter(d[3] for d in draws)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and set(per_shard) >= shards
    by_block = {d[:3]: d[3] for d in draws}
    ranks = {s.source: (s.source_rank, s.n_blocks) for s in sources.collect()}
    blocks = {r.row_key: r.block for r in mixing.with_block(sized, sources.select("source", "n_blocks"), 11).collect()}
    assert all(by_block[ranks[r.doc.source][0], blocks[r.row_key], d.epoch] == d.shard for r in rows for d in r.draws)


def test_mix_caps_and_odd_rows(spark, odd, none):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == 12 and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_report(none).count() == 0
    made = mixing.mixed_rows(odd, block_words=50, shard_blocks=2)
    assert made.columns == odd.columns
    skew = spark.createDataFrame([(i, "w " * (900 if i else 1), "a" if i else "b") for i in range(30)], "doc_id long, text string, source string")
    check_mix([r for r in sorted(mixing.mix_report(skew).collect(), key=lambda r: r.doc_id)], [(r.source, r.text) for r in sorted(skew.collect(), key=lambda r: r.doc_id)])


def test_splitting_tree_keeps_quotas(spark):
    root = spark.sql("select 0L as node, array(11L, 0L, 40L, 7L) as quotas")
    leaves = np.stack([r.counts for r in mixing.split_quotas(root, 4, seed=3).collect()])
    assert leaves.sum(axis=0).tolist() == [11, 0, 40, 7] and set(leaves.sum(axis=1)) <= {3, 4}
    draws = spark.range(4000).selectExpr(mixing.hypergeometric("30", "100", "40", "(id + 0.5) / 4000") + " as x").toPandas().x
    assert abs(draws.mean() - 12) < 0.05 and abs(draws.std() - math.sqrt(40 * 0.3 * 0.7 * 60 / 99)) < 0.05


def test_word_hashes_are_mixed():
    """Words that sums of powers confuse whatever the base, and long and short words, have hashes of their own."""
    for n in (64, 256, 1024):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        hashes, first = words.hash_words([word.encode(), word.translate(str.maketrans("ab", "ba")).encode()])
        assert len(set(hashes.tolist())) == 2 and first.tolist() == [0, 1, 2]
    texts = [r.encode() for r in ("One  two\tone", "", "TWO " + "x" * 300, "twox", " two x\n")]
    hashes, first = words.hash_words(texts)
    assert len(set(hashes.tolist())) == 5 and hashes[0] == hashes[2] and hashes[1] == hashes[3] == hashes[6] and first.tolist() == [0, 3, 3, 5, 6, 8]


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"t": pa.array(["x" * (1 << 20) if i == 5 else "y" for i in range(40)] * 5)})
    cut = list(columns.parts([batch, batch.slice(0, 0)], 1 << 20))
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict() and max(p.nbytes for p in cut) < 2.1 * (1 << 20)


def shingles(text):
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None and shingles(t)]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_near_duplicates_equal_brute_force(spark, odd, none):
    base = [f"w{i}" for i in range(120)]
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    rows += [(100_000 + k, " ".join(base[:k] + ["new"] * (k % 3) + base[k + k % 4 :])) for k in range(0, 120, 3)]
    rows += [(200_000 + k, " ".join([f"own{k}x{j}" for j in range(40)] + base[:60])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute_components(rows)
    for r in near_dedup.near_duplicates(docs).collect():
        assert r.component_id == wanted[r.doc_id] and r.n_shingles == len(shingles(dict(rows)[r.doc_id])) and r.kept == (r.doc_id == r.component_id)
    found = {(r.doc_id, r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 1, 12), (2, 1, 12), (5, 5, 1), (6, 5, 1), (3, 3, 0), (4, 4, 0)} <= found and any(d is None and c is None for d, c, _ in found)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.without_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "4", "5", "7", "8", "9", "None"]


def test_crowded_buckets_lose_no_link(spark):
    """Many far-edited copies: one bucket holds members of many components, so the second level decides."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(100)], []
    for k in range(90):
        words = list(base)
        for at in rng.choice(100, rng.integers(1, 6), replace=False):
            words[at] = f"n{k}_{at}"
        rows.append((k, " ".join(words)))
    wanted = brute_components(rows)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == wanted


def test_pipeline_drops_pairs_between_80_and_85(spark):
    rows = []
    for k in range(60):
        words = [f"d{k}w{j}" for j in range(200)]
        copy = [f"n{k}_{j}" if j in (40, 80, 120, 160) else w for j, w in enumerate(words)]
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        assert 0.8 <= len(a & b) / len(a | b) < 0.85
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()) == [2 * k for k in range(60)]
    for k, m in (near_dedup.FIRST, near_dedup.SECOND):
        assert near_dedup._level((k, m), 85) == (k, m) and (1 - 0.8**k) ** near_dedup._level((k, m), 80)[1] <= (1 - 0.85**k) ** m


def test_warc_round_trip(spark):
    page = "<p>" + "é" * 80
    pages = spark.createDataFrame([(3, "u", page), (1, None, page), (2, "http://x\r\nEvil: 1", page + "!"), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", page), (7, "u", "\r\n\r\n" * 40)], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc_bundles.archive_pages(pages).collect()}
    payload = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None), 7: ("response", None)}
    assert all((r.payload_bytes, r.payload_digest) == (len(payload[k]), hashlib.sha256(payload[k]).hexdigest()) for k, r in found.items())
    assert warc_bundles.archive_pages(pages.limit(0)).count() == 0


def test_frames_open_alone(spark):
    pages = spark.range(60).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 400) as html")
    bundles = warc_bundles.write_bundles(warc_bundles.classify(pages), frame_bytes=2000, bundle_bytes=4000)
    content = bundles.first().content
    table = warc_bundles.read_seek_table(content)
    assert bundles.count() > 1 and len(table) > 1 and warc_bundles.read_frame(content, table, 1).startswith(b"WARC/1.1")
    found = warc_bundles.lookup(bundles, spark.createDataFrame([(warc_bundles.page_urn(17),)], "record_id string")).collect()
    assert len(found) == 1 and b"17" * 400 in found[0].data


def test_suffix_tree_scores(spark, odd, none):
    docs = documents(spark)
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    counts = collections.Counter(t for k, ts in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for t in ts)
    n, total = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    rows = QUERIES["op6_suffix_tree_scores"](spark, SMALL).collect()
    for r in rows:
        ts = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.5) / total) for t in ts), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    tree, unigrams = suffix_tree.train(docs)
    symbols = np.arange(len(tree.root))
    for a, b in ((1, 1), (2, 3), (0, 2), (1, 0)):
        code = suffix_tree._code(np.array([a]), np.array([b]))
        assert math.isclose(suffix_tree.probabilities(tree, np.repeat(code, len(symbols)), symbols).sum(), 1, rel_tol=1e-9)
    assert suffix_tree.score(odd, tree, unigrams).count() == 12 and suffix_tree.score(none, tree, unigrams).count() == 0
    assert all(r.base_score == 0 for r in suffix_tree.score(odd, *suffix_tree.train(none)).collect() if r.n_tokens == 1)


def brute_tree(texts, keep=12.0, discount=0.5):
    """Counts of all runs of words, and a function for log P(word | all words before it)."""
    seen = [["<s>", *t.lower().split(), "</s>"] for t in texts]
    runs = collections.Counter(tuple(ts[i:j]) for ts in seen for i in range(len(ts)) for j in range(i + 1, min(len(ts), i + 9) + 1))
    n = sum(len(ts) - 1 for ts in seen)
    total = n + 0.5 * (len({t for ts in seen for t in ts[1:]}) + 1)
    entries = collections.defaultdict(dict)
    for r, c in runs.items():
        if len(r) > 1 and c >= 2:
            entries[r[:-1]][r[-1]] = c
    kept = {}

    def p(context, word):
        for k in range(len(context)):
            if (c := context[k:]) in kept:
                return kept[c][0] * p(c[1:], word) + max(0.0, entries[c].get(word, 0) - discount) / runs[c]
        return (0.5 + (runs[(word,)] if word != "<s>" else 0)) / total

    for length in range(1, 9):
        new = {}
        for c in [c for c in entries if len(c) == length]:
            below = {w: p(c[1:], w) for w in entries[c]}
            share = {w: x / runs[c] for w, x in entries[c].items()}
            rest, other = max(1e-12, 1 - sum(share.values())), max(1e-12, 1 - sum(below.values()))
            if runs[c] * (sum(s * math.log(s / below[w]) for w, s in share.items()) + rest * math.log(rest / other)) >= keep:
                new[c] = (1 - sum((x - discount) / runs[c] for x in entries[c].values()),)
        kept.update(new)
        if not new:
            break
    return kept, p


def test_suffix_tree_keeps_all_runs(spark):
    """A word and runs seen a few times among many others count, contexts of three words too, whatever the corpus' size."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 3000) for _ in range(300)]
    texts += [f"{a} {b} {c} then {'yes' if (a + b + c).count('q') % 2 else 'no'} u{k}" for k in range(40) for a in ("q", "r") for b in ("q", "r") for c in ("q", "r")]
    rows = [(k, t) for k, t in enumerate(texts)]
    learned = [t for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1]
    kept, p = brute_tree(learned)
    assert max(map(len, kept)) >= 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (2e-7, 0.01):
        tree, unigrams = suffix_tree.train(docs, depth=8, lookup_share=share)
        assert tree.longest == max(map(len, kept)) + 1
        assert suffix_tree.train(docs, depth=2)[0].longest == 3
        for r in suffix_tree.score(docs, tree, unigrams).collect():
            ts = ["<s>", *texts[r.doc_id].split(), "</s>"]
            wanted = sum(math.log10(p(tuple(ts[max(0, i - 8) : i]), ts[i])) for i in range(1, len(ts)))
            assert math.isclose(r.score, wanted, rel_tol=1e-9)


def test_rare_runs_are_joined_on_small_tables_too(spark):
    """What is broadcast is what occurs often, so that the joined share of the runs does not jump as the table grows."""
    tree, _ = suffix_tree.train(documents(spark))
    often = {r.gram for r in tree.model.where("n >= 12").select("gram").distinct().collect()}
    rare = {r.gram for r in tree.model.select("gram").distinct().collect()} - often
    assert tree.least_near == 12 and often and len(rare) > len(often)
    assert sorted(tree.near.keys[tree.near.keys > 0].view(np.int64).tolist()) == sorted(often)


def test_small_batches(spark):
    def sizes(batches):
        yield from (pa.record_batch({"n": pa.array([b.nbytes])}) for b in batches)

    rows = spark.range(3000).selectExpr("repeat('x', 1000) as t").coalesce(1)
    with small_batches(spark, 1 << 20):
        inside = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(inside) > 2 and max(inside) < 2 << 20 and rows.mapInArrow(sizes, "n long").count() == 1


def brute_windows(codes, w):
    """Positions that windows keep: the smallest, the rightmost on ties."""
    last = max(1, len(codes) - w + 1)
    return sorted({min(range(i, min(i + w, len(codes))), key=lambda j: (codes[j], -j)) for i in range(last)}) if codes else []


def test_winnowing_equals_brute_force(spark, odd, none):
    docs = documents(spark).unionByName(odd.select("doc_id", "text"), allowMissingColumns=True).select("doc_id", "text")
    tokens = docs.select("doc_id", winnowing.pieces(winnowing.words(docs.text)).alias("tokens"))
    rows = tokens.selectExpr("tokens", f"transform(sequence(1, greatest(1, size(tokens) - 4)), i -> xxhash64(slice(tokens, i, 5)) & ~{winnowing.LOW}L) as codes", f"{winnowing.window_minima('tokens', k=5, w=8)} as minima").where("size(tokens) > 0").collect()
    for r in rows:
        assert sorted({winnowing.LOW - (m & winnowing.LOW) - 1 for m in r.minima}) == brute_windows(r.codes, 8)
    assert winnowing.fingerprints(none).count() == 0 and winnowing.fingerprint_edits(none).count() == 0
    assert winnowing.fingerprint_edits(odd).count() == 12


def test_edited_texts_and_likeness(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_winnowing"](spark, SMALL).collect()}
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    ids = sorted(texts)
    whole = {r.doc_id: {p.hash for p in r.picked} for r in winnowing.fingerprints(documents(spark)).collect()}
    edits = {}
    for at, k in enumerate(ids):
        q = len(texts[k]) // 4
        edits[k] = texts[k][: len(texts[k]) - q] + texts[ids[(at + 1) % len(ids)]][:q]
        assert rows[k].edited_sha256 == hashlib.sha256(edits[k].encode()).hexdigest() and rows[k].n_chars == len(texts[k])
    edited = {r.doc_id: r.picked for r in winnowing.fingerprints(spark.createDataFrame(list(edits.items()), "doc_id long, text string")).collect()}
    for at, k in enumerate(ids):
        other, after = {p.hash for p in edited[k]}, whole[ids[(at + 1) % len(ids)]]
        assert math.isclose(rows[k].near_edited, len(whole[k] & other) / len(whole[k] | other)) and math.isclose(rows[k].near_next, len(whole[k] & after) / len(whole[k] | after))
        assert rows[k].edited_fingerprint.count(":") == len(edited[k])


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    rows = QUERIES["op8_sum_of_squares_packing"](spark, SMALL).collect()
    for k, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(i, at, min(4096, len(ids) - at)) for i, at in enumerate(range(0, len(ids), 4096))]
        assert all(r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    check_sequences(rows)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) + 2
    coder = packing.WordIds(path)
    odd_texts = ["a <|endoftext|> b", "x<|startoftext|>Y é", "A <|ENDOFTEXT|> b", "<|endoftext|>", "U\u0308 \xa0 x\x1cy"]
    for text, coded in zip(odd_texts, coder.encode([t.encode() for t in odd_texts]), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for docs, n in ((odd, 12), (none, 0)):
        made = packing.pack_documents(docs, path).collect()
        check_sequences(made)
        assert sum(r.piece == 0 for r in made) == n


def check_sequences(rows):
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_sum_of_squares_choice():
    """Each placement is the one whose sum of squared counts is smallest, by trying all."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 12, 150)
    bins, offsets = packing.sum_of_squares(lengths, 12)
    gaps: dict[int, int] = {}

    def cost(levels):
        return sum(v * v for g, v in collections.Counter(levels.values()).items() if 0 < g < 12)

    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        tried = [cost(gaps | {k: g - s}) for k, g in gaps.items() if g >= s] + [cost(gaps | {-1: 12 - s})]
        gaps[b] = gaps.get(b, 12) - s
        assert o == 12 - s - gaps[b] and cost(gaps) == min(tried)


def test_pipeline(spark):
    docs, found = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == before.columns
        found[name] = docs.count()
    assert found["language_id"] >= found["near_dedup"] == found["pii"] > 0 and found["mixing"] > 0
    wanted = brute_components([(r.doc_id, r.text) for r in documents(spark).collect()])
    assert found["near_dedup"] <= len(set(wanted.values()))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_sequences(rows)
    assert sum(r.piece == 0 for r in rows) == found["mixing"] and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]
