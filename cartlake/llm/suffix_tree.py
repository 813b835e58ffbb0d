"""Language-model scores from a probabilistic suffix tree over words.

Tokens are a text's words (ASCII letters in lower case) and one end. Every word of the training texts is a symbol of its
own; a start stands before each text. A context is a run of at most ``depth`` words before a position, within its text. It
is a candidate if it has entries, n-grams that occur at least ``least`` times, and it is retained if its next-symbol
distribution differs from that of its longest retained suffix: count times divergence reaches ``keep_nats``. Contexts
become longer, word by word, up to the depth or a length of which none is retained. Distributions are smoothed by absolute
discounting: what is taken off goes to the suffix's distribution, at the root to the base model. Each position is
scored in the state of its longest retained suffix.

All counts are exact, cover all training documents and are cut at a number, not at a share: the tree grows with the
corpus. A run's hash is made of those of the two runs that lack its last and its first word, so these two name it. Tasks
count runs in blocks of sorted arrays, dealt out by the runs' hashes, and other tasks add the blocks up; what occurs
``least`` times becomes rows of Spark tables. An entry's value is what it adds to the score in its suffix's state, so a
text's score is a sum over its runs of words, each met once, in any order. It is taken length by length, so that only
one length's runs travel at a time; ``docs`` is read for each, and must give the same rows in the same order, as stored
tables do. Two things are broadcast, and neither changes a result: the values of runs with at least ``lookup_share`` of all tokens (at most 1 / share a length) and at least ``lookup_least``
occurrences, which are so not joined and cannot be hot keys, while small and large inputs join the same kinds of runs; and a set of bits of a fixed size that tells which runs surely are not in the tree.

Defined cases: null text is empty and has one token, the end; null ids are learned from; with no training text every
base probability is 1; equal texts get equal scores; rows that repeat are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.llm.columns import _arrow, map_batches, need, parts, record, utf8
from cartlake.llm.staging import freed, short_shuffles, small_batches, staged
from cartlake.llm.words import blocks, hash_words, mix

END = np.uint64(0xE0D0E0D0E0D0E0D1)  # stands for the end among word hashes
START = np.uint64(0x57A257A257A257A3)
HELD = 1_500_000
RUNS = "gram long, ctx long, tail long, n long"
BLOCKS = "part int, counts binary"
PART_TEXT = 32 << 20  # bytes of text whose runs one task adds up
BITS = 1 << 27
BIT_BLOCKS = 64  # pieces in which bits travel
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Values of 64-bit keys in an open-addressing table, looked up for whole arrays; it travels without its empty slots."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, values.dtype)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slots] == 0
            here, first = np.unique(slots[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[here], self.values[here] = keys[left[chosen]], values[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slots = left[rest], (slots[rest] + 1) & int(self.mask)

    def __reduce__(self) -> tuple:
        held = np.flatnonzero(self.keys)
        return Table, (self.keys[held], self.values[held])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray, missing) -> np.ndarray:
        found = np.full(len(keys), missing, self.values.dtype)
        at, slots = None, self._slots(keys)
        while len(slots):
            stored = self.keys[slots]
            hit = stored == keys
            if at is None:
                found[hit] = self.values[slots[hit]]
            else:
                found[at[hit]] = self.values[slots[hit]]
            on = ~hit & (stored != 0)
            at = np.flatnonzero(on) if at is None else at[on]
            keys, slots = keys[on], (slots[on] + 1) & int(self.mask)
        return found


class Bits:
    """A set of bits of a fixed size: where a key's bit is missing, the key is in no row."""

    def __init__(self, keys: DataFrame) -> None:
        kinds = _arrow(BLOCKS)

        def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(BITS >> 6, np.uint64)
            for batch in batches:
                at = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64(BITS - 1))
                slots = (at >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.diff(slots, prepend=-1))
                if len(at):
                    words[slots[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            for i, own in enumerate(np.split(words, BIT_BLOCKS)):
                if own.any():
                    yield record({"part": [i], "counts": [own.tobytes()]}, kinds)

        def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = np.frombuffer(own, np.uint64)
                    whole[i] = whole[i] | words if i in whole else words
            for i, words in whole.items():
                yield record({"part": [i], "counts": [words.tobytes()]}, kinds)

        self.words = np.zeros(BITS >> 6, np.uint64)
        blocks_of = np.split(self.words, BIT_BLOCKS)
        found = keys.select("gram").mapInArrow(marked, BLOCKS).repartition("part").mapInArrow(joined, BLOCKS).toArrow()
        for part, counts in zip(*(c.to_pylist() for c in found.columns), strict=True):
            blocks_of[part][:] = np.frombuffer(counts, np.uint64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(BITS - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Tree(NamedTuple):
    """The stored tree. ``pieces`` by the words in a run: gram, c (of words), n, entry and back, natural logarithms that a run adds, all its rows together."""

    n: int
    v: int
    longest: int  # words in the longest run
    pieces: dict[int, DataFrame]
    near: Table  # run of words -> place in the next two
    near_c: np.ndarray
    near_add: np.ndarray
    bits: Bits  # of runs of two words and more
    least_near: float  # the count from which runs are in ``near``

    @property
    def model(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.pieces.values())

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of all words: collected, to look into small trees."""
        codes, n = _collected(self.model.where("c > 0").select(F.col("gram").alias("code"), F.col("c").alias("n")))
        return codes[codes != END], n[codes != END]

    @property
    def root(self) -> np.ndarray:
        """Probabilities of an unseen word, the end and each of ``words``."""
        return (np.concatenate([[0], _collected(self.model.where((F.col("c") > 0) & (F.col("gram") == _signed(END))).select("gram", F.col("c").alias("n")))[1][:1], self.words[1]]) + 0.5) / self.total


def _signed(x: np.uint64) -> int:
    return int(x.astype(np.int64))


def held_out(remainder: int = 1, parts: int = 5) -> Column:
    """Whether a document is kept out of learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def _tokens(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of texts: the first text's place, all hashes with starts and ends, and the place of each text's start."""
    for lo, hi in blocks(texts):
        hashes, first = hash_words(texts[lo:hi])
        m = len(first) - 1
        at = np.stack([first[:-1], first[1:]], axis=1).reshape(-1)
        yield lo, np.insert(hashes, at, np.tile(np.array([START, END]), m)), first + 2 * np.arange(len(first))


def _place(first: np.ndarray) -> np.ndarray:
    """Each token's place in its text; the start has 0."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def _longer(runs: np.ndarray) -> np.ndarray:
    """Hashes of runs of one more token, by their last token: of the run before and the run here."""
    return mix(np.concatenate([np.zeros(1, np.uint64), runs[:-1]]) * _BASE + runs)


def _added_up(ctx: np.ndarray, tail: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs by their hashes, with the shorter runs that name them and their summed counts."""
    gram = mix(ctx * _BASE + tail)
    order = np.argsort(gram)
    sorted_ = gram[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(gram) else order
    at = order[first]
    return gram[at], ctx[at], tail[at], np.add.reduceat(n[order], first) if len(first) else n


def _summed(docs: DataFrame, length: int, n_parts: int, least: int, shared: Broadcast | None = None) -> DataFrame:
    """``gram, ctx, tail, n``: how often each run of ``length`` occurs, if ``least`` times, and the runs without its last and its first token.

    Runs that hold a shorter one missing in the ``shared`` bits are left out. A word's own run is named by its hash twice. Each task sends a run once for every ``HELD`` tokens.
    """
    kinds, rows = _arrow(BLOCKS), _arrow(RUNS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ctx, tail = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            gram, ctx, tail, n = _added_up(ctx, tail, np.ones(len(ctx), np.int64))
            # Parts are ranges of the hash, in whose order the runs are.
            cuts = np.searchsorted((gram >> np.uint64(40)) * np.uint64(n_parts) >> np.uint64(24), np.arange(n_parts + 1, dtype=np.uint64))
            own = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return record({"part": [p for p, x in enumerate(own) if x.start < x.stop], "counts": [b"".join((ctx[x].tobytes(), tail[x].tobytes(), n[x].astype("<u4").tobytes())) for x in own if x.start < x.stop]}, kinds)

        for batch in parts(batches):
            for _, tokens, first in _tokens(batch.column(0).to_pylist()):
                tail = tokens
                for _ in range(length - 2):
                    tail = _longer(tail)
                inside = np.flatnonzero(_place(first) >= max(1, length - 1))
                if shared:
                    known = shared.value.may_hold(tail)
                    inside = inside[known[inside] & known[inside - 1]]
                held.append((tail[inside - (length > 1)], tail[inside]))
                size += len(inside)
                if size >= HELD:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for counts in batch.column(1).to_pylist():
                n = len(counts) // 20
                held.append((np.frombuffer(counts, np.uint64, n), np.frombuffer(counts, np.uint64, n, 8 * n), np.frombuffer(counts, "<u4", n, 16 * n).astype(np.int64)))
        if held:
            gram, ctx, tail, n = _added_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
            often = n >= least
            gram, ctx, tail, n = (x[often] for x in (ctx if length == 1 else gram, ctx, tail, n))
            for at in range(0, len(gram), 100_000):
                part = slice(at, at + 100_000)
                yield record({"gram": pa.array(gram[part].view(np.int64)), "ctx": pa.array(ctx[part].view(np.int64)), "tail": pa.array(tail[part].view(np.int64)), "n": pa.array(n[part])}, rows)

    return docs.select("utf8").mapInArrow(count, BLOCKS).repartitionById(n_parts, "part").mapInArrow(add_up, RUNS)


def _code(*symbols: np.ndarray) -> np.ndarray:
    """One number for a sequence of up to three places in ``Tree.root``, never 0; to look into small trees."""
    total = np.ones(1, np.uint64)
    for s in symbols:
        total = total << np.uint64(21) | s.astype(np.uint64)
    return total


def train(docs: DataFrame, *, depth: int = 2, lookup_share: float = 1e-7, lookup_least: int = 12, least: int = 2, keep_nats: float = 12.0, discount: float = 0.5) -> tuple[Tree, DataFrame]:
    """The tree and the stored table (gram, n) of all training tokens' counts."""
    with short_shuffles(docs.sparkSession), small_batches(docs.sparkSession):
        return _trained(docs, depth, lookup_share, lookup_least, least, keep_nats, discount)


def _trained(docs: DataFrame, depth: int, lookup_share: float, lookup_least: int, least: int, keep_nats: float, discount: float) -> tuple[Tree, DataFrame]:
    learned = need(docs, "doc_id", "text").where(~held_out()).select(utf8().alias("utf8"))
    size = learned.agg(F.sum(F.octet_length("utf8"))).first()[0] or 0
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_TEXT + 1)
    unigrams = staged(_summed(learned, 1, n_parts, 1).select("gram", "n"), "unigrams")
    n, v = (int(x or 0) for x in unigrams.agg(F.sum("n"), F.count("*")).first())
    total = n + 0.5 * (v + 1)
    started = unigrams.where(F.col("gram") == _signed(END)).select(F.lit(_signed(START)).alias("gram"), "n")
    shorter = unigrams.unionByName(started).withColumn("lp", F.log((F.col("n") + 0.5) / total))
    pieces = {1: unigrams.select("gram", F.col("n").alias("c"), "n", F.lit(0.0).alias("entry"), F.lit(0.0).alias("back"))}
    longest, grown, shared = 1, None, None
    while longest <= depth:
        # Stored by itself, so that the blocks are gone before the counts travel to their suffixes.
        counts = staged(_summed(learned, longest + 1, n_parts, least, shared), "counts")
        parents = shorter.select(F.col("gram").alias("tail"), F.col("lp").alias("parent"))
        rows = staged(counts.join(parents.hint("shuffle_hash"), "tail").select("gram", "ctx", "n", "parent"), "candidates")
        freed(counts)
        if shared:
            shared.destroy()
        retained = staged(_retained(rows, shorter, keep_nats, discount), "retained")
        last, grown = grown, staged(_grown(rows, retained, discount), "grown")
        freed(rows, *([last] if last else []))
        kept = grown.where("entry is not null")
        if not kept.take(1):
            break
        pieces[longest] = pieces[longest].unionByName(retained.select(F.col("ctx").alias("gram"), F.lit(None).cast("long").alias("c"), F.col("of").alias("n"), F.lit(0.0).alias("entry"), "back"))
        longest += 1
        pieces[longest] = staged(kept.select("gram", F.lit(None).cast("long").alias("c"), "n", "entry", F.lit(0.0).alias("back")), "entries")
        shorter = grown.select("gram", "n", "lp")
        shared = docs.sparkSession.sparkContext.broadcast(Bits(grown)) if longest <= depth else None
    freed(*([grown] if grown else []))
    # A run may be an entry, a context and a word: it has a row for each, and their values add up.
    model = reduce(DataFrame.unionByName, pieces.values())
    least_near = max(float(lookup_least), lookup_share * n)
    common = model.where(F.col("n") >= least_near)
    near = common.groupBy("gram").agg(F.coalesce(F.max("c"), F.lit(0)).alias("c"), F.sum(F.col("entry") + F.col("back")).alias("add")).toArrow()
    keys = near.column(0).to_numpy().view(np.uint64)
    return Tree(n, v, longest, pieces, Table(keys, np.arange(len(keys), dtype=np.int32)), near.column(1).to_numpy().astype(np.int64 if n >> 31 else np.int32), near.column(2).to_numpy(), Bits(model.where("c is null")), least_near), unigrams


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A small table's two columns as arrays, by the first."""
    found = counts.toArrow()
    codes, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def _retained(rows: DataFrame, shorter: DataFrame, keep_nats: float, discount: float) -> DataFrame:
    """ctx, of (its count) and back of the contexts whose distribution differs enough from that after their suffix."""
    n, parent = F.col("n"), F.col("parent")
    sums = rows.groupBy("ctx").agg(F.sum(n * (F.log(n) - parent)).alias("gain"), F.sum("n").alias("held"), F.sum(F.exp(parent)).alias("below"), F.count("*").alias("entries"))
    sums = shorter.select(F.col("gram").alias("ctx"), F.col("n").alias("of")).join(sums.hint("shuffle_hash"), "ctx")
    rest, parent_rest = F.greatest(F.lit(1e-12), 1 - F.col("held") / F.col("of")), F.greatest(F.lit(1e-12), 1 - F.col("below"))
    # of * divergence: over the entries n * (log(n / of) - parent), and what they leave
    weight = F.col("gain") - F.col("held") * F.log("of") + F.col("of") * rest * F.log(rest / parent_rest)
    return sums.where(weight >= keep_nats).select("ctx", "of", F.log(1 - (F.col("held") - discount * F.col("entries")) / F.col("of")).alias("back"))


def _grown(rows: DataFrame, retained: DataFrame, discount: float) -> DataFrame:
    """gram, n, lp and entry of candidates; entry is null where the context is not retained."""
    lp = F.log((F.col("n") - discount) / F.col("of") + F.exp(F.col("back") + F.col("parent")))
    made = rows.join(retained.hint("shuffle_hash"), "ctx", "left").withColumn("lp", F.coalesce(lp, "parent"))
    return made.select("gram", "n", "lp", (F.col("lp") - F.col("parent") - F.col("back")).alias("entry"))


def probabilities(tree: Tree, contexts: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """P(symbol | context) for arrays of context codes (of two symbols) and symbols; collects the tree, so for small ones."""
    words, root = tree.words[0], tree.root
    found = tree.model.groupBy("gram").agg(F.sum("entry").alias("entry"), F.sum("back").alias("back")).toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    at, low = Table(keys, np.arange(len(keys), dtype=np.int32)), np.uint64((1 << 21) - 1)
    entry, back = (np.append(found.column(i).to_numpy(), 0.0) for i in (1, 2))
    as_context, as_symbol = (np.concatenate([np.array([1, x], np.uint64), words]) for x in (START, END))
    last, before = (as_context[(contexts >> np.uint64(k) & low).astype(np.int64)] for k in (0, 21))
    own = as_symbol[symbol]
    log_p = np.log(root[symbol])
    tail = own
    for run in (last, mix(before * _BASE + last)):
        tail = mix(run * _BASE + tail)
        log_p += back[at.find(run, -1)] + entry[at.find(tail, -1)]
    return np.exp(log_p)


#: A run that is joined, with its occurrences in the text (below zero: as a word), or a text's own sums; ``size`` is twice its tokens, and one more if it is held out.
SCORED = "row_id long, gram long, n int, own struct<doc_id: bigint, size: bigint, known: bigint, base: double, added: double>"


def score(docs: DataFrame, tree: Tree, unigrams: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((tree.near, np.append(tree.near_c, tree.near_c.dtype.type(0)), np.append(tree.near_add, 0.0), tree.bits))
    lengths = [range(1, min(tree.longest, 2) + 1), *([k] for k in range(3, tree.longest + 1))]
    with short_shuffles(docs.sparkSession), small_batches(docs.sparkSession):
        added = reduce(DataFrame.unionByName, [staged(_added(docs, tree, own, shared), "added") for own in lengths])
    shared.destroy()
    sums = added.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("more").alias("more"))
    return sums.select("doc_id", (F.col("size") % 2 == 1).alias("held_out"), F.shiftright("size", 1).alias("n_tokens"), "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("more")).alias("score"))


def _added(docs: DataFrame, tree: Tree, lengths: Iterable[int], shared: Broadcast) -> DataFrame:
    """Per row what its runs of these ``lengths`` add: row_id, doc_id, size, n_known, base_score and more; what words tell is 0 without length 1."""
    kinds, own_kinds, total, lengths = _arrow(SCORED), list(_arrow(SCORED).field("own").type), tree.total, list(lengths)

    def work(batch: pa.RecordBatch):
        near, near_c, near_add, bits = shared.value
        row, doc, held = (batch.column(i) for i in range(3))
        for lo, tokens, first in _tokens(batch.column(3).to_pylist()):
            m = len(first) - 1
            of, place = np.repeat(np.arange(m), np.diff(first)), _place(first)
            sums, far, far_of, far_words = [np.zeros(m) for _ in range(3)], [], [], []
            if 1 in lengths:
                at = near.find(tokens, -1)
                c = near_c[at]
                base = np.where(c > 0, np.log10((np.maximum(c, 1) + 0.5) / total), 0.0)
                sums = [np.bincount(of, x, m) for x in (c > 0, base, near_add[at])]
                unmet = np.flatnonzero(at < 0)
                far, far_of, far_words = [tokens[unmet]], [of[unmet]], [(place[unmet] > 0).astype(np.int64)]
            runs = tokens
            for length in range(2, max(lengths) + 1):
                runs = _longer(runs)
                if length not in lengths:
                    continue
                inside = np.flatnonzero(place >= length - 1)
                inside = inside[bits.may_hold(runs[inside])]
                at = near.find(runs[inside], -1)
                sums[2] += np.bincount(of[inside], near_add[at], m)
                unmet = inside[at < 0]
                far.append(runs[unmet])
                far_of.append(of[unmet])
                far_words.append(np.zeros(len(unmet), np.int64))
            far, far_of, far_words = (np.concatenate(x) for x in (far, far_of, far_words))
            ids = row.slice(lo, m).to_numpy()
            by = np.lexsort((far, far_of))
            w, d, one = far[by], far_of[by], far_words[by]
            new = np.flatnonzero(np.diff(w, prepend=~w[:1]).astype(bool) | np.diff(d, prepend=-1).astype(bool))
            n = np.diff(np.append(new, len(w)))
            # The text's own row meets no run: a number that spreads rows, and zero occurrences.
            size = 2 * (np.diff(first) - 1) + held.slice(lo, m).to_numpy(zero_copy_only=False)
            own = pa.StructArray.from_arrays([doc.slice(lo, m), *(pa.array(x) for x in (size.astype(np.int64), sums[0].astype(np.int64), sums[1], sums[2]))], fields=own_kinds)
            yield record({"row_id": pa.array(ids), "gram": pa.array(mix(ids.view(np.uint64)).view(np.int64)), "n": np.zeros(m, np.int32), "own": own}, kinds)
            if len(new):
                signed = np.where(one[new] > 0, -n, n).astype(np.int32)
                yield record({"row_id": pa.array(ids[d[new]]), "gram": pa.array(w[new].view(np.int64)), "n": signed, "own": pa.nulls(len(new), kinds.field("own").type)}, kinds)

    rows = need(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), held_out().alias("held_out"), utf8().alias("utf8"))
    model = reduce(DataFrame.unionByName, [tree.pieces[k] for k in lengths])
    met = map_batches(rows, work, SCORED).join(model.where(F.col("n") < tree.least_near).select("gram", "c", (F.col("entry") + F.col("back")).alias("add")).hint("shuffle_hash"), "gram", "left")
    # A word that is a context too has a second row, without c: only that with c, or none at all, gives the base.
    words = F.greatest(F.lit(0), -F.col("n"))
    known = F.when(F.col("c") > 0, words).otherwise(0) + F.coalesce("own.known", F.lit(0))
    lone = F.when((words > 0) & (F.col("c").isNotNull() | F.col("add").isNull()), words * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / tree.total)).otherwise(0.0)
    more = F.abs("n") * F.coalesce("add", F.lit(0.0)) + F.coalesce("own.added", F.lit(0.0))
    sums = met.groupBy("row_id").agg(F.max("own.doc_id").alias("doc_id"), F.max("own.size").alias("size"), F.sum(known).alias("n_known"), F.sum(lone + F.coalesce("own.base", F.lit(0.0))).alias("base_score"), F.sum(more).alias("more"))
    return sums.withColumn("more", F.col("more") / float(np.log(10)))
