"""A trie of conversations' prefixes, with a count-min screen in front of the exact grouping.

``ordered_turns`` gives each turn its position and a 120-bit key of role and text; ``grafted`` rebuilds conversations that
begin as another one; ``prefix_trie`` takes turns (conv_id, pos, key_hi, key_lo, n_bytes) and makes a row for each node.
A prefix has a 128-bit digest: the exclusive or of its turns' hashes with their positions, so it runs over blocks of
positions (``cartlake.functions.ordered``) and no conversation, however long, is one task's.

Screen: each task counts the digests of its prefixes in ``ROWS`` arrays of ``cells`` saturating counters; the arrays meet by
slices, and only one bit a counter (more than one, or not) is broadcast: at most ROWS * MOST_CELLS / 8 bytes, 6 MB, whatever
the input. An estimate of one proves that no other conversation has the prefix, so it and all longer ones of its
conversation are singletons: their nodes are made where they are. All others are grouped exactly by digest. On more
prefixes than the counters can tell apart more is grouped and results are the same.

Sums over subtrees are sums over members: what a node adds is put on its smallest member at the node's depth, each
conversation sums that from its end backwards, and a node sums it over its members. So no level is walked and a hot
first turn meets as partial sums. The hash of a node's ends is a chain over ordered text: ranges of (node, conv_id) are
joined to text where they lie, and only nodes that cross a range's bound meet again, as blocks of text that stream
through one hash.

Defined cases: turns are ordered by turn (null first), then by role and text; rows that agree in conv_id, turn and the
first 32 characters of role and text share a range; null role or text is empty; rows without a conv_id take no part;
repeated rows are turns of their own; an empty table gives no node, not even the root; a conversation without turns
is a member of the root and ends there; negative ids keep their sign in the remainder; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.functions.ordered import along, placed
from cartlake.llm.columns import _arrow, need, record
from cartlake.llm.staging import staged

ROWS, MOST_CELLS, SLICE = 3, 1 << 24, 1 << 16
CHUNK_IDS, MOST_BLOCKS = 1 << 15, 64  # ids of one block of text; blocks of a node that one task may hold
BLOCK = 4096  # positions of a conversation that one window holds
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "hi", "lo"]
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
ADD = (F.sum, lambda a, b: a + b)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key_hi, key_lo, n_bytes; the texts stay behind."""
    rows = need(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.withColumns({"key_" + n: F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for n, at in (("hi", 1), ("lo", 16))} | {"n_bytes": F.octet_length("text").cast("long")})
    at = placed(rows, ["conv_id", "turn", "role", "text"], by=["conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32)], keep=["conv_id", "key_hi", "key_lo", "n_bytes"])
    first = at.groupBy("conv_id").agg(F.min("place").alias("first"))
    return staged(at.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("pos"), "key_hi", "key_lo", "n_bytes"), "turns")


def grafted(turns: DataFrame, *, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of the rebuilt conversations: c takes the first crc32(c) % heads turns of c - c % family, then its own
    from there on. What is taken is at most ``heads`` - 1 turns, so it travels as one short array a family."""
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads))
    turns = turns.withColumn("h", taken)
    convs = turns.where("pos = 0").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    entry = F.struct("pos", "key_hi", "key_lo", "n_bytes")
    head = turns.where((F.col("pos") < heads - 1) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(entry)).alias("head"))
    convs = staged(convs.join(head, "base", "left").select("conv_id", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array()).alias("head")), "heads")
    begins = convs.select("conv_id", F.inline("head")).select("conv_id", "pos", "key_hi", "key_lo", "n_bytes")
    shift = convs.select("conv_id", F.size("head").alias("n_head"))
    rest = turns.where("pos >= h").join(shift, "conv_id").select("conv_id", (F.col("n_head") + F.col("pos") - F.col("h")).alias("pos"), "key_hi", "key_lo", "n_bytes")
    return begins.unionByName(rest), convs.select("conv_id")


def prefixes(turns: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Each turn's prefix: conv_id, depth, its digest (hi, lo) and its parent's (up_hi, up_lo), n_bytes."""
    pos = F.col("pos").cast("long")
    hashed = turns.select("conv_id", pos.alias("pos"), "n_bytes", F.xxhash64(pos, "key_hi", "key_lo").alias("own_hi"), F.xxhash64("key_lo", "key_hi", pos, F.lit(7)).alias("own_lo"))
    run = along(hashed.withColumns({"hi": F.col("own_hi"), "lo": F.col("own_lo")}), "conv_id", "pos", {"hi": XOR, "lo": XOR}, block=block)
    return run.select("conv_id", (F.col("pos") + 1).alias("depth"), "hi", "lo", F.col("hi").bitwiseXOR(F.col("own_hi")).alias("up_hi"), F.col("lo").bitwiseXOR(F.col("own_lo")).alias("up_lo"), "n_bytes")


def _cells(hi: np.ndarray, lo: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """A digest's counter in each row; ``cells`` is a power of two."""
    for row in range(ROWS):
        yield ((hi >> np.uint64(20 * row)) ^ (lo >> np.uint64(17 * row)) * np.uint64(2 * row + 1)) & np.uint64(cells - 1)


def _digests(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("hi", "lo"))


def sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """ROWS x cells bits: whether a counter exceeds one. Counters saturate at two and meet by slices."""
    schema = "slice int, counts binary"
    kinds = _arrow(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            for row, at in enumerate(_cells(*_digests(batch), cells)):
                where, n = np.unique(at, return_counts=True)
                held[row, where] = np.minimum(held[row, where] + np.minimum(n, 2).astype(np.uint8), 2)
        flat = held.reshape(-1)
        for k in range(0, len(flat), SLICE):
            if flat[k : k + SLICE].any():
                yield record({"slice": [k // SLICE], "counts": [zlib.compress(flat[k : k + SLICE].tobytes(), 1)]}, kinds)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(0, np.uint8)
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.uint8)
                if k != at:
                    if at is not None:
                        yield record({"slice": [at], "counts": [np.packbits(held > 1).tobytes()]}, kinds)
                    at, held = k, np.zeros(len(counts), np.uint8)
                held = np.minimum(held + counts, 2)
        if at is not None:
            yield record({"slice": [at], "counts": [np.packbits(held > 1).tobytes()]}, kinds)

    slices = rows.select("hi", "lo").mapInArrow(count, schema).repartition("slice").sortWithinPartitions("slice").mapInArrow(meet, schema)
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for k, packed in slices.collect():
        bits[k * SLICE // 8 : k * SLICE // 8 + len(packed)] = np.frombuffer(packed, np.uint8)
    return np.unpackbits(bits).astype(bool).reshape(ROWS, cells)


def screened(rows: DataFrame, *, most_cells: int = MOST_CELLS) -> DataFrame:
    """``rows`` of prefixes with ``single``: proven to be of one conversation alone, as is each longer prefix of it."""
    cells = SLICE
    n = rows.count()
    while cells < min(4 * n, most_cells):
        cells *= 2
    more = rows.sparkSession.sparkContext.broadcast(np.packbits(sketch(rows, cells), axis=1))
    schema = rows.select("*", F.lit(False).alias("alone")).schema
    kinds = _arrow(schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = np.zeros(batch.num_rows, bool)
            for bits, at in zip(more.value, _cells(*_digests(batch), cells), strict=True):
                alone |= (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))) & 1) == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone)], schema=kinds)

    marked = staged(rows.mapInArrow(mark, schema), "marked")
    from_ = marked.where("alone").groupBy("conv_id").agg(F.min("depth").alias("single_from"))
    return marked.drop("alone").join(from_, "conv_id", "left").withColumn("single", F.col("depth") >= F.coalesce("single_from", F.lit((1 << 63) - 1)))


def end_hashes(ends: DataFrame) -> DataFrame:
    """``depth, hi, lo, ends_sha256`` for rows (depth, hi, lo, conv_id): the hash of each node's ids in order, comma-joined."""
    schema = "depth long, hi long, lo long, first long, ids binary, ends_sha256 string"
    kinds = _arrow(schema)

    def rows_of(node: tuple, parts: list[tuple[int, bytes]], whole: bool) -> pa.RecordBatch:
        if whole:
            return record({"depth": [node[0]], "hi": [node[1]], "lo": [node[2]], "first": [None], "ids": [None], "ends_sha256": [hashlib.sha256(b",".join(b for _, b in parts)).hexdigest()]}, kinds)
        return record({n: [node[i]] * len(parts) for i, n in enumerate(NODE)} | {"first": [a for a, _ in parts], "ids": [b for _, b in parts], "ends_sha256": [None] * len(parts)}, kinds)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's nodes. The first and the last may go on in other ranges and leave as blocks, as do nodes of very many blocks."""
        node, ids, first, blocks, split = None, [], 0, [], True

        def close_block() -> None:
            if ids:
                blocks.append((first, b",".join(ids)))
                ids.clear()

        for batch in batches:
            for *key, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (key := tuple(key)) != node:
                    close_block()
                    if node is not None:
                        yield rows_of(node, blocks, whole=not split)
                        split = False
                    node, blocks = key, []
                if not ids:
                    first = conv
                ids.append(b"%d" % conv)
                if len(ids) == CHUNK_IDS:
                    close_block()
                    split |= len(blocks) > MOST_BLOCKS
                    if split:
                        yield rows_of(node, blocks, whole=False)
                        blocks = []
        close_block()
        if node is not None:
            yield rows_of(node, blocks, whole=False)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True))
        for node, parts in groupby(entries, key=lambda r: r[:3]):
            held = hashlib.sha256()
            for k, (*_, ids) in enumerate(parts):
                held.update(b"," * (k > 0) + ids)
            yield record({n: [node[i]] for i, n in enumerate(NODE)} | {"first": [None], "ids": [None], "ends_sha256": [held.hexdigest()]}, kinds)

    ranged = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = staged(ranged.mapInArrow(join, schema), "ends")
    rest = joined.where("ends_sha256 is null").repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(chain, schema)
    return joined.where("ends_sha256 is not null").unionByName(rest).select(*NODE, "ends_sha256")


def prefix_trie(turns: DataFrame, convs: DataFrame, *, most_cells: int = MOST_CELLS, block: int = BLOCK) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    ``turns`` has dense positions from 0 for each conversation; ``convs`` has each conversation once, those without turns too.
    """
    rows = screened(staged(prefixes(turns, block=block), "prefixes"), most_cells=most_cells)
    last = turns.groupBy("conv_id").agg((F.max("pos") + 1).cast("long").alias("length"))
    rows = rows.join(last, "conv_id").withColumn("ends", F.expr("depth = length")).drop("length")
    zero = F.lit(0).cast("long")
    root = convs.join(last, "conv_id", "left").select("conv_id", *(zero.alias(c) for c in ("depth", "hi", "lo", "up_hi", "up_lo", "n_bytes")), F.lit(None).cast("long").alias("single_from"), F.lit(False).alias("single"), F.isnull("length").alias("ends"))
    rows = staged(root.unionByName(rows), "screened")
    alone, shared = rows.where("single"), rows.where("not single")

    nodes = staged(shared.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo")), "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")]
    tails = alone.where("depth = single_from")  # one row a conversation at most
    children = nodes.where("depth > 0").select(*parent).unionByName(tails.select(*parent)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, NODE, "left").na.fill({"n_children": 0}), "families")

    weights = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    weights = weights.unionByName(tails.select("conv_id", F.col("depth") - 1, F.lit(1).cast("long"), zero).toDF("conv_id", "depth", "n_leaves", "saved_tokens")).groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")))
    weighed = shared.select("conv_id", *NODE).join(weights, ["conv_id", "depth"], "left").na.fill({"n_leaves": 0, "saved_tokens": 0})
    sums = along(weighed, "conv_id", "depth", {"n_leaves": ADD, "saved_tokens": ADD}, backwards=True, block=block).groupBy(*NODE).agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")))

    names = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    up = [(F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), "parent_conv_id"]
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hashes = end_hashes(shared.where("ends"))
    inner = nodes.join(sums, NODE).join(hashes, NODE, "left").join(names.select(*up), ["depth", "up_hi", "up_lo"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    own = alone.select("conv_id", "depth", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"), "single_from", "up_hi", "up_lo")
    begins = own.where("depth = single_from").join(names.select(*up), ["depth", "up_hi", "up_lo"], "left")
    further = own.where("depth > single_from").withColumn("parent_conv_id", F.col("conv_id"))
    return inner.select(*result).unionByName(begins.select(*result)).unionByName(further.select(*result))


def rebuilt_trie(conversations: DataFrame, *, family: int = 5, heads: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns, convs = grafted(ordered_turns(conversations), family=family, heads=heads)
    return prefix_trie(staged(turns, "rebuilt"), convs)
