"""Near-duplicates by MinHash with tensored banding, every link confirmed on full shingle sets.

A document's set is its distinct shingles of five words; documents with equal sets form a class, and one class
member stands for it. Two small collections of hashes, each of ``m`` keys of ``k`` minhashes, are computed for
each class; every pair of one key from each collection is a table key, so that 2mk minhashes serve m*m tables of
2k minhashes. Two sets of similarity s share a table with probability (1 - (1 - s^k)^m)^2: for the first level
(k 3, m 10) 0.99985 at s = 0.85 and 0.999996 at 0.9.

Within a table's bucket no pairs of all members are formed. Members are compared with the smallest members of their
buckets, and what is confirmed forms components. The members of every bucket that then still holds more than one
component (documents that share a passage, or far-edited copies of one text), whatever its size, go to a second level of
longer keys. There, members outside the component of a bucket's smallest member ("strays") are compared with members of
other components. The shingles that only one of these documents holds are counted first: they cannot be common to two,
which bounds a pair's similarity from above, and the bound is part of the join. The keys of the second level are not
paired: 80 tables of 12 minhashes find a pair at 0.85 with probability 0.999995 and let unlike pairs meet in few tables,
where paired keys multiply them (a pair at 0.7 meets in 1.1 of these, in 18 of 30 x 30 pairs of keys of 6).
So a link is lost only if its pair shares no table of a level. For another threshold than 0.85 the number of keys
follows, so that a pair at the threshold is missed as rarely (at 0.8: 14 x 14 tables and 173).

Before a pair's full sets are brought together, sizes must allow the threshold (exact), and sketches must not rule
it out: each sketch keeps the smallest shingle of each of 256 ranges, and a pair is dropped if the share of ranges
that agree lies six standard deviations below the threshold (a link does so with probability of about 1e-9).

Defined cases: texts without words have empty sets and link with nothing; null ids are never linked, have no component
and are kept; rows that repeat an id are one node with the links of all its texts; empty tables give empty
results; other columns are ignored by ``near_duplicates`` and kept by ``without_duplicates``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.functions.ordered import placed
from cartlake.llm.columns import map_batches, need, utf8
from cartlake.llm.components import components
from cartlake.llm.staging import small_batches, staged
from cartlake.llm.words import mix, shingle_sets

FIRST, SECOND = (3, 10), (12, 80)  # k and m at TUNED percent
TUNED = 85
RANGES = 256
SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, left array<long>, right array<long>, sketch binary"


def _level(km: tuple[int, int], percent: int) -> tuple[int, int]:
    """k, and as many keys as make a miss at ``percent`` as rare as the level's own are at TUNED."""
    k, m = km
    return k, m if percent == TUNED else math.ceil(m * math.log1p(-((TUNED / 100) ** k)) / math.log1p(-((min(percent, 99) / 100) ** k)))


def _minhashes(values: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of the set under each of ``count`` random multiply-add maps."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    terms = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    return np.min([(factors[:, None] * values[at : at + 4096] + terms[:, None]).min(axis=1) for at in range(0, len(values), 4096)], axis=0)


def _digest(values: np.ndarray) -> list[int]:
    """128 bits of a cryptographic digest of a sorted set, as two numbers: equal for equal sets only."""
    return np.frombuffer(hashlib.blake2b(values, digest_size=16).digest(), np.int64).tolist()


def _keys(hashes: np.ndarray, k: int) -> np.ndarray:
    groups = hashes.reshape(-1, k)
    total = np.arange(len(groups), dtype=np.uint64)
    for j in range(k):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + groups[:, j])
    return total.view(np.int64)


def _sketch(values: np.ndarray) -> bytes:
    """For each of the ranges of hashes one byte of the smallest shingle in it; 0 where there is none."""
    out = np.zeros(RANGES, np.uint8)
    ranges = values >> np.uint64(56)
    first = np.flatnonzero(np.diff(ranges, prepend=~ranges[:1]))
    out[ranges[first].astype(np.int64)] = values[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def signatures(docs: DataFrame, k: int, m: int, *, paired: bool = True) -> DataFrame:
    """Set size, two set fingerprints, the two collections of keys (or one, if not paired) and a short sketch of each text."""

    def work(batch: pa.RecordBatch):
        out: dict[str, list] = {f.split()[0]: [] for f in SIGNATURES.split(", ")}
        for doc, values in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
            if len(values):
                hashes = _minhashes(values, (1 + paired) * k * m)
                row = (doc, len(values), *_digest(values), _keys(hashes[: k * m], k), _keys(hashes[k * m :], k) if paired else [0], _sketch(values))
            else:
                row = (doc, 0, 0, 0, None, None, None)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield out

    return map_batches(need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), utf8()), work, SIGNATURES)


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, first, node``: members of all table buckets of two or more classes, with the smallest of each."""
    keys = classes.select("node", "right", F.posexplode("left").alias("i", "a")).select("node", F.explode(F.transform("right", lambda b, j: F.xxhash64("i", j, "a", b))).alias("key"))
    # Minima are pre-aggregated; a hot key's members are then joined to one row, which Spark may split.
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last")
    return staged(keys.join(shared, "key").select("key", "first", "node"), "buckets")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches do not rule the link out."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def work(batch: pa.RecordBatch):
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, RANGES) for i in (2, 3))
        held, same = ((a > 0) | (b > 0)).sum(axis=1), ((a > 0) & (a == b)).sum(axis=1)
        share = percent / 100
        yield batch.select([0, 1]).filter(pa.array(same >= held * share - 6 * np.sqrt(held * share * (1 - share))))

    return map_batches(sized.select("a", "b", "s_a", "s_b"), work, "a long, b long")


def _sets(texts: DataFrame) -> DataFrame:
    """``node, values``: the full sets of (node, utf8) rows."""

    def work(batch: pa.RecordBatch):
        yield {"node": batch.column(0), "values": [v.view(np.int64) for v in shingle_sets(batch.column(1).to_pylist())]}

    return map_batches(texts.select("node", "utf8"), work, "node long, values array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links by their full sets. ``pairs`` must be a stored table."""

    nodes = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), utf8().alias("utf8")).join(nodes, "node", "left_semi")
    values = staged(_sets(texts), "sets")
    first = pairs.join(values.withColumnRenamed("node", "b").withColumnRenamed("values", "v_b"), "b")
    joined = first.join(values.withColumnRenamed("node", "a").withColumnRenamed("values", "v_a"), "a")
    both = F.size(F.array_intersect("v_a", "v_b"))
    return staged(joined.where(100 * both >= percent * (F.size("v_a") + F.size("v_b") - both)).select("a", "b"), "confirmed")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct pairs of nodes that are not yet in one component."""
    for name in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}")), name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))
    return pairs.where("c_a <> c_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _strays(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """``key, node, c_node, c_first``: the members of buckets that hold several components, with their own and the first one's."""
    marked = buckets
    for name in ("node", "first"):
        marked = marked.join(found.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}")), name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))
    mixed = marked.where("c_node <> c_first").select("key").distinct()
    return staged(marked.join(mixed, "key", "left_semi").select("key", "node", "c_node", "c_first"), "strays")


def _stray_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Strays with members of other components, each pair once: in the first of the buckets that both are in.

    ``common`` is the most that a set can share with another; ``keys`` are all buckets of the member, at most one a table.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("key", F.col("node").alias(name), F.col("c_node").alias(f"c_{name}"), F.col("n").alias(f"n_{name}"), F.col("common").alias(f"m_{name}"), F.col("keys").alias(f"k_{name}"), (F.col("c_node") != F.col("c_first")).alias(f"o_{name}"))

    most = F.least("m_a", "m_b")
    possible = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    once = ~F.col("o_a") | (F.col("a") < F.col("b"))
    odd = side(members.where("c_node <> c_first"), "b")
    pairs = side(members, "a").join(odd, "key").where((F.col("c_a") != F.col("c_b")) & once & possible & (F.col("key") == F.array_min(F.array_intersect("k_a", "k_b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sharing(sets: DataFrame) -> DataFrame:
    """``node, n, common``: set sizes, and how many of a set's shingles another of these sets may hold too."""
    once = sets.select("node", F.explode("values").alias("v")).groupBy("v").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = once.groupBy("node").agg(F.count("*").alias("own"))
    return sets.select("node", F.size("values").cast("long").alias("n")).join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def near_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; 100 * intersection >= percent * union links two sets."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, percent)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    docs = need(docs, "doc_id", "text")
    signed = staged(signatures(docs, *_level(FIRST, percent)), "signatures")
    # Classes of equal sets, named by their smallest id; ids with several texts tie their classes together.
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = staged(named.groupBy("n_shingles", "set_a", "set_b").agg(F.min_by(F.struct("left", "right", "sketch"), "doc_id").alias("keys"), F.min("doc_id").alias("node")).select("node", "n_shingles", "set_a", "set_b", "keys.left", "keys.right", "keys.sketch"), "classes")
    member = staged(named.select("doc_id", "n_shingles", "set_a", "set_b").join(classes.select("n_shingles", "set_a", "set_b", "node"), ["n_shingles", "set_a", "set_b"]).select("doc_id", "node"), "members")
    tied = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b < c")
    ties = member.join(tied.select("doc_id", "b"), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")

    def confirm(pairs: DataFrame) -> DataFrame:
        return _confirmed(staged(_plausible(pairs, classes, percent), "pairs"), docs, percent)

    def joined_up(found: DataFrame, links: DataFrame) -> DataFrame:
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    buckets = _buckets(classes)
    # First each member with the one leader it shares most tables with, then what still lies across components.
    stars = staged(buckets.where("first <> node").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n")), "candidates")
    found = components(ties.unionByName(confirm(stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))))
    found = joined_up(found, confirm(_across(stars.select("a", "b"), found)))
    crowded = staged(_strays(buckets, found).select("node").distinct(), "crowded")
    if crowded.take(1):
        mixed = classes.join(crowded, "node", "left_semi")
        chosen = docs.join(crowded, docs["doc_id"] == crowded["node"], "left_semi")
        again = signatures(chosen, *_level(SECOND, percent), paired=False).select(F.col("doc_id").alias("node"), "set_a", "set_b", "left", "right")
        finer = mixed.drop("left", "right").join(again, ["node", "set_a", "set_b"]).dropDuplicates(["node", "set_a", "set_b"])
        again_buckets = _buckets(finer)
        sharing = _sharing(staged(_sets(chosen.select(F.col("doc_id").cast("long").alias("node"), utf8().alias("utf8"))), "crowded_sets"))
        strays = _strays(again_buckets, found)
        members = strays.join(sharing, "node").join(strays.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
        found = joined_up(found, confirm(_across(_stray_pairs(members, percent), found)))

    result = signed.select("doc_id", "n_shingles").join(member.distinct().groupBy("doc_id").agg(F.min("node").alias("node")), "doc_id", "left")
    result = result.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """The rows, with all their columns, of the smallest id of each component; rows without an id stay.

    Where ids repeat, rows are told apart by a number of their own, in the order of (id, hash of the text), so that unlike
    texts of one id are judged each for itself and all of them can stay.
    """
    ids = need(docs, "doc_id").where("doc_id is not null").groupBy("doc_id").count()
    if not ids.where("count > 1").take(1):
        gone = staged(near_duplicates(docs, percent=percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "near")
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("`doc_id`").alias("key_id"), F.col("`text`").alias("key_text"))
    rows = rows.withColumns({"key_hash": F.xxhash64("key_text"), "row": F.monotonically_increasing_id()})
    numbered = staged(placed(rows, ["key_id", "key_hash", "row"], keep=["doc", "key_id", "key_text"]), "numbered")
    number = F.when(F.col("key_id").isNotNull(), F.col("place"))
    gone = staged(near_duplicates(numbered.select(number.alias("doc_id"), F.col("key_text").alias("text")), percent=percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "near")
    return numbered.withColumn("number", number).join(gone, F.col("number") == F.col("gone_id"), "left_anti").select("doc.*")
