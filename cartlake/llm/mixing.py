"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame and SQL functions only.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; no source gives more
than ``max_epochs`` times its words, and what is cut off is shared again by weight.

Draw: a source's documents are dealt by hash into blocks of about ``block_words`` words, and its blocks are put in
a random order. The mix takes every block of a source as often as its target holds the source whole, then blocks in that
order while they fit. The next block gives documents: half of the rest in random order, then larger ones first wherever
they fit, from the largest size on that leaves least, and then up to six changes of one document, put in, left out or
one for another, each of which comes nearest to what is left.
So each source has an exact quota of block draws. A binary tree splits the vector of quotas among the output
shards: each node gives its left child a multivariate hypergeometric draw of half its blocks. A shard's counts
are turned into disjoint ranges of each source's permuted draws, and within a shard rows are in hash order.

Nothing here holds a source, or all sources' documents, in one task: documents only meet their own block's row;
running sums go over slices of a source's blocks and over the documents of one block. The tables of sources and
of shards are small: a row for each source, and for each shard and source.

Defined cases: null text has size 0 and takes 0; sources may be null; all-empty sources have target 0; repeated rows
are separate rows that share a fate; equal hashes are ties that share a running sum; null ids take part; an empty
table gives an empty result; other columns of any name travel along unread.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlake.llm.columns import need
from cartlake.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text"):
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{column}`"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``source, source_size`` with rank, weight and target added.

    The targets are min(cap, level * weight) for one level: with sources by cap / weight, the level is the first
    share of what is left, by weight, that does not exceed its source's own ratio.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("share", left / heavy)
    level = F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "source_rank", "share"))).over(everything)["share"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", "source_rank", "weight", target.alias("target"))


def _ln_factorial(x: str) -> str:
    exact = ", ".join(repr(math.lgamma(i + 1)) for i in range(16))
    return f"(if({x} < 16, element_at(array({exact}), cast({x} as int) + 1), ({x} + 0.5D) * ln({x}) - {x} + 0.91893853320467274D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}))) "


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(f'({n})')} - {_ln_factorial(f'({k})')} - {_ln_factorial(f'({n} - {k})')})"


def hypergeometric(good: str, total: str, draws: str, uniform: str) -> str:
    """SQL for a hypergeometric number by inversion, from the mode outwards in both directions.

    ``draws`` of ``total`` units are taken, ``good`` of which count; ``uniform`` is in [0, 1). The walk is some
    deviations long, so its work grows with the square root of the counts.
    """
    params = f"named_struct('g', cast({good} as double), 't', cast({total} as double), 'd', cast({draws} as double), 'u', cast({uniform} as double))"
    bounds = "transform(array(p), p -> named_struct('g', p.g, 't', p.t, 'd', p.d, 'u', p.u, 'lo', greatest(0D, p.d + p.g - p.t), 'hi', least(p.g, p.d), 'm', greatest(greatest(0D, p.d + p.g - p.t), least(least(p.g, p.d), floor((p.d + 1) * (p.g + 1) / (p.t + 2))))))[0]"
    start = f"exp({_ln_choose('p.g', 'p.m')} + {_ln_choose('(p.t - p.g)', '(p.d - p.m)')} - {_ln_choose('p.t', 'p.d')})"
    first = f"transform(array({start}), q -> named_struct('u', p.u - q, 'a', p.m, 'pa', q, 'b', p.m, 'pb', q, 'x', if(p.u < q, p.m, cast(null as double))))[0]"
    steps = "sequence(0, cast(least(p.hi - p.lo, 40D + 24D * sqrt(greatest(0D, p.d * p.g / greatest(p.t, 1D) * (1 - p.g / greatest(p.t, 1D))))) as int))"
    up = "if(s.b < p.hi, s.pb * (p.g - s.b) * (p.d - s.b) / ((s.b + 1) * (p.t - p.g - p.d + s.b + 1)), 0D)"
    down = "if(s.a > p.lo, s.pa * s.a * (p.t - p.g - p.d + s.a) / ((p.g - s.a + 1) * (p.d - s.a + 1)), 0D)"
    step = f"transform(array(named_struct('up', {up}, 'down', {down})), v -> named_struct('u', s.u - v.up - v.down, 'a', greatest(p.lo, s.a - 1), 'pa', v.down, 'b', least(p.hi, s.b + 1), 'pb', v.up, 'x', coalesce(s.x, if(s.u < v.up, s.b + 1, null), if(s.u < v.up + v.down, s.a - 1, null))))[0]"
    walk = f"aggregate({steps}, {first}, (s, i) -> if(s.x is not null, s, {step}), s -> cast(coalesce(s.x, p.m) as bigint))"
    return f"transform(array({params}), p -> transform(array({bounds}), p -> {walk})[0])[0]"


def split_quotas(quotas: DataFrame, levels: int, *, seed: int) -> DataFrame:
    """``node, counts``: the tree's leaves, from one row ``node, quotas`` (an array with an entry for each source)."""
    tree = quotas.select(F.col("node"), F.col("quotas"))
    for level in range(levels):
        uniform = f"shiftright(xxhash64({seed}, {level}, node, e.i), 12) / {float(1 << 52)}D + 0.5D"
        draw = hypergeometric("e.q", "acc.total", "acc.draws", uniform)
        fold = f"""aggregate(transform(quotas, (q, i) -> named_struct('q', q, 'i', i)),
            named_struct('total', aggregate(quotas, 0L, (a, q) -> a + q), 'draws', aggregate(quotas, 0L, (a, q) -> a + q) div 2, 'out', cast(array() as array<bigint>)),
            (acc, e) -> transform(array({draw}),
                x -> named_struct('total', acc.total - e.q, 'draws', acc.draws - x, 'out', array_append(acc.out, x)))[0],
            acc -> acc.out)"""
        tree = tree.withColumn("lefts", F.expr(fold)).selectExpr("node", "posexplode(array(lefts, zip_with(quotas, lefts, (q, x) -> q - x))) as (side, quotas)")
        tree = tree.selectExpr("node * 2 + side as node", "quotas")
        if level in (4, 8):
            tree = tree.repartition(1 << level, "node")
    return tree.select(F.col("node").alias("shard"), F.col("quotas").alias("counts"))


def mix_plan(sized: DataFrame, *, block_words: int, shard_blocks: int, seed: int, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Sources with targets, and one row for each block: how its documents are taken.

    ``sized`` (source, size, row_key) must be a stored table. The second table has source_rank, n_blocks, block, rest (the words to take from a
    block that is taken in part, else null) and draws, an array of (epoch, shard, whole).
    """
    sources = staged(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, max_epochs=max_epochs), "sources")
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)))
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    wanted = sources.select("source", "source_rank", "source_size", "target", "n_blocks", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))
    blocks = with_block(sized, wanted.select("source", "source_rank", "n_blocks"), seed).groupBy("source_rank", "block").agg(F.sum("size").alias("words"))
    n_slices = max(1, (blocks.count() // 20_000) + 1) if sized.take(1) else 1
    mixed = F.xxhash64(F.lit(seed + 1), "source_rank", "block")
    blocks = staged(blocks.withColumn("turn", mixed).withColumn("slice", F.pmod(F.shiftright("turn", 8), F.lit(n_slices))), "blocks")
    # Running sums in two steps: over a source's slices, then over a slice's blocks.
    earlier = Window.partitionBy("source_rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = blocks.groupBy("source_rank", "slice").agg(F.sum("words").alias("slice_words"), F.count("*").alias("slice_blocks"))
    slices = slices.select("source_rank", "slice", F.coalesce(F.sum("slice_words").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("slice_blocks").over(earlier), F.lit(0)).alias("blocks_before"))
    within = Window.partitionBy("source_rank", "slice").orderBy("turn", "block")
    numbered = blocks.join(slices, ["source_rank", "slice"]).join(wanted.drop("source", "source_size"), "source_rank")
    numbered = numbered.withColumn("place", F.col("blocks_before") + F.row_number().over(within) - 1)
    numbered = numbered.withColumn("start", F.col("words_before") + F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    numbered = numbered.withColumn("part", F.when(F.col("start") + F.col("words") <= F.col("rest"), 2).when(F.col("start") < F.col("rest"), 1).otherwise(0))
    numbered = staged(numbered.select("source_rank", "block", "n_blocks", "place", "epochs", "part", (F.col("rest") - F.col("start")).alias("rest")), "numbered")
    # Exact quotas of draws, split among the shards.
    quotas = numbered.groupBy("source_rank").agg(F.sum(F.col("epochs") + (F.col("part") > 0).cast("long")).alias("quota"), F.count("*").alias("held"))
    root = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_rank", "quota"))).alias("q"), F.sum("quota").alias("total"))
    total = (root.first() or {"total": 0})["total"] or 0
    levels = max(0, math.ceil(math.log2(max(1, total / shard_blocks))))
    leaves = split_quotas(root.select(F.lit(0).cast("long").alias("node"), F.transform("q", lambda q: q["quota"]).alias("quotas")), levels, seed=seed)
    order = root.select(F.transform("q", lambda q: q["source_rank"]).alias("ranks"))
    leaves = leaves.crossJoin(F.broadcast(order)).select("shard", F.inline(F.arrays_zip("ranks", "counts")))  # one row, with an entry for each source
    upto = Window.partitionBy("ranks").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("first", F.coalesce(F.sum("counts").over(upto), F.lit(0))).where("counts > 0")
    seats = leaves.select(F.col("ranks").alias("source_rank"), "shard", F.explode(F.expr("sequence(first, first + counts - 1)")).alias("seat"))
    # A source's draws are seated epoch after epoch in the permuted order.
    draws = numbered.join(quotas.select("source_rank", "held"), "source_rank")
    draws = draws.select("source_rank", "block", "held", "place", "epochs", F.explode(F.expr("sequence(0, epochs - if(part > 0, 0, 1))")).alias("epoch"), "part").where("epoch < epochs or part > 0")
    draws = draws.select("source_rank", "block", "epoch", (F.col("epoch") * F.col("held") + F.col("place")).alias("seat"), ((F.col("epoch") < F.col("epochs")) | (F.col("part") == 2)).alias("whole"))
    seated = draws.join(seats, ["source_rank", "seat"]).groupBy("source_rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "whole"))).alias("draws"))
    plan = numbered.select("source_rank", "block", "n_blocks", F.when(F.col("part") == 1, F.col("rest")).alias("rest")).join(seated, ["source_rank", "block"])
    return sources, staged(plan, "plan")


def with_block(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows (source, row_key, ...) with their source's columns and their block."""
    joined = rows.join(sources.withColumnRenamed("source", "same_source"), F.col("source").eqNullSafe(F.col("same_source"))).drop("same_source")
    return joined.withColumn("block", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.col("n_blocks")))


_KEPT = "least(s.n - s.begun, greatest(0L, acc.left div s.size))"
_FIRST = f"""array_min(transform(sequence(1, size(sizes)), start -> aggregate(sizes, named_struct('left', gap, 'out', cast(array() as array<struct<size: bigint, n: bigint, begun: bigint, most: bigint>>), 'at', 1),
    (acc, s) -> named_struct('left', acc.left - if(acc.at < start, 0, {_KEPT}) * s.size, 'out', array_append(acc.out, named_struct('size', s.size, 'n', s.n, 'begun', s.begun, 'most', s.begun + if(acc.at < start, 0, {_KEPT}))), 'at', acc.at + 1))))"""
_NONE = "named_struct('size', 0L, 'n', 0L, 'begun', 0L, 'most', 0L)"
_SWAP = f"""array_min(flatten(transform(array_append(filter(f.out, x -> x.most < x.n), {_NONE}), b -> transform(array_append(filter(f.out, x -> x.most > 0), {_NONE}),
    a -> named_struct('miss', abs(f.left - b.size + a.size), 'more', b.size, 'less', a.size)))))"""
_SWAPPED = f"""transform(array({_SWAP}), w -> named_struct('left', f.left - w.more + w.less, 'out', transform(f.out, x -> named_struct('size', x.size, 'n', x.n, 'begun', x.begun, 'most', x.most + if(x.size = w.more, 1L, 0L) - if(x.size = w.less, 1L, 0L))), 'at', f.at))[0]"""
#: How many documents of each size a block gives: sizes (size, n, and how many are taken already), largest first, and what is
#: left (``gap``), to left and out (size, n, begun, most).
FILL = f"aggregate(sequence(1, 6), {_FIRST}, (f, i) -> {_SWAPPED})"


def mix(docs: DataFrame, *, keep: list[str] | None = None, block_words: int = 1 << 14, shard_blocks: int = 256, seed: int = 11) -> DataFrame:
    """Each input row as ``doc`` (a struct of all its columns, or of ``keep``; only these travel) with source_size, target, size and draws (epoch, shard): the times it is taken."""
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("doc"), F.col("`doc_id`").alias("key_id"), F.col("`text`").alias("key_text"), F.col("`source`").alias("source"))
    rows = named.select("doc", "source", word_count("key_text").alias("size"), F.xxhash64(F.lit(seed), "key_id", "key_text").alias("row_key"))
    sized = staged(rows.select("source", "size", "row_key"), "sized")
    sources, plan = mix_plan(sized, block_words=block_words, shard_blocks=shard_blocks, seed=seed)
    dealt = with_block(rows, sources.select("source", "source_rank", "source_size", "target", "n_blocks"), seed)
    # In a block that is taken in part, documents go in hash order for half of what is to be taken.
    partial = plan.where("rest is not null").select("source_rank", "block", "rest")
    inside = with_block(sized, sources.select("source", "source_rank", "n_blocks"), seed).join(partial, ["source_rank", "block"])
    inside = inside.groupBy("source_rank", "block", "rest", "row_key").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source_rank", "block").orderBy("row_key"))
    inside = staged(inside.withColumn("fits", upto <= F.col("rest") / 2), "partial")
    last = inside.groupBy("source_rank", "block").agg(F.max(F.when(F.col("fits"), F.col("row_key"))).alias("last_key"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("used"))
    # Then larger ones first, as many of each size as fit; of the sizes to start from, the one that leaves least. Then, a few
    # times, the change of one document (put in, left out, or one for another) that comes nearest to what is to be taken.
    # A block has few distinct sizes, so folds over them decide.
    block = ["source_rank", "block"]
    some = inside.where("size > 0").join(last, block).withColumn("gap", F.floor(F.col("rest") - F.col("used") + 0.5).cast("long"))
    sizes = some.groupBy(*block, "size").agg(F.count("*").alias("n"), F.count(F.when(F.col("fits"), 1)).alias("begun"), F.max("gap").alias("gap"))
    sizes = sizes.groupBy(*block).agg(F.max("gap").alias("gap"), F.reverse(F.sort_array(F.collect_list(F.struct("size", "n", "begun")))).alias("sizes"))
    fill = staged(sizes.select(*block, F.expr(FILL).alias("fill")), "fill").select(*block, F.inline("fill.out")).select(*block, "size", "begun", "most")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*block, "size").orderBy(F.desc("fits"), "row_key"))).join(fill, [*block, "size"])
    chosen = F.col("rank") <= F.col("most")
    more = ranked.groupBy(*block).agg(F.collect_set(F.when(chosen & ~F.col("fits"), F.col("row_key"))).alias("filled_keys"), F.collect_set(F.when(~chosen & F.col("fits"), F.col("row_key"))).alias("dropped_keys"))
    last = last.join(more, block, "left").drop("used")
    decided = plan.drop("n_blocks", "rest").join(staged(last, "last"), ["source_rank", "block"], "left")
    taken = F.filter("draws", lambda d: d["whole"] | F.coalesce((F.col("row_key") <= F.col("last_key")) & ~F.coalesce(F.array_contains("dropped_keys", F.col("row_key")), F.lit(False)), F.lit(False)) | F.coalesce(F.array_contains("filled_keys", F.col("row_key")), F.lit(False)))
    return dealt.join(decided, ["source_rank", "block"], "left").select("doc", "row_key", "size", "source_size", "target", F.coalesce(F.transform(taken, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"))), F.expr("cast(array() as array<struct<epoch: bigint, shard: bigint>>)")).alias("draws"))


def mixed_rows(docs: DataFrame, **options: int) -> DataFrame:
    """The mix itself: input rows with their columns, as often as taken, shard by shard in hash order."""
    taken = mix(docs, **options).select("doc", "row_key", F.explode("draws").alias("draw"))
    shards = taken.repartition("draw.shard").sortWithinPartitions("draw.shard", F.xxhash64("row_key", "draw.epoch"))
    return shards.select("doc.*")


def mix_report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and shards (``epoch:shard`` of each copy) of each row."""
    mixed = mix(need(docs, "doc_id", "text", "source"), keep=["doc_id"], **options)
    return mixed.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.size("draws").alias("copies"), F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"], d["shard"])), ",").alias("shards"))
