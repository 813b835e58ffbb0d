"""Hard negatives by an exact search for score windows in a multiway hyperplane tree (GNAT).

Vectors become integers, floor(scale * x); the score of two is their inner product. One more component, the root of
(longest squared norm - own squared norm), gives all rows one norm, so a row's distance to an anchor (with 0 there) follows
from its score alone, and a window of scores is an annulus of distances around the anchor.

Tree: each node has up to ``ARITY`` split points, picked far apart from a bounded sample (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` bytes at most); a row goes to the nearest, at each level, so every row is in a leaf. Each split point
stores, for each sibling's subtree, the range of its distances to that subtree's rows, taken over all rows. A search
drops a sibling if for any split point the range and the anchor's annulus, moved by the anchor's distance to that point,
do not meet. What remains is scored exactly, so recall is 1.

Levels follow the number of rows (one at least, another where leaves would still hold ``LEAF_ROWS`` on average), up to
three: at most 16^3 leaves, 70,000 ranges and 4,369 split points, which is what tasks get. Leaves are stored in blocks of about ``BLOCK_ROWS`` rows dealt by row, so a group of equal
vectors is many blocks; anchors travel in blocks of their leaf. A block of anchors meets each block of rows whose leaf
it may not drop: the pairs of blocks are the key, and neither side is more than one block for it.
A search runs twice: over the anchors' own leaves, whose k-th best score narrows each window, then over all that is left.

Defined cases: rows with a null id, label or vector, or any null or non-finite component, take no part; shorter vectors
count as padded with zeros (an empty vector scores 0); rows are told apart also where ids repeat: a repeated anchor is
an anchor again and each other's candidate; ties go to the smaller vec_id; fewer rows than asked give what there is;
windows of a negative positive_score are empty; an empty table gives an empty result; other columns are ignored.
Scores must fit 64 bits: beyond 2^53 they are summed as whole Python numbers, beyond 2^63 the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlake.llm.columns import map_batches, need
from cartlake.llm.staging import staged

ARITY, LEAF_ROWS, BLOCK_ROWS, ANCHOR_ROWS = 16, 4096, 4096, 256
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
EXACT = float(1 << 53)


def prepared(embeddings: DataFrame, *, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """row_id, vec_id, label, norm (squared), vec (float64 components, whole numbers) of the rows that take part; stored."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = need(embeddings, "vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null").where(~bad)
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))

    def work(batch: pa.RecordBatch):
        lists = batch.column(3)
        vectors = [np.floor(x * scale) for x in arrays(lists)]
        yield {"row_id": batch.column(0), "vec_id": batch.column(1), "label": batch.column(2), "norm": [float(v @ v) for v in vectors], "vec": [v.tobytes() for v in vectors]}

    return staged(map_batches(rows, work, "row_id long, vec_id long, label long, norm double, vec binary"), "vectors")


def arrays(lists: pa.Array) -> list[np.ndarray]:
    """Each list of a column as numbers."""
    return [x.values.to_numpy(zero_copy_only=False) for x in lists]


def stacked(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to ``width``."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), width)
    return np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in vectors), np.float64).reshape(len(vectors), width)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as whole numbers: exact in doubles where no partial sum can pass 2^53, else in Python's numbers."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) @ whole(b).T).astype(np.int64)


@dataclass
class Tree:
    """Split points of each inner node, children (a node, or -1 - leaf), ranges of distances, and the common squared norm."""

    width: int
    top: float
    points: list[np.ndarray] = field(default_factory=list)  # with the extra component
    children: list[list[int]] = field(default_factory=list)
    ranges: list[np.ndarray] = field(default_factory=list)  # [split point, child, (least, most)]
    leaves: int = 0

    def lifted(self, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.column_stack([rows, np.sqrt(np.maximum(0.0, self.top - norms))])

    def grow(self, rows: np.ndarray, levels: int) -> int:
        """A subtree over sample rows; returns its number as a child."""
        points = far_apart(rows) if levels and len(rows) else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(points), self.children.append([]), self.ranges.append(np.empty(0))
        nearest = distances(rows, points).argmin(axis=1)
        self.children[node] = [self.grow(rows[nearest == j], levels - 1) for j in range(len(points))]
        self.ranges[node] = np.stack([np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)], axis=-1)
        return node

    def descend(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, places of its rows, their distances to its split points, the child of each) for every inner node that rows reach."""
        open_ = [(0, np.arange(len(rows)))] if self.points else []
        while open_:
            node, at = open_.pop()
            far = distances(rows[at], self.points[node])
            child = far.argmin(axis=1)
            yield node, at, far, child
            for j, below in enumerate(self.children[node]):
                if below >= 0 and (child == j).any():
                    open_.append((below, at[child == j]))

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(rows), np.int64)
        for node, at, _, child in self.descend(rows):
            leaf[at] = -1 - np.asarray(self.children[node])[child]
        return leaf

    def reachable(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[int]:
        """Leaves that some anchor's annulus (least and most distance, a pair an anchor) may meet."""
        slack = 1e-6 * (1 + np.sqrt(self.top))
        found, open_ = [], [(0, np.flatnonzero(low <= high))] if self.points else []
        if not self.points:
            return [0] if (low <= high).any() else []
        while open_:
            node, at = open_.pop()
            far = distances(anchors[at], self.points[node])[:, :, None]
            near, most = self.ranges[node][None, :, :, 0], self.ranges[node][None, :, :, 1]
            least = np.maximum(np.maximum(far - most, near - far), 0.0)  # of the distance to a child's rows
            meets = ((least <= high[at, None, None] + slack) & (far + most >= low[at, None, None] - slack)).all(axis=1)
            for j, below in enumerate(self.children[node]):
                if meets[:, j].any():
                    found.append(-1 - below) if below < 0 else open_.append((below, at[meets[:, j]]))
        return found


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (rows @ points.T)
    return np.sqrt(np.maximum(square, 0.0))


def far_apart(rows: np.ndarray, arity: int = ARITY) -> np.ndarray:
    """Up to ``arity`` different rows, each the farthest from those before it among three times as many candidates."""
    seen = rows[np.linspace(0, len(rows) - 1, min(len(rows), 3 * arity)).astype(int)]
    picked = [seen[0]]
    gap = distances(seen, seen[:1])[:, 0]
    while len(picked) < arity and gap.max() > 1e-6 * (1 + np.abs(seen).max()):
        picked.append(seen[int(gap.argmax())])
        gap = np.minimum(gap, distances(seen, picked[-1][None])[:, 0])
    return np.asarray(picked)


def fit(rows: DataFrame, *, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over ``rows``: split points from the sample (rows with the smallest hashes), ranges from all rows."""
    n, top, size = rows.agg(F.count("*"), F.max("norm"), F.max(F.octet_length("vec"))).first()
    if not n:
        return Tree(0, 0.0)
    tree = Tree(size // 8, top)
    sample = min(SAMPLE_ROWS, max(ARITY, SAMPLE_BYTES // max(8, size)))
    picked = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(sample).select("vec", "norm").toPandas()
    levels = int(np.clip(np.log(max(1, n / leaf_rows)) // np.log(ARITY), 1, 3))
    tree.grow(tree.lifted(stacked(list(picked["vec"]), tree.width), picked["norm"].to_numpy()), levels)
    if not tree.points:
        tree.leaves = 1
        return tree
    known = rows.sparkSession.sparkContext.broadcast(tree)

    def measure(batch: pa.RecordBatch):
        tree = known.value
        out: dict[str, list] = {c: [] for c in ("node", "point", "child", "least", "most")}
        for node, _, far, child in tree.descend(tree.lifted(stacked(batch.column(0).to_pylist(), tree.width), batch.column(1).to_numpy())):
            for j in np.unique(child):
                mine = far[child == j]
                for name, values in zip(out, ([node] * far.shape[1], range(far.shape[1]), [j] * far.shape[1], mine.min(axis=0), mine.max(axis=0)), strict=True):
                    out[name] += list(values)
        yield out

    measured = map_batches(rows.select("vec", "norm"), measure, "node int, point int, child int, least double, most double")
    for r in measured.groupBy("node", "point", "child").agg(F.min("least").alias("least"), F.max("most").alias("most")).toLocalIterator():
        tree.ranges[r.node][r.point, r.child] = r.least, r.most
    return tree


def in_blocks(rows: DataFrame, tree: Tree, *, block_rows: int = BLOCK_ROWS, name: str = "blocks") -> DataFrame:
    """``rows`` as stored blocks (leaf, block, and arrays row_ids, vec_ids, labels, and the joined vectors), with each leaf's number of blocks."""
    known = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batch: pa.RecordBatch):
        tree = known.value
        leaf = tree.leaf_of(tree.lifted(stacked(batch.column(4).to_pylist(), tree.width), batch.column(3).to_numpy()))
        yield {"leaf": leaf} | {c: batch.column(i) for i, c in enumerate(("row_id", "vec_id", "label", "norm", "vec"))}

    put = staged(map_batches(rows.select("row_id", "vec_id", "label", "norm", "vec"), place, "leaf long, row_id long, vec_id long, label long, norm double, vec binary"), "leaves")
    sizes = put.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("n_blocks"))  # one row a leaf
    dealt = put.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("row_id"), "n_blocks"))
    width = tree.width

    def pack(batch: pa.RecordBatch):
        vectors = [stacked(x, width).tobytes() for x in batch.column(6).to_pylist()]
        yield {c: batch.column(i) for i, c in enumerate(("leaf", "block", "row_ids", "vec_ids", "labels", "norms"))} | {"vectors": vectors}

    held = dealt.groupBy("leaf", "block").agg(F.sort_array(F.collect_list(F.struct("row_id", "vec_id", "label", "norm", "vec"))).alias("r"))
    held = held.select("leaf", "block", *(F.col(f"r.{c}").alias(f"{c}s") for c in ("row_id", "vec_id", "label", "norm", "vec")))
    packed = "leaf long, block long, row_ids array<long>, vec_ids array<long>, labels array<long>, norms array<double>, vectors binary"
    return staged(map_batches(held, pack, packed), name)


FOUND = "anchor long, window long, score long, vec_id long, row_id long"


def search(tree: Tree, blocks: DataFrame, anchors: DataFrame, windows: DataFrame, *, k: int, same: bool) -> DataFrame:
    """The first k rows of each window: anchor (row_id), window, rank, score, vec_id, row_id.

    ``anchors`` are blocks too; ``windows`` has anchor, window, low, high, the least and the most score (null: open) of rows
    with the anchor's label (``same``) or another one.
    """
    near = _visit(tree, blocks, anchors, windows, k, same, own=True)
    kth = near.where(F.col("rank") == k).select("anchor", "window", F.col("score").alias("kth"))
    narrow = staged(windows.join(kth, ["anchor", "window"], "left").select("anchor", "window", F.greatest("low", "kth").alias("low"), "high"), "windows")
    return _visit(tree, blocks, anchors, narrow, k, same, own=False)


def _visit(tree: Tree, blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, *, own: bool) -> DataFrame:
    known, width = blocks.sparkSession.sparkContext.broadcast(tree), tree.width
    mine = anchors.select("leaf", "block", F.explode("row_ids").alias("anchor"))
    asked = windows.join(mine, "anchor").groupBy("leaf", "block").agg(F.sort_array(F.collect_list(F.struct("anchor", "window", "low", "high"))).alias("asked"))
    asked = anchors.join(asked, ["leaf", "block"])

    def plan(batch: pa.RecordBatch):
        """Leaves that a block of anchors must visit."""
        tree, visits = known.value, []
        for ids, norms, vectors, wanted in zip(arrays(batch.column(2)), arrays(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            at = {r: i for i, r in enumerate(ids.tolist())}
            who = np.asarray([at[w["anchor"]] for w in wanted])
            low = np.asarray([-np.inf if w["low"] is None else float(w["low"]) for w in wanted])
            high = np.asarray([np.inf if w["high"] is None else float(w["high"]) for w in wanted])
            rows = np.frombuffer(vectors, np.float64).reshape(len(ids), width)
            rows = np.column_stack([rows, np.zeros(len(rows))])  # anchors have no extra component
            whole = norms[who] + tree.top
            visits.append(tree.reachable(rows[who], np.sqrt(np.maximum(0, whole - 2 * high)), np.sqrt(np.maximum(0, whole - 2 * low))))
        yield {"leaf": batch.column(0), "block": batch.column(1), "visit": visits}

    if own:
        visits = asked.select("leaf", "block", F.col("leaf").alias("at"))
    else:
        visits = map_batches(asked.select("leaf", "block", "row_ids", "norms", "vectors", "asked"), plan, "leaf long, block long, visit array<long>").select("leaf", "block", F.explode("visit").alias("at"))
    counts = blocks.groupBy(F.col("leaf").alias("at")).agg(F.max("block").alias("last"))  # one row a leaf
    visits = visits.join(F.broadcast(counts), "at").select("leaf", "block", "at", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("at_block"))
    left = asked.select("leaf", "block", *(F.col(c).alias(f"a_{c}") for c in ("row_ids", "labels", "vectors")), "asked")
    right = blocks.select(F.col("leaf").alias("at"), F.col("block").alias("at_block"), "row_ids", "vec_ids", "labels", "vectors")
    pairs = visits.join(left, ["leaf", "block"]).join(right, ["at", "at_block"])

    def score(batch: pa.RecordBatch):
        out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
        columns = [arrays(c) if pa.types.is_list(c.type) and not pa.types.is_struct(c.type.value_type) else c.to_pylist() for c in batch.columns]
        for a_ids, a_labels, a_vec, wanted, ids, names, labels, vec in zip(*columns, strict=True):
            all_scores = scores(np.frombuffer(a_vec, np.float64).reshape(len(a_ids), width), np.frombuffer(vec, np.float64).reshape(len(ids), width))
            at = {r: i for i, r in enumerate(a_ids.tolist())}
            for w in wanted:
                i = at[w["anchor"]]
                row, fits = all_scores[i], ((labels == a_labels[i]) == same) & (ids != w["anchor"])
                if w["low"] is not None:
                    fits &= row >= w["low"]
                if w["high"] is not None:
                    fits &= row <= w["high"]
                fits = np.flatnonzero(fits)
                if len(fits) > k:  # all that tie with the k-th stay until ids decide
                    fits = fits[row[fits] >= np.partition(row[fits], len(fits) - k)[len(fits) - k]]
                fits = fits[np.lexsort((names[fits], -row[fits]))][:k]
                for name, value in zip(out, ([w["anchor"]] * len(fits), [w["window"]] * len(fits), row[fits], names[fits], ids[fits]), strict=True):
                    out[name] += list(value)
        yield out

    found = map_batches(pairs.select("a_row_ids", "a_labels", "a_vectors", "asked", "row_ids", "vec_ids", "labels", "vectors"), score, FOUND)
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row_id")
    return staged(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")


def hard_negatives(embeddings: DataFrame, *, anchors_every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (every so many ids) and each of its
    first rows of the same label, the first rows of other labels whose score is ``least`` to ``most`` percent of the positive's."""
    rows = prepared(embeddings)
    tree = fit(rows, leaf_rows=leaf_rows)
    blocks = in_blocks(rows, tree, block_rows=block_rows)
    anchors = in_blocks(rows.where(F.col("vec_id") % anchors_every == 0), tree, block_rows=ANCHOR_ROWS, name="anchors")
    names = anchors.select(F.explode(F.arrays_zip("row_ids", "vec_ids")).alias("a")).select(F.col("a.row_ids").alias("anchor"), F.col("a.vec_ids").alias("anchor_id"))
    null = F.lit(None).cast("long")
    found = search(tree, blocks, anchors, names.select("anchor", F.lit(0).cast("long").alias("window"), null.alias("low"), null.alias("high")), k=positives, same=True)
    liked = found.select("anchor", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    whole = F.col("positive_score").cast("decimal(38,0)")
    low, high = ((F.lit(least) * whole + 99) / 100, F.lit(most) * whole / 100)
    windows = liked.where("positive_score >= 0").select("anchor", "window", F.floor(low).cast("long").alias("low"), F.floor(high).cast("long").alias("high"))
    chosen = search(tree, blocks, anchors, windows, k=negatives, same=False)
    return chosen.join(liked, ["anchor", "window"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
