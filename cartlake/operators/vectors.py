"""Nearest vectors by cosine: all of them in a grid of blocks, or an inverted file of cells with exact re-ranking.

``vector_top_k`` compares a stated set of queries with every vector. Both sides are dealt into numbered blocks; a block of
vectors is one key of the join and meets every block of queries, so no key holds more than one block of vectors.

``build_index`` fits cell centres on a bounded sample (``SAMPLE_ROWS`` rows, those with the smallest hashes, and at most
``MOST_CELLS`` cells), puts every vector into the cell of its nearest centre, and stores each cell as blocks.
``search_index`` probes the cells nearest to a query and ranks what they hold exactly. ``choose_probes`` raises the number of
probes until a bounded sample of queries finds the wanted share of what the exact way finds.

Null, empty and zero vectors, vectors with a null component, and null ids take no part; vectors of different lengths are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlake.sources.staging import staged

SAMPLE_ROWS, MOST_CELLS = 20_000, 1024
FOUND = "query_id long, vec_id long, score double"


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, width and the vector at length one."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where("vec_id is not null and size(x) > 0 and not exists(x, v -> v is null)")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return rows.select("vec_id", F.size("x").alias("width"), "x", norm.alias("norm")).where("norm > 0").select("vec_id", "width", F.transform("x", lambda v: v / F.col("norm")).alias("unit"))


def _blocks(rows: DataFrame, keys: list[str], size: int, prefix: str) -> DataFrame:
    """Rows as numbered blocks of about ``size`` within the keys: keys, ``{prefix}block``, arrays of ids and units."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_n"))  # a row a key
    dealt = rows.join(F.broadcast(n), keys).withColumn("_block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("_n")))
    held = dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct("vec_id", "unit")).alias("r"))
    return held.select(*keys, F.col("_block").alias(f"{prefix}block"), F.col("r.vec_id").alias(f"{prefix}ids"), F.col("r.unit").alias(f"{prefix}units"))


def _score(pairs: DataFrame, k: int, min_score: float) -> DataFrame:
    """The k best of each query within each pair of blocks (width, q_ids, q_units, ids, units)."""

    def matrix(units: pa.Scalar, width: int) -> np.ndarray:
        return units.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, asked, q, ids, v in zip(*batch.columns, strict=True):
                asked, ids, width = asked.values.to_numpy(), ids.values.to_numpy(), width.as_py()
                scores = matrix(q, width) @ matrix(v, width).T
                out: list[tuple[int, int, float]] = []
                for i, own in enumerate(asked.tolist()):
                    at = np.flatnonzero((scores[i] >= min_score) & (ids != own))
                    at = at[np.lexsort((ids[at], -scores[i][at].round(9)))[:k]]
                    out += [(own, int(ids[j]), float(scores[i][j])) for j in at]
                if out:
                    yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    met = pairs.select("width", "q_ids", "q_units", "ids", "units").mapInArrow(work, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vector_top_k(queries: DataFrame, vectors: DataFrame, *, k: int = 5, min_score: float = 0.3, query_rows: int = 512, vector_rows: int = 4096) -> DataFrame:
    """query_id, vec_id, score and rank of the k most similar other vectors by cosine, above the threshold; ties by the smaller id."""
    asked = _blocks(unit_rows(queries), ["width"], query_rows, "q_")
    held = staged(_blocks(unit_rows(vectors), ["width"], vector_rows, ""), "vectors")
    counts = held.groupBy("width").agg(F.max("block").alias("last"))  # a row a length
    asked = asked.join(F.broadcast(counts), "width").select("width", "q_ids", "q_units", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    return _score(asked.join(held, ["width", "block"]), k, min_score)


@dataclass(frozen=True)
class Index:
    """Cell centres by vector length, and the stored cells: width, cell, block, ids, units."""

    centres: dict[int, np.ndarray]
    blocks: DataFrame


def fit_centres(rows: DataFrame, cells: int | None, *, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[int, np.ndarray]:
    """Centres of the vectors of each length, from the sample; about the root of the number of vectors unless ``cells`` is given."""
    centres = {}
    for width, n in [(r.width, r["count"]) for r in rows.groupBy("width").count().orderBy("width").toLocalIterator()]:
        sample = rows.where(F.col("width") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select(array_to_vector("unit").alias("features"))
        wanted = int(min(cells or max(1, round(np.sqrt(n))), MOST_CELLS, n, sample_rows))
        if wanted < 2:
            centres[width] = np.zeros((1, width))
            continue
        model = KMeans(k=wanted, seed=seed, maxIter=10, distanceMeasure="cosine").fit(staged(sample, "sample"))
        centres[width] = np.asarray(model.clusterCenters())
    return centres


def _nearest(rows: DataFrame, centres: dict[int, np.ndarray], probes: int) -> DataFrame:
    """Rows with the ``cell`` numbers of their nearest centres, a row each."""
    known = rows.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, units = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for width in np.unique(widths).tolist():
                if width not in known.value:
                    continue  # no vector of this length is indexed
                at = np.flatnonzero(widths == width)
                part = batch.take(pa.array(at))
                near = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width) @ known.value[width].T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                again = pa.array(np.repeat(np.arange(len(at)), cells.shape[1]))
                yield pa.record_batch([*part.take(again).columns, pa.array(cells.reshape(-1).astype(np.int32))], names=["vec_id", "width", "unit", "cell"])

    return rows.select("vec_id", "width", "unit").mapInArrow(work, "vec_id long, width int, unit array<double>, cell int")


def build_index(vectors: DataFrame, *, cells: int | None = None, block_rows: int = 4096) -> Index:
    """Every vector in the cell of its nearest centre; cells are stored in blocks, so one that holds many is many rows."""
    rows = staged(unit_rows(vectors), "unit")
    centres = fit_centres(rows, cells)
    return Index(centres, staged(_blocks(_nearest(rows, centres, 1), ["width", "cell"], block_rows, ""), "cells"))


def search_index(index: Index, queries: DataFrame, *, probes: int, k: int = 5, min_score: float = 0.3, query_rows: int = 512) -> DataFrame:
    """As ``vector_top_k``, over the ``probes`` cells nearest to each query; what it finds is ranked by exact scores."""
    asked = _blocks(_nearest(unit_rows(queries), index.centres, probes), ["width", "cell"], query_rows, "q_")
    counts = index.blocks.groupBy("width", "cell").agg(F.max("block").alias("last"))  # a row a cell
    asked = asked.join(F.broadcast(counts), ["width", "cell"]).select("width", "cell", "q_ids", "q_units", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    return _score(asked.join(index.blocks, ["width", "cell", "block"]), k, min_score)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``wanted, found, recall``: the share of the exact way's rows that are found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(F.lit(1.0)))


def choose_probes(index: Index, queries: DataFrame, vectors: DataFrame, *, target: float = 0.95, sample_queries: int = 200, **options) -> int:
    """The least power of two of probes (or all cells) with which a sample of queries reaches the recall."""
    most = max((len(c) for c in index.centres.values()), default=1)
    sample = staged(queries.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_queries), "queries")
    exact = staged(vector_top_k(sample, vectors, **options), "exact")
    probes = 1
    while probes < most and recall(search_index(index, sample, probes=probes, **options), exact).first()["recall"] < target:
        probes *= 2
    return min(probes, most)
