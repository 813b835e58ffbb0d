"""Offline evaluation of rankings: splits, predictions, hits, metrics, weight tuning and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlake.operators import recommend as R
from cartlake.sources.staging import staged


def temporal_split(events: DataFrame, *, validation_days: int = 30, test_days: int = 30) -> DataFrame:
    """Events with split TRAIN, VALIDATION or TEST by days before the last event."""
    last = events.agg(F.max("event_date").alias("_last")).select(F.date_sub("_last", test_days).alias("test_start"), F.date_sub("_last", test_days + validation_days).alias("validation_start"))
    split = F.when(F.col("event_date") < F.col("validation_start"), "TRAIN").when(F.col("event_date") < F.col("test_start"), "VALIDATION").otherwise("TEST")
    return events.crossJoin(F.broadcast(last)).withColumn("split", split)  # one row


def split_statistics(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("events"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("product_id").alias("products"))


def require_splits(split: DataFrame) -> DataFrame:
    found = {r.split for r in split.select("split").distinct().collect()}
    if missing := {"TRAIN", "VALIDATION", "TEST"} - found:
        raise ValueError(f"no events in {sorted(missing)}")
    return split


def holdout_pairs(pairs: DataFrame, *, days: int = 30, min_history: int = 2) -> tuple[DataFrame, DataFrame]:
    """(history, targets): pairs last seen before the cut and from it on, of customers with enough of both."""
    last = pairs.agg(F.date_sub(F.max(F.col("last_interaction_at").cast("date")), days).alias("_cut"))
    dated = pairs.crossJoin(F.broadcast(last)).withColumn("_future", F.col("last_interaction_at").cast("date") >= F.col("_cut"))
    able = dated.groupBy("customer_id").agg(F.count(F.when(~F.col("_future"), 1)).alias("h"), F.count(F.when(F.col("_future"), 1)).alias("f")).where((F.col("h") >= min_history) & (F.col("f") > 0)).select("customer_id")
    chosen = dated.join(able, "customer_id", "left_semi")
    history = chosen.where(~F.col("_future")).drop("_cut", "_future")
    targets = chosen.where("_future").select("customer_id", "product_id").join(history.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_anti")
    return history, targets


def actuals(split: DataFrame, part: str, before: tuple[str, ...]) -> DataFrame:
    """Products that customers with earlier events meet for the first time in this part; told in one exchange by customer."""
    rows = split.where(F.col("split").isin(part, *before)).select("customer_id", "product_id", F.col("split").isin(*before).alias("_earlier"))
    pairs = rows.repartition("customer_id").groupBy("customer_id", "product_id").agg(F.max("_earlier").alias("_earlier"))
    known = pairs.withColumn("_known", F.max("_earlier").over(Window.partitionBy("customer_id")))
    return known.where("_known and not _earlier").select("customer_id", "product_id")


def training_sides(split: DataFrame, parts: tuple[str, ...], wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs and popularity learned from these parts of the events only, from everybody, as is the similarity; and the personal
    candidates of the customers to be judged. Each is stored once."""
    pairs = staged(R.interactions_of_events(split.where(F.col("split").isin(*parts))), "pairs")
    popularity = staged(R.product_popularity(pairs), "popularity")
    similarity = staged(R.product_similarity(pairs, support=R.supports_of(popularity)), "similarity")
    own = pairs.join(wanted.select("customer_id").distinct(), "customer_id", "left_semi")
    return pairs, popularity, staged(R.item_item_candidates(own, similarity), "personal")


def candidate_set(split: DataFrame, parts: tuple[str, ...], wanted: DataFrame, *, limit: int = 100) -> DataFrame:
    """Scored candidates of the customers to be judged; their learning sides still come from everybody."""
    pairs, popularity, personal = training_sides(split, parts, wanted)
    judged = wanted.select("customer_id").distinct()
    return R.hybrid_candidates(judged, pairs.join(judged, "customer_id", "left_semi"), personal, popularity, candidate_limit=limit)


def weighted_rankings(candidates: DataFrame, grid: list[tuple[str, float, float]], *, k: int = 10, fallback_scaled: bool = False) -> DataFrame:
    """model, customer_id, product_id and rank for each weight pair: candidates meet the small grid in one pass."""
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), R.hybrid_score(R.Weights(wp, wq), fallback_scaled=fallback_scaled).alias("s")) for m, wp, wq in grid))
    each = candidates.select("customer_id", "product_id", F.explode(pairs).alias("g")).select("customer_id", "product_id", "g.model", "g.s")
    best = Window.partitionBy("model", "customer_id").orderBy(F.desc("s"), "product_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("model", "customer_id", "product_id", "rank")


BASELINES = [("popularity", 0.0, 1.0), ("item_item", 1.0, 0.0), ("hybrid_80_20", 0.8, 0.2)]
GRID = [(f"hybrid_{p}_{100 - p}", p / 100, 1 - p / 100) for p in (100, 90, 80, 70, 60, 50, 0)]


def baseline_predictions(split: DataFrame, wanted: DataFrame, *, k: int = 10) -> DataFrame:
    """Popularity, item-item and 80/20 rankings learned from TRAIN for the judged customers."""
    return weighted_rankings(candidate_set(split, ("TRAIN",), wanted), BASELINES, k=k, fallback_scaled=True)


def score_hits(predictions: DataFrame, wanted: DataFrame) -> DataFrame:
    truth = wanted.select("customer_id", "product_id").distinct().withColumn("hit", F.lit(1))
    return predictions.join(truth, ["customer_id", "product_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def customer_metrics(predictions: DataFrame, wanted: DataFrame, *, k: int = 10) -> DataFrame:
    """Precision, recall, hit rate, average precision and NDCG of each model's ranking for each customer with targets."""
    totals = wanted.select("customer_id", "product_id").distinct().groupBy("customer_id").agg(F.count("*").alias("actual"))
    hits = score_hits(predictions, wanted)
    upto = Window.partitionBy("model", "customer_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gains = hits.withColumn("sofar", F.sum("hit").over(upto))
    per = gains.groupBy("model", "customer_id").agg(F.count("*").alias("returned"), F.sum("hit").alias("hits"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.when(F.col("hit") == 1, F.col("sofar") / F.col("rank"))).alias("precisions"))
    per = per.join(totals, "customer_id")
    best = F.least(F.col("actual"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), best), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return per.select("model", "customer_id", (F.col("hits") / F.col("returned")).alias("precision"), (F.col("hits") / F.col("actual")).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit_rate"), (F.coalesce("precisions", F.lit(0.0)) / best).alias("average_precision"), "dcg", ideal.alias("idcg"), (F.col("dcg") / ideal).alias("ndcg"))


def catalog_coverage(predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    size = catalog.agg(F.countDistinct("product_id").alias("catalog"))
    return predictions.groupBy("model").agg(F.countDistinct("product_id").alias("recommended_products")).crossJoin(size).withColumn("catalog_coverage", F.col("recommended_products") / F.col("catalog"))


def model_metrics(predictions: DataFrame, wanted: DataFrame, catalog: DataFrame, *, k: int = 10) -> DataFrame:
    """Mean metrics of each model with its coverage of the catalog."""
    names = {"precision": "precision", "recall": "recall", "hit_rate": "hit_rate", "average_precision": "map", "ndcg": "ndcg"}
    means = customer_metrics(predictions, wanted, k=k).groupBy("model").agg(F.count("*").alias("evaluated_customers"), *(F.avg(c).alias(n) for c, n in names.items()))
    return means.join(catalog_coverage(predictions, catalog).drop("catalog"), "model").withColumn("k", F.lit(k))


def tune_weights(split: DataFrame, *, grid: list[tuple[str, float, float]] = GRID, k: int = 10) -> DataFrame:
    """Each weight pair's precision, recall and hit rate on VALIDATION, from one candidate set learned from TRAIN."""
    wanted = staged(actuals(split, "VALIDATION", ("TRAIN",)), "wanted")
    rankings = weighted_rankings(candidate_set(split, ("TRAIN",), wanted), grid, k=k, fallback_scaled=True)
    means = customer_metrics(rankings, wanted, k=k).groupBy("model").agg(F.count("*").alias("evaluated_customers"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("hit_rate").alias("hit_rate"))
    weight = F.create_map(*(F.lit(x) for model, wp, _ in grid for x in (model, wp)))
    return means.withColumn("personalized_weight", weight[F.col("model")]).withColumn("popularity_weight", 1 - F.col("personalized_weight"))


def select_config(tuned: DataFrame) -> DataFrame:
    """The best weight pair by hit rate, recall, precision, then name."""
    return tuned.orderBy(*(F.desc(F.round(c, 9)) for c in ("hit_rate", "recall", "precision")), "model").limit(1)


def final_test(split: DataFrame, weights: R.Weights, catalog: DataFrame, *, k: int = 10) -> DataFrame:
    """The selected weights, learned from TRAIN and VALIDATION, judged on TEST."""
    before = ("TRAIN", "VALIDATION")
    wanted = staged(actuals(split, "TEST", before), "wanted")
    rankings = weighted_rankings(candidate_set(split, before, wanted), [("champion", weights.personal, weights.popularity)], k=k, fallback_scaled=True)
    return model_metrics(staged(rankings, "rankings"), wanted, catalog, k=k)


def retrieval_metrics(found: DataFrame, relevant: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """HitRate@k and mean reciprocal rank of the first relevant result; queries without one count 0."""
    first = found.where(F.col("rank") <= k).join(relevant, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    each = queries.select("query_id").distinct().join(first, "query_id", "left")
    return each.agg(F.count("*").alias("queries"), F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
