"""Validation and monitoring of recommendations and churn predictions, each in one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.sources.tables import require_columns


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def validate_recommendations(recommended: DataFrame, pairs: DataFrame, customers: DataFrame, *, k: int = 10) -> DataFrame:
    """Counts of what must not be: null keys, repeated pairs, ranks and scores out of range, seen products, several runs."""
    require_columns(recommended, ["customer_id", "product_id", "recommendation_rank", "recommendation_score", "run_id"])
    score = F.col("recommendation_score")
    counts = recommended.agg(
        F.count("*").alias("row_count"), _count(F.col("customer_id").isNull() | F.col("product_id").isNull()).alias("null_keys"), (F.count("*") - F.countDistinct("customer_id", "product_id")).alias("duplicates"),
        _count(~F.col("recommendation_rank").between(1, k)).alias("bad_ranks"), _count(score.isNull() | F.isnan(score) | (score < 0)).alias("bad_scores"), F.countDistinct("run_id").alias("runs"), F.countDistinct("customer_id").alias("reached"),
    )
    seen = recommended.join(pairs.select("customer_id", "product_id").distinct(), ["customer_id", "product_id"], "left_semi").agg(F.count("*").alias("seen"))
    total = customers.agg(F.countDistinct("customer_id").alias("customers"))
    return counts.crossJoin(seen).crossJoin(total).select("row_count", "null_keys", "duplicates", "bad_ranks", "bad_scores", "seen", "runs", (F.col("reached") / F.col("customers")).alias("coverage"))


def require_valid(checked: DataFrame, *, min_coverage: float = 0.99) -> None:
    """Raises with the names of the failed checks of a one-row result."""
    row = checked.first().asDict()
    bad = [n for n in ("null_keys", "duplicates", "bad_ranks", "bad_scores", "seen", "invalid") if row.get(n)]
    bad += ["coverage"] * (row["coverage"] < min_coverage) + ["runs"] * (row.get("runs", 1) != 1) + ["empty"] * (row["row_count"] == 0)
    if bad:
        raise ValueError(f"failed checks: {bad} in {row}")


def monitor_recommendations(recommended: DataFrame, customers: DataFrame, products: DataFrame, *, monitored_at: Column | None = None, accuracy: int = 100_000) -> DataFrame:
    """A run in 25 columns and the time: weights, coverage of customers and catalog, scores, numbers and shares by reason, what must not be."""
    score, n = F.col("recommendation_score"), F.count("*")
    reasons = {"personalized": ("hybrid_personalized", "personalized_similarity"), "fallback": ("popular_fallback",), "cold_start": ("popular_cold_start",)}
    stats = recommended.groupBy("run_id", "model_name", "model_version", "personalized_weight", "popularity_weight").agg(
        F.countDistinct("customer_id").alias("recommended_customers"), F.countDistinct("product_id").alias("recommended_products"), n.alias("total_recommendations"), F.avg(score).alias("avg_score"), F.percentile_approx(score, 0.5, accuracy).alias("median_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        *(_count(F.col("recommendation_reason").isin(*r)).alias(f"{name}_count") for name, r in reasons.items()), (n - F.countDistinct("customer_id", "product_id")).alias("duplicate_pairs"), _count(score.isNull() | F.isnan(score) | (score < 0)).alias("invalid_scores"),
    )
    totals = customers.agg(F.countDistinct("customer_id").alias("total_customers")).crossJoin(products.agg(F.countDistinct("product_id").alias("total_products")))
    shares = {"customer_coverage": ("recommended_customers", "total_customers"), "catalog_coverage": ("recommended_products", "total_products"), "avg_recommendations_per_customer": ("total_recommendations", "recommended_customers")} | {f"{name}_pct": (f"{name}_count", "total_recommendations") for name in reasons}
    made = stats.crossJoin(totals).withColumns({name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for name, (a, b) in shares.items()})
    each = [f"{name}_{kind}" for name in reasons for kind in ("count", "pct")]
    return made.select("run_id", "model_name", "model_version", "personalized_weight", "popularity_weight", "total_customers", "recommended_customers", "customer_coverage", "total_products", "recommended_products", "catalog_coverage", "total_recommendations", "avg_recommendations_per_customer", "avg_score", "median_score", "min_score", "max_score", *each, "duplicate_pairs", "invalid_scores", (F.current_timestamp() if monitored_at is None else monitored_at).alias("monitored_at"))


BANDS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def validate_churn_predictions(predictions: DataFrame) -> DataFrame:
    """Rows, invalid rows and repeated (customer, date) pairs."""
    p = F.col("churn_probability")
    broken = F.col("customer_id").isNull() | p.isNull() | ~p.between(0, 1) | ~F.col("churn_prediction").isin(0, 1) | ~F.col("risk_band").isin(*BANDS) | (F.col("revenue_at_risk") < 0)
    return predictions.agg(F.count("*").alias("row_count"), _count(F.coalesce(broken, F.lit(True))).alias("invalid"), (F.count("*") - F.countDistinct("customer_id", "prediction_date")).alias("duplicates"))


def monitor_churn(predictions: DataFrame, features: DataFrame, *, min_coverage: float = 0.99, monitored_at: Column | None = None) -> DataFrame:
    """A scoring run in 20 columns: coverage of the scored features, probabilities, bands, what must not be, the model, and the errors as a list."""
    p = F.col("churn_probability")
    bands = [_count(F.col("risk_band") == b).alias(f"{b.lower()}_risk_customers") for b in reversed(BANDS)]
    stats = predictions.agg(
        F.count("*").alias("prediction_count"), F.countDistinct("customer_id").alias("_customers"), F.avg(p).alias("avg_churn_probability"), F.min(p).alias("min_churn_probability"), F.max(p).alias("max_churn_probability"), F.avg(F.col("churn_prediction").cast("double")).alias("predicted_churn_rate"), F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("revenue_at_risk"), *bands,
        _count(F.coalesce(~p.between(0, 1) | F.isnan(p), F.lit(True))).alias("invalid_probability_count"), *(F.max(c).alias(c) for c in ("model_name", "model_version", "model_alias")),
    ).withColumn("duplicate_customer_count", F.col("prediction_count") - F.col("_customers"))
    asked = features.agg(F.count("*").alias("feature_count"), F.countDistinct("customer_id").alias("_asked"))
    made = stats.crossJoin(asked).withColumn("prediction_coverage", F.when(F.col("_asked") > 0, F.col("_customers") / F.col("_asked")).otherwise(F.lit(0.0)))
    wrong = {"coverage is too low": F.col("prediction_coverage") < min_coverage, "invalid probabilities": F.col("invalid_probability_count") > 0, "repeated customers": F.col("duplicate_customer_count") > 0, "invalid mean probability": F.coalesce(~F.col("avg_churn_probability").between(0, 1), F.lit(True))}
    errors = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in wrong.items())), lambda x: x.isNotNull())
    made = made.withColumns({"monitored_at": F.current_timestamp() if monitored_at is None else monitored_at, "status": F.when(F.size(errors) == 0, "PASS").otherwise("FAIL"), "validation_errors": F.to_json(errors)})
    return made.select("monitored_at", "status", "prediction_count", "feature_count", "prediction_coverage", "avg_churn_probability", "min_churn_probability", "max_churn_probability", "predicted_churn_rate", "revenue_at_risk", *(f"{b.lower()}_risk_customers" for b in reversed(BANDS)), "invalid_probability_count", "duplicate_customer_count", "model_name", "model_version", "model_alias", "validation_errors")
