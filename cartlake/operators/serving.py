"""Serving views, conversation turns and text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlake.operators.cdc import latest_per_key
from cartlake.sources.tables import conform

CUSTOMER = {"customer_id": "long", "first_name": "string", "last_name": "string", "customer_segment": "string", "country": "string", "total_orders": "long", "total_spend": "double", "website_event_count": "long", "support_ticket_count": "long", "last_order_date": "timestamp_ntz"}
CHURN = {"customer_id": "long", "prediction_date": "date", "churn_probability": "double", "churn_prediction": "int", "risk_band": "string", "revenue_at_risk": "double"}
RECOMMENDED = {"customer_id": "long", "product_id": "long", "recommendation_rank": "int", "recommendation_score": "double", "recommendation_reason": "string"}


def serve_customer_360(profiles: DataFrame) -> DataFrame:
    """One row a customer in the serving schema."""
    return latest_per_key(conform(profiles, CUSTOMER).where("customer_id is not null"), ["customer_id"], ["last_order_date"])


def risk_band(p: Column) -> Column:
    return F.when(p >= 0.8, "CRITICAL").when(p >= 0.6, "HIGH").when(p >= 0.3, "MEDIUM").otherwise("LOW")


def serve_churn(predictions: DataFrame) -> DataFrame:
    """The latest prediction of each customer; class and band follow from the probability where they are absent."""
    made = conform(predictions, CHURN).where("customer_id is not null")
    made = made.withColumn("churn_prediction", F.coalesce("churn_prediction", (F.col("churn_probability") >= 0.5).cast("int"))).withColumn("risk_band", F.coalesce("risk_band", risk_band(F.col("churn_probability"))))
    return latest_per_key(made, ["customer_id"], ["prediction_date"])


def serve_recommendations(recommended: DataFrame) -> DataFrame:
    """One row a customer and product, the best rank."""
    rows = conform(recommended, RECOMMENDED).where("customer_id is not null and product_id is not null")
    return rows.groupBy("customer_id", "product_id").agg(F.min_by(F.struct("recommendation_rank", "recommendation_score", "recommendation_reason"), F.struct("recommendation_rank", "recommendation_score", "recommendation_reason")).alias("r")).select("customer_id", "product_id", "r.*")


def top_recommendations(recommended: DataFrame, n: int = 10) -> DataFrame:
    if not 1 <= n <= 50:
        raise ValueError("n must be from 1 to 50")
    return recommended.where(F.col("recommendation_rank") <= n)


def customer_intelligence(profiles: DataFrame, churn: DataFrame, recommended: DataFrame, *, n: int = 10) -> DataFrame:
    """Profile, churn and top recommendations of every customer as one record, without names or contact data."""
    listed = top_recommendations(recommended, n).groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("recommendation_rank", "product_id", "recommendation_score", "recommendation_reason"))).alias("recommendations"))
    risk = churn.select("customer_id", F.struct("churn_probability", "risk_band").alias("churn"))
    shown = [c for c in profiles.columns if c not in ("first_name", "last_name", "email", "phone")]
    return profiles.select(*shown).join(risk, "customer_id", "left").join(listed, "customer_id", "left")


def recent_turns(turns: DataFrame, n: int = 12) -> DataFrame:
    """The last n messages of each conversation, oldest first."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    kept = turns.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("_place")))).drop("_place")


def sections(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, section, heading, body``: a text cut before each line that starts with #; what precedes the first has no heading."""
    parts = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(F.coalesce(text_column, F.lit("")), r"(?m)^(?=#{1,6} )")).alias("section", "part"))
    heading = F.regexp_extract("part", r"^#{1,6} +([^\n]*)", 1)
    body = F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", "")
    return parts.select("id", "section", F.when(heading != "", heading).alias("heading"), body.alias("body")).where(F.trim("body") != "")


def chunk_windows(rows: DataFrame, *, size: int = 1000, overlap: int = 150, text_column: str = "text") -> DataFrame:
    """Rows with chunk_index and chunk: fixed windows of characters that overlap; the last one ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    step, length = size - overlap, F.char_length(text_column)
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((length - size) / step).cast("int") * step, F.lit(step)))
    exploded = rows.where(length > 0).select("*", F.posexplode(starts).alias("chunk_index", "chunk_start"))
    return exploded.withColumn("chunk", F.substring(text_column, F.col("chunk_start") + 1, F.lit(size)))


def chunk_id(source: Column, index: Column) -> Column:
    """The first 15 hexadecimal digits of the SHA-256 of source and index, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", source.cast("string"), index.cast("string")), 256), 1, 15), 16, 10).cast("long")


def chunk_documents(docs: DataFrame, *, size: int = 1000, overlap: int = 150) -> DataFrame:
    """id, chunk_id, section, heading, chunk_index and chunk of heading sections cut into windows."""
    windows = chunk_windows(sections(docs), size=size, overlap=overlap, text_column="body")
    return windows.select("id", chunk_id(F.concat_ws("/", "id", "section"), F.col("chunk_index")).alias("chunk_id"), "section", "heading", "chunk_index", "chunk")
