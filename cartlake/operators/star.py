"""Staging views, dimensions, facts and the customer value mart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.functions.expressions import day_key, is_cancelled, match_status, or_zero, staged_time, with_missing

MONEY = "decimal(18,2)"


def _money(name: str, default: bool = False) -> Column:
    value = F.coalesce(F.col(name), F.lit(0)) if default else F.col(name)
    return value.cast(MONEY).alias(name)


def stg_customers(df: DataFrame) -> DataFrame:
    df = with_missing(df, {"phone": "string", "created_at": "string", "updated_at": "string", "_ts_ms": "long"})
    names = [F.trim(c).alias(c) for c in ("first_name", "last_name")]
    return df.select(F.col("customer_id").cast("long"), *names, F.lower(F.trim("email")).alias("email"), "phone", "country", "state", "city", "signup_date", "customer_segment", staged_time(df, "created_at"), staged_time(df, "updated_at"), F.col("_ts_ms").alias("cdc_ts_ms"))


def stg_products(df: DataFrame) -> DataFrame:
    df = with_missing(df, {"created_at": "string", "updated_at": "string"})
    return df.select(F.col("product_id").cast("long"), "product_name", "category", "subcategory", "brand", _money("price"), _money("cost"), "supplier_id", F.col("inventory_quantity").cast("long"), staged_time(df, "created_at"), staged_time(df, "updated_at"))


def stg_orders(df: DataFrame) -> DataFrame:
    df = with_missing(df, {"shipping_country": "string", "shipping_state": "string", "created_at": "string", "updated_at": "string"})
    ids = [F.col(c).cast("long") for c in ("order_id", "customer_id")]
    return df.select(*ids, staged_time(df, "order_date"), F.upper("status").alias("order_status"), "payment_method", "shipping_country", "shipping_state", _money("total_amount"), _money("discount", True), _money("tax", True), staged_time(df, "created_at"), staged_time(df, "updated_at"))


def stg_order_items(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long") for c in ("order_item_id", "order_id", "product_id", "quantity")), _money("unit_price"), _money("discount", True))


def stg_payments(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long") for c in ("payment_id", "order_id", "customer_id")), _money("amount"), "payment_method", F.upper("payment_status").alias("payment_status"), staged_time(df, "transaction_timestamp"))


def stg_website_events(df: DataFrame) -> DataFrame:
    df = with_missing(df, {"device": "string", "browser": "string", "ip_address": "string"})
    return df.select("event_id", F.col("customer_id").cast("long"), "session_id", "event_type", F.col("product_id").cast("long"), staged_time(df, "event_timestamp"), "device", "browser", "ip_address")


def stg_support_tickets(df: DataFrame) -> DataFrame:
    df = with_missing(df, {"category": "string", "priority": "string", "message": "string"})
    return df.select(F.col("ticket_id").cast("long"), F.col("customer_id").cast("long"), staged_time(df, "created_at"), "category", "priority", "message", "status", "resolution_time_minutes")


def stg_marketing_events(df: DataFrame) -> DataFrame:
    df = with_missing(df, {"campaign": "string", "channel": "string"})
    flags = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("impression", "click", "conversion")]
    return df.select(F.col("marketing_event_id").cast("long"), "campaign_id", F.col("customer_id").cast("long"), "campaign", "channel", *flags, _money("cost", True), staged_time(df, "event_timestamp"))


def dim_customer(staged: DataFrame) -> DataFrame:
    return staged.withColumn("customer_name", F.concat_ws(" ", "first_name", "last_name")).select("customer_id", "first_name", "last_name", "customer_name", "email", "phone", "country", "state", "city", "signup_date", "customer_segment", "created_at", "updated_at")


def dim_product(staged: DataFrame) -> DataFrame:
    margin = F.col("price") - F.col("cost")
    share = F.when(F.col("price") == 0, F.lit(0).cast("decimal(18,4)")).otherwise((margin / F.col("price")).cast("decimal(18,4)"))
    return staged.withColumns({"unit_margin": margin, "margin_pct": share}).select("product_id", "product_name", "category", "subcategory", "brand", "price", "cost", "unit_margin", "margin_pct", "supplier_id", "inventory_quantity", "created_at", "updated_at")


def dim_date(staged_orders: DataFrame, *, today: Column | None = None) -> DataFrame:
    """One row for each day from the first to the last order; only today's where there is no order."""
    today = F.current_date() if today is None else today
    ends = staged_orders.agg(*(F.coalesce(f("order_date").cast("date"), today).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    day = F.col("date_day")
    parts = {"year": F.year(day), "quarter": F.quarter(day), "month": F.month(day), "month_name": F.date_format(day, "MMMM"), "week_of_year": F.weekofyear(day), "day_of_month": F.dayofmonth(day), "day_of_week": F.dayofweek(day), "day_name": F.date_format(day, "EEEE"), "is_weekend": F.dayofweek(day).isin(1, 7)}
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("date_day")).select(day_key("date_day"), "date_day", *(c.alias(n) for n, c in parts.items()))


def fact_orders(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Staged orders with their items' and payments' sums; both sides are aggregated before they are joined."""
    per_order = items.groupBy("order_id").agg(F.count("*").alias("line_count"), F.sum("quantity").alias("item_quantity"), F.sum(F.col("quantity") * F.col("unit_price")).alias("gross_item_amount"), F.sum("discount").alias("item_discount_amount"))
    paid = payments.groupBy("order_id").agg(F.sum("amount").alias("paid"), F.max("transaction_timestamp").alias("last_payment_timestamp"))
    joined = orders.join(per_order, "order_id", "left").join(paid, "order_id", "left")
    return joined.select(
        "order_id", "customer_id", day_key("order_date"), "order_date", "order_status", "payment_method", "shipping_country", "shipping_state", "total_amount", F.col("discount").alias("order_discount"), "tax",
        *map(or_zero, ("line_count", "item_quantity", "gross_item_amount", "item_discount_amount")), or_zero("paid").alias("payment_amount"), "last_payment_timestamp",
        (F.coalesce("paid", F.lit(0)) - F.coalesce("total_amount", F.lit(0))).cast(MONEY).alias("payment_variance"), match_status("paid", "total_amount", unknown_is_zero=False).alias("payment_match_status"), "created_at", "updated_at",
    )


def fact_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    of_order = orders.select("order_id", "order_status", F.col("total_amount").alias("order_total_amount"))
    return payments.join(of_order, "order_id", "left").select("payment_id", "order_id", "customer_id", day_key("transaction_timestamp"), "amount", "payment_method", "payment_status", "transaction_timestamp", "order_status", "order_total_amount")


def fact_customer_activity(customers: DataFrame, web: DataFrame, tickets: DataFrame, marketing: DataFrame) -> DataFrame:
    visits = web.groupBy("customer_id").agg(F.count("*").alias("website_event_count"), F.countDistinct("session_id").alias("session_count"), F.max("event_timestamp").alias("last_website_event"))
    is_open = (~F.upper("status").isin("CLOSED", "RESOLVED")).cast("long")
    support = tickets.groupBy("customer_id").agg(F.count("*").alias("support_ticket_count"), F.sum(F.coalesce(is_open, F.lit(0))).alias("open_support_ticket_count"), F.avg("resolution_time_minutes").alias("avg_resolution_time_minutes"))
    contacts = marketing.groupBy("customer_id").agg(*(F.sum(c).alias(n) for c, n in (("impression", "marketing_impressions"), ("click", "marketing_clicks"), ("conversion", "marketing_conversions"), ("cost", "marketing_cost"))))
    joined = customers.select("customer_id")
    for side in (visits, support, contacts):
        joined = joined.join(side, "customer_id", "left")
    counted = ("support_ticket_count", "open_support_ticket_count", "avg_resolution_time_minutes", "marketing_impressions", "marketing_clicks", "marketing_conversions", "marketing_cost")
    return joined.select("customer_id", or_zero("website_event_count"), or_zero("session_count"), "last_website_event", *map(or_zero, counted))


def mart_customer_value(customers: DataFrame, orders: DataFrame, payments: DataFrame, activity: DataFrame) -> DataFrame:
    """Dimension, facts and activity to one row a customer with its value segment."""
    kept = F.when(is_cancelled("order_status"), F.lit(0)).otherwise(F.col("total_amount"))
    bought = orders.groupBy("customer_id").agg(F.countDistinct("order_id").alias("total_orders"), F.sum(kept).alias("lifetime_order_value"), F.max("order_date").alias("last_order_date"))
    paid = payments.groupBy("customer_id").agg(F.sum("amount").alias("lifetime_payments"), F.max("transaction_timestamp").alias("last_payment_date"))
    joined = customers.join(bought, "customer_id", "left").join(paid, "customer_id", "left").join(activity, "customer_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_orders", "lifetime_order_value", "lifetime_payments")})
    n, value = F.col("total_orders"), F.col("lifetime_order_value")
    segment = F.when((n >= 10) | (value >= 5000), "HIGH_VALUE").when((n >= 3) | (value >= 1000), "MEDIUM_VALUE").when(n > 0, "LOW_VALUE").otherwise("PROSPECT")
    identity, did = ("customer_id", "customer_name", "email", "country", "state", "city", "customer_segment"), ("website_event_count", "session_count", "support_ticket_count", "marketing_impressions", "marketing_clicks", "marketing_conversions")
    return joined.select(*identity, "total_orders", "lifetime_order_value", "lifetime_payments", *did, "last_order_date", "last_payment_date", segment.alias("customer_value_segment"))


class Star:
    """The star schema of a set of entities; each model is built once, from those it needs.

    With ``store`` (a model's name and frame to the frame as stored), each model is stored once, and what is built from it
    reads it there; without it models are plans.
    """

    STAGING = {"customers": stg_customers, "products": stg_products, "orders": stg_orders, "order_items": stg_order_items, "payments": stg_payments, "website_events": stg_website_events, "support_tickets": stg_support_tickets, "marketing_events": stg_marketing_events}
    MODELS = ("dim_customer", "dim_product", "dim_date", "fact_orders", "fact_payments", "fact_customer_activity", "mart_customer_value")

    def __init__(self, source, store: Callable[[str, DataFrame], DataFrame] | None = None) -> None:
        self.source, self.built, self.store = source, {}, store

    def stg(self, entity: str) -> DataFrame:
        name = f"stg_{entity}"
        if name not in self.built:
            self.built[name] = self.STAGING[entity](getattr(self.source, entity))
        return self.built[name]

    def model(self, name: str) -> DataFrame:
        if name not in self.built:
            made = {
                "dim_customer": lambda: dim_customer(self.stg("customers")),
                "dim_product": lambda: dim_product(self.stg("products")),
                "dim_date": lambda: dim_date(self.stg("orders")),
                "fact_orders": lambda: fact_orders(self.stg("orders"), self.stg("order_items"), self.stg("payments")),
                "fact_payments": lambda: fact_payments(self.stg("payments"), self.stg("orders")),
                "fact_customer_activity": lambda: fact_customer_activity(self.stg("customers"), self.stg("website_events"), self.stg("support_tickets"), self.stg("marketing_events")),
                "mart_customer_value": lambda: mart_customer_value(*map(self.model, ("dim_customer", "fact_orders", "fact_payments", "fact_customer_activity"))),
            }[name]()
            self.built[name] = made if self.store is None else self.store(name, made)
        return self.built[name]


def build_star(source, names: tuple[str, ...] = Star.MODELS, *, store: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The named models: those that they need are included in their plans or, with ``store``, stored once for the run."""
    star = Star(source, store)
    return {name: star.model(name) for name in names}
