"""Dashboard and reporting queries over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.functions.expressions import is_cancelled, or_zero


def executive_kpis(orders: DataFrame) -> DataFrame:
    live = F.when(~is_cancelled("order_status"), F.col("total_amount"))
    return orders.agg(F.countDistinct("order_id").alias("total_orders"), F.sum(F.coalesce(live, F.lit(0))).alias("total_revenue"), F.avg(live).alias("average_order_value"), F.countDistinct("customer_id").alias("purchasing_customers"), F.count(F.when(F.col("payment_match_status") == "MISMATCH", 1)).alias("payment_mismatch_orders"))


def daily_revenue(orders: DataFrame) -> DataFrame:
    by_day = orders.where(~is_cancelled("order_status")).groupBy(F.col("order_date").cast("date").alias("order_date"))
    return by_day.agg(F.countDistinct("order_id").alias("orders"), F.sum("total_amount").alias("revenue"), F.avg("total_amount").alias("average_order_value")).orderBy("order_date")


def customer_segments(mart: DataFrame) -> DataFrame:
    grouped = mart.groupBy("customer_value_segment").agg(F.count("*").alias("customers"), F.sum("lifetime_order_value").alias("lifetime_value"), F.avg("lifetime_order_value").alias("avg_customer_value"), F.avg("total_orders").alias("avg_orders"))
    return grouped.orderBy(F.desc("lifetime_value"), "customer_value_segment")


def top_customers(mart: DataFrame, n: int = 100) -> DataFrame:
    shown = ("customer_id", "customer_name", "country", "state", "customer_segment", "customer_value_segment", "total_orders", "lifetime_order_value", "lifetime_payments", "website_event_count", "marketing_conversions", "last_order_date")
    return mart.select(*shown).orderBy(F.desc("lifetime_order_value"), "customer_id").limit(n)


def product_sales_report(products: DataFrame, items: DataFrame) -> DataFrame:
    """Only products with sales. Items are summed by key first: the attributes need not be part of the shuffle."""
    sold = items.groupBy("product_id").agg(F.sum("quantity").alias("units_sold"), F.sum(F.col("quantity") * F.col("unit_price")).alias("gross_revenue"))
    return products.join(sold, "product_id").select("product_id", "product_name", "category", "subcategory", "brand", "price", "unit_margin", "margin_pct", "units_sold", "gross_revenue").orderBy(F.desc("gross_revenue"), "product_id")


def payment_reconciliation(orders: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(n) for c, n in (("total_amount", "order_amount"), ("payment_amount", "payment_amount"), ("payment_variance", "payment_variance"))]
    return orders.groupBy("payment_match_status").agg(F.count("*").alias("orders"), *sums).orderBy(F.desc("orders"), "payment_match_status")


def marketing_support_by_segment(mart: DataFrame, activity: DataFrame) -> DataFrame:
    names = {"website_event_count": "website_events", "session_count": "sessions", "support_ticket_count": "support_tickets", "open_support_ticket_count": "open_support_tickets", "marketing_impressions": "impressions", "marketing_clicks": "clicks", "marketing_conversions": "conversions", "marketing_cost": "marketing_cost"}
    joined = activity.join(mart.select("customer_id", "customer_value_segment"), "customer_id")
    return joined.groupBy("customer_value_segment").agg(F.count("*").alias("customers"), *(F.sum(c).alias(n) for c, n in names.items())).orderBy(F.desc("customers"), "customer_value_segment")


def customer_metrics(profiles: DataFrame, churn: DataFrame) -> DataFrame:
    """A reporting view without identifiers or contact data."""
    risk = churn.select("customer_id", "churn_probability", "risk_band")
    return profiles.join(risk, "customer_id", "left").select("customer_segment", "country", "total_orders", "total_spend", "website_event_count", "support_ticket_count", "churn_probability", "risk_band")


def orphan_check(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows of ``children`` whose key has no parent; null keys count as orphans."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def orphan_counts(checks: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    parts = [orphan_check(*c).agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans") for name, c in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def entity_counts(entities: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in entities.items()])


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, most frequent first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), "value")


def top_spenders(customers: DataFrame, orders: DataFrame, n: int = 10) -> DataFrame:
    spent = orders.groupBy("customer_id").agg(F.count("order_id").alias("total_orders"), F.sum("total_amount").alias("total_spend"))
    return customers.join(spent, "customer_id", "left").select("customer_id", "first_name", "last_name", or_zero("total_orders"), or_zero("total_spend")).orderBy(F.desc("total_spend"), "customer_id").limit(n)


def preview(df: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
COMPARISONS = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v), "between": lambda c, v: c.between(*v), "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}


def metrics_aggregate(df: DataFrame, *, allowed: set[str], dims: list[str] = (), aggs: dict[str, tuple[str, str]] = {}, filters: list[tuple] = (), order: list[tuple[str, bool]] = (), limit: int = 100) -> DataFrame:  # noqa: B006
    """One table's grouped metrics from names on a list; anything else is refused. At most 100 rows.

    ``aggs`` maps an output name to (function, column); ``filters`` are (column, comparison, value); ``order`` is
    (name, descending). Averages are rounded to two places; empty sums are 0.
    """
    named = [*dims, *(c for _, c in aggs.values() if c != "*"), *(f[0] for f in filters)]
    for unknown in [c for c in named if c not in allowed or c not in df.columns]:
        raise ValueError(f"column {unknown!r} is not allowed")
    if not aggs or (bad := [f for f, _ in aggs.values() if f not in AGGREGATES]) or (bad := [f[1] for f in filters if f[1] not in COMPARISONS]):
        raise ValueError(f"not allowed: {bad if aggs else 'no aggregate'}")
    for column, comparison, value in filters:
        df = df.where(COMPARISONS[comparison](F.col(column), value))
    made = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "avg": lambda c: F.round(F.avg(c), 2)}
    result = df.groupBy(*dims).agg(*(made.get(f, AGGREGATES[f])(c).alias(n) for n, (f, c) in aggs.items()))
    if wrong := [n for n, _ in order if n not in result.columns]:
        raise ValueError(f"cannot order by {wrong}")
    keys = [F.desc(n) if down else F.asc(n) for n, down in order] + [F.asc(d) for d in dims]
    return (result.orderBy(*keys) if keys else result).limit(max(1, min(limit, 100)))
