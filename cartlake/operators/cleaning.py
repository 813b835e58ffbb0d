"""Cleaning of raw entities: trimming, typing, validity filters and one row a key.

Where the raw rows of a key differ, the row kept is the smallest by all its columns, so results do not depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlake.sources.commerce import KEYS


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key by the other columns' order; rows without a key go."""
    order = [F.col(c).asc_nulls_last() for c in df.columns if c != key] or [F.col(key)]
    ranked = df.where(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def _cleaned(df: DataFrame, key: str, changes: dict[str, Column], valid: Column | None = None) -> DataFrame:
    """Changes apply to columns that are there; the filter reads the changed values."""
    df = df.withColumns({c: e for c, e in changes.items() if c in df.columns})
    return one_per_key(df if valid is None else df.where(valid), key)


def _trimmed(*names: str) -> dict[str, Column]:
    return {n: F.trim(n) for n in names}


def _typed(kind: str, *names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("string").try_cast(kind) for n in names}


def clean_customers(df: DataFrame) -> DataFrame:
    return _cleaned(df, "customer_id", _trimmed("first_name", "last_name") | {"email": F.lower(F.trim("email"))}, F.col("email").isNotNull())


def clean_products(df: DataFrame) -> DataFrame:
    return _cleaned(df, "product_id", _trimmed("product_name", "category", "subcategory", "brand") | _typed("double", "price", "cost"), F.col("price") >= 0)


def clean_orders(df: DataFrame) -> DataFrame:
    return _cleaned(df, "order_id", _typed("double", "total_amount", "discount", "tax"), F.col("customer_id").isNotNull())


def clean_order_items(df: DataFrame) -> DataFrame:
    return _cleaned(df, "order_item_id", _typed("int", "quantity") | _typed("double", "unit_price", "discount"), F.col("quantity") > 0)


def clean_payments(df: DataFrame) -> DataFrame:
    return _cleaned(df, "payment_id", _typed("double", "amount"), F.col("amount") >= 0)


def clean_inventory(df: DataFrame) -> DataFrame:
    return _cleaned(df, "inventory_id", _typed("int", "quantity", "reserved_quantity"), F.col("quantity") >= 0)


def clean_website_events(df: DataFrame) -> DataFrame:
    return _cleaned(df, "event_id", {"event_type": F.upper(F.trim("event_type"))})


def clean_support_tickets(df: DataFrame) -> DataFrame:
    return _cleaned(df, "ticket_id", _trimmed("message") | {"category": F.lower(F.trim("category"))})


def clean_marketing_events(df: DataFrame) -> DataFrame:
    return _cleaned(df, "marketing_event_id", _typed("double", "cost"))


CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {entity: globals()[f"clean_{entity}"] for entity in KEYS}


def clean_all(entities: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: CLEANERS[name](df) for name, df in entities.items()}


def row_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """entity, rows_before and rows_after, counted in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), F.lit(side).alias("side"), "n") for side, dfs in (("b", before), ("a", after)) for name, df in dfs.items()]
    union = counts[0]
    for part in counts[1:]:
        union = union.unionByName(part)
    return union.groupBy("entity").agg(F.sum(F.when(F.col("side") == "b", F.col("n"))).alias("rows_before"), F.sum(F.when(F.col("side") == "a", F.col("n"))).alias("rows_after"))
