"""Data-quality rules, freshness and validation of tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cartlake.operators.star import build_star
from cartlake.sources.tables import record_run


@dataclass(frozen=True)
class Rule:
    """``kind`` is not_null, unique, non_negative or in_set."""

    kind: str
    column: str
    values: tuple = field(default=())

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column})"


def _broken(rule: Rule) -> Column:
    c = F.col(rule.column)
    if rule.kind == "not_null":
        return F.count(F.when(c.isNull(), 1))
    if rule.kind == "unique":
        return F.count(c) - F.countDistinct(c)
    if rule.kind == "non_negative":
        return F.count(F.when(c < 0, 1))
    if rule.kind == "in_set":
        return F.count(F.when(c.isNotNull() & ~c.isin(*rule.values), 1))
    raise ValueError(f"unknown rule {rule.kind}")


def run_expectations(df: DataFrame, table_name: str, rules: list[Rule]) -> DataFrame:
    """table_name, expectation, broken rows and success of each rule: one pass over the table; an empty table fails all."""
    totals = df.agg(F.count("*").alias("rows"), *(_broken(r).alias(f"r{i}") for i, r in enumerate(rules)))
    verdicts = F.array(*(F.struct(F.lit(r.name).alias("expectation"), F.col(f"r{i}").cast("long").alias("broken")) for i, r in enumerate(rules)))
    each = totals.select("rows", F.explode(verdicts).alias("v"))
    return each.select(F.lit(table_name).alias("table_name"), "v.expectation", "v.broken", ((F.col("v.broken") == 0) & (F.col("rows") > 0)).alias("success"))


#: Rules of the star schema; fixed values: table -> kind -> columns, or the accepted values of a column.
STAR_COLUMNS: dict[str, dict[str, tuple[str, ...] | dict[str, tuple[str, ...]]]] = {
    "dim_customer": {"not_null": ("customer_id", "email"), "unique": ("customer_id",)},
    "dim_product": {"not_null": ("product_id", "price"), "unique": ("product_id",), "non_negative": ("price", "cost", "inventory_quantity")},
    "dim_date": {"not_null": ("date_key", "date_day"), "unique": ("date_key", "date_day")},
    "fact_orders": {"not_null": ("order_id", "customer_id", "date_key"), "unique": ("order_id",), "non_negative": ("total_amount", "line_count", "item_quantity", "gross_item_amount"), "in_set": {"payment_match_status": ("MATCHED", "MISMATCH", "NO_PAYMENT")}},
    "fact_payments": {"not_null": ("payment_id", "order_id", "customer_id"), "unique": ("payment_id",), "non_negative": ("amount",)},
    "fact_customer_activity": {"not_null": ("customer_id",), "unique": ("customer_id",), "non_negative": ("website_event_count", "session_count", "support_ticket_count", "open_support_ticket_count", "marketing_impressions", "marketing_clicks", "marketing_conversions", "marketing_cost")},
    "mart_customer_value": {"not_null": ("customer_id", "customer_value_segment"), "unique": ("customer_id",), "non_negative": ("total_orders", "lifetime_order_value", "lifetime_payments"), "in_set": {"customer_value_segment": ("HIGH_VALUE", "MEDIUM_VALUE", "LOW_VALUE", "PROSPECT")}},
}
STAR_RULES: dict[str, list[Rule]] = {table: [Rule(kind, c, columns[c] if isinstance(columns, dict) else ()) for kind, columns in kinds.items() for c in columns] for table, kinds in STAR_COLUMNS.items()}


def write_checked(df: DataFrame, path: str, table_name: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Writes a table and gives it back as stored, with the verdicts of its rules.

    What counts rows is observed while the table is written, so it costs no pass of its own; uniqueness reads one stored
    column a rule, pre-aggregated by value.
    """
    seen = Observation(f"quality {table_name}")
    counted = [r for r in rules if r.kind != "unique"]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(_broken(r).alias(r.name) for r in counted)).write.mode("overwrite").parquet(path)
    stored, broken = df.sparkSession.read.schema(df.schema).parquet(path), dict(seen.get)
    for rule in rules:
        if rule.kind == "unique":
            again = stored.where(F.col(rule.column).isNotNull()).groupBy(rule.column).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
            broken[rule.name] = again.first()[0]
    verdicts = [(table_name, r.name, int(broken[r.name]), broken[r.name] == 0 and broken["rows"] > 0) for r in rules]
    return stored, df.sparkSession.createDataFrame(verdicts, "table_name string, expectation string, broken long, success boolean")


def run_checked(source, folder: str, rules: dict[str, list[Rule]] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The star's models, each stored once under ``folder`` and checked as it is written, and all verdicts."""
    verdicts = []

    def store(name: str, model: DataFrame) -> DataFrame:
        stored, found = write_checked(model, f"{folder}/{name}", name, (rules or STAR_RULES).get(name, []))
        verdicts.append(found)
        return stored

    return build_star(source, store=store), reduce(DataFrame.unionByName, verdicts)


def audit(verdicts: DataFrame, path: str, *, run_id: str, checked_at: Column | None = None) -> DataFrame:
    """The run's verdicts among those of all runs: run_id, table_name, expectation, success, checked_at; a repeated run replaces its own."""
    rows = verdicts.select(F.lit(run_id).alias("run_id"), "table_name", "expectation", "success", (F.current_timestamp() if checked_at is None else checked_at).alias("checked_at"))
    return record_run(rows, path)


def run_quality(tables: dict[str, DataFrame], rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """Verdicts of all rules; a table that is missing fails its rules."""
    parts = []
    for name, own in (rules or STAR_RULES).items():
        if name in tables:
            parts.append(run_expectations(tables[name], name, own))
        else:
            spark = next(iter(tables.values())).sparkSession
            parts.append(spark.createDataFrame([(name, r.name, None, False) for r in own], "table_name string, expectation string, broken long, success boolean"))
    return reduce(DataFrame.unionByName, parts)


def require_quality(verdicts: DataFrame) -> DataFrame:
    """Raises if a rule failed; the verdicts of a run are few."""
    if failed := [f"{r.table_name}: {r.expectation}" for r in verdicts.where("not success").toLocalIterator()]:
        raise ValueError(f"{len(failed)} rules failed: {failed[:10]}")
    return verdicts


def relationship(children: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Foreign-key test: non-null child keys without a parent."""
    keys = parents.select(F.col(parent_key).alias(key)).distinct()
    orphans = children.where(F.col(key).isNotNull()).join(keys, key, "left_anti")
    return orphans.agg(F.count("*").alias("broken")).select(F.lit(name).alias("table_name"), F.lit(f"relationships({key})").alias("expectation"), "broken", (F.col("broken") == 0).alias("success"))


def assert_empty(df: DataFrame, name: str) -> DataFrame:
    """A singular test: the rows that must not exist, counted."""
    return df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("test"), "broken", (F.col("broken") == 0).alias("success"))


def freshness(tables: dict[str, DataFrame | None], *, now_ms: int, max_age_min: int = 1440, column: str = "_ts_ms") -> DataFrame:
    """Age of each table's newest change; tables, columns or times that are missing are reported, not skipped."""
    parts = []
    for name, df in tables.items():
        if df is None or column not in df.columns:
            spark = next(d for d in tables.values() if d is not None).sparkSession
            parts.append(spark.createDataFrame([(name, None)], "table_name string, newest_ms long"))
        else:
            parts.append(df.agg(F.max(column).cast("long").alias("newest_ms")).select(F.lit(name).alias("table_name"), "newest_ms"))
    age = (F.lit(now_ms) - F.col("newest_ms")) / 60_000
    status = F.when(F.col("newest_ms").isNull(), "MISSING").when(age <= max_age_min, "FRESH").otherwise("STALE")
    return reduce(DataFrame.unionByName, parts).select("table_name", "newest_ms", F.round(age, 2).alias("age_minutes"), status.alias("status"))


def table_age(tables: dict[str, DataFrame], candidates: tuple[str, ...] = ("_ts_ms", "order_date", "transaction_timestamp", "event_timestamp", "created_at")) -> DataFrame:
    """The first time column that each table has, and its newest value as text."""
    parts = []
    for name, df in tables.items():
        found = next((c for c in candidates if c in df.columns), None)
        newest = F.max(found).cast("string") if found else F.lit(None).cast("string")
        parts.append(df.agg(newest.alias("newest"), F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), F.lit(found).cast("string").alias("time_column"), "newest", "row_count"))
    return reduce(DataFrame.unionByName, parts)


def validate_layers(tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """status of each required table: OK, EMPTY or MISSING."""
    spark = next(iter(tables.values())).sparkSession
    parts = [tables[n].agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count", F.when(F.col("row_count") > 0, "OK").otherwise("EMPTY").alias("status")) if n in tables else spark.createDataFrame([(n, None, "MISSING")], "table_name string, row_count long, status string") for n in required]
    return reduce(DataFrame.unionByName, parts)
