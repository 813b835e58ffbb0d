"""Change data capture: parsing of change envelopes, newest change a key, and application to current state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPS = ("r", "c", "u", "d")
META = ("_op", "_ts_ms", "_ingested_at", "_source_table")


def parse_envelope(raw: DataFrame, image: str, value: str = "value") -> DataFrame:
    """``op, ts_ms, before, after`` of JSON envelopes, bare or within ``payload``; what cannot be parsed goes."""
    body = f"op string, ts_ms bigint, before struct<{image}>, after struct<{image}>"
    parsed = raw.select(F.from_json(value, StructType.fromDDL(f"payload struct<{body}>, {body}")).alias("j"))
    either = {n: F.coalesce(f"j.payload.{n}", f"j.{n}").alias(n) for n in ("op", "ts_ms", "before", "after")}
    return parsed.select(*either.values()).where(F.col("op").isNotNull())


def select_image(parsed: DataFrame) -> DataFrame:
    """Adds ``image``: what was before a delete, what is after any other change; changes without one go."""
    return parsed.withColumn("image", F.when(F.lower("op") == "d", F.col("before")).otherwise(F.col("after"))).where(F.col("image").isNotNull())


def validate_op(parsed: DataFrame) -> DataFrame:
    """Only reads, creates, updates and deletes; the operation in lower case."""
    return parsed.withColumn("op", F.lower("op")).where(F.col("op").isin(*OPS))


def typed_projection(df: DataFrame, schema: dict[str, str], prefix: str = "image") -> DataFrame:
    """The schema's columns out of ``image`` in its types; values that do not fit become null."""
    fields = [F.col(f"{prefix}.{n}").cast("string").try_cast(k).alias(n) for n, k in schema.items()]
    return df.select(*fields, F.col("op").alias("_op"), F.col("ts_ms").alias("_ts_ms"))


def stamp(df: DataFrame, entity: str, *, now: Column | None = None, processed: str | None = None) -> DataFrame:
    """Adds ingestion time and source table, and a processing time under the name ``processed`` if given."""
    moment = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    added = {"_ingested_at": moment, "_source_table": F.lit(entity)} | ({processed: moment} if processed else {})
    return df.withColumns(added)


def bronze_rows(raw: DataFrame, entity: str, schema: dict[str, str], *, now: Column | None = None) -> DataFrame:
    """Envelopes as typed change rows of an entity."""
    text_image = ", ".join(f"{n} string" for n in schema)
    return stamp(typed_projection(validate_op(select_image(parse_envelope(raw, text_image))), schema), entity, now=now)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The newest row of each key: by the order columns descending, nulls last, then by all other columns."""
    first = [c for c in (order or ["_ts_ms", "_ingested_at"]) if c in df.columns]
    ranked = [F.col(c).desc_nulls_last() for c in [*first, *(c for c in df.columns if c not in first and c not in keys)]]
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranked))).where("_place = 1").drop("_place")


def incremental_slice(changes: DataFrame, *, high_water: int, lookback_ms: int = 300_000) -> DataFrame:
    """Changes from a little before the high-water mark on; the comparison reaches the scan."""
    return changes.where(F.col("_ts_ms") >= max(0, high_water - lookback_ms))


def align_columns(target: DataFrame, changes: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Changes with only the target's columns, and the target's columns that they lack."""
    if missing := [c for c in (*keys, "_ts_ms", "_op") if c not in changes.columns]:
        raise ValueError(f"changes lack {missing}")
    kept = [c for c in changes.columns if c in target.columns or c == "_op"]
    return changes.select(*kept), [c for c in target.columns if c not in changes.columns and c != "_deleted"]


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], *, guard: bool = True, tombstones: bool = True) -> DataFrame:
    """Current state after the changes: newest change a key, against the row that is there.

    A change wins if its ``_ts_ms`` is not older than the row's (``guard``), or always (``guard=False``). Deleted keys
    stay as rows with ``_deleted`` so that late changes cannot bring them back; with ``tombstones=False`` they are
    removed, as in a plain merge. One aggregation, pre-combined on both sides, takes the place of a full outer join.
    """
    aligned, missing = align_columns(target, changes, keys)
    columns = [c for c in target.columns if c != "_deleted"]
    old = target.withColumn("_deleted", F.col("_deleted") if "_deleted" in target.columns else F.lit(False)).withColumn("_turn", F.lit(0))
    new = latest_per_key(aligned, keys).withColumn("_deleted", F.col("_op") == "d").withColumn("_turn", F.lit(1)).drop("_op")
    for name in missing:  # columns that changes do not carry keep the row's values
        new = new.withColumn(name, F.lit(None).cast(dict(target.dtypes)[name]))
    both = old.select(*columns, "_deleted", "_turn").unionByName(new.select(*columns, "_deleted", "_turn"))
    rest = [c for c in columns if c not in keys]
    age = F.coalesce("_ts_ms", F.lit(-(1 << 62))) if guard else F.lit(0)
    won = both.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_deleted", "_turn"), F.struct(age.alias("age"), "_turn")).alias("w"), *(F.max(F.when(F.col("_turn") == 0, F.col(n))).alias(f"_old_{n}") for n in missing))
    state = won.select(*keys, *((F.coalesce(f"w.{n}", f"_old_{n}") if n in missing else F.col(f"w.{n}")).alias(n) for n in rest), F.col("w._deleted").alias("_deleted"))
    state = state.select(*columns, "_deleted")
    return state if tombstones else state.where(~F.col("_deleted")).drop("_deleted")


def live(state: DataFrame) -> DataFrame:
    """Current state without tombstones."""
    return state.where(~F.col("_deleted")).drop("_deleted") if "_deleted" in state.columns else state


def bootstrap_current_state(changes: DataFrame, keys: list[str], *, tombstones: bool = True) -> DataFrame:
    """First state from a change log: the newest change of each key."""
    state = latest_per_key(changes, keys).withColumn("_deleted", F.col("_op") == "d").drop("_op")
    return state if tombstones else live(state)


def apply_all(targets: dict[str, DataFrame], changes: dict[str, DataFrame], keys: dict[str, str], marks: dict[str, int], store: Callable[[str, DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int], dict[str, str]]:
    """Each entity's stored state, the marks (moved where its changes arrived), and the errors of those that failed.

    ``store`` writes an entity's state and returns it as stored: what fails while it runs fails for that entity alone.
    """
    done, moved, failed = {}, dict(marks), {}
    for name, rows in changes.items():
        try:
            slice_ = incremental_slice(rows, high_water=marks.get(name, 0))
            key = [keys[name]]
            done[name] = store(name, apply_changes(targets[name], slice_, key) if name in targets else bootstrap_current_state(slice_, key))
            newest = slice_.agg(F.max("_ts_ms")).first()[0]
            moved[name] = max(marks.get(name, 0), newest or 0)
        except Exception as error:  # collected and reported by the caller
            failed[name] = str(error)
    return done, moved, failed


#: Columns and types of each entity's images; fixed by the tables that changes come from.
CHANGES: dict[str, dict[str, str]] = {
    "customers": {"customer_id": "long", "first_name": "string", "last_name": "string", "email": "string", "phone": "string", "country": "string", "state": "string", "city": "string", "signup_date": "date", "customer_segment": "string"},
    "products": {"product_id": "long", "product_name": "string", "category": "string", "subcategory": "string", "brand": "string", "price": "decimal(18,2)", "cost": "decimal(18,2)", "supplier_id": "long", "inventory_quantity": "long"},
    "orders": {"order_id": "long", "customer_id": "long", "order_date": "timestamp", "status": "string", "payment_method": "string", "total_amount": "decimal(18,2)", "discount": "decimal(18,2)", "tax": "decimal(18,2)", "shipping_country": "string", "shipping_state": "string"},
    "order_items": {"order_item_id": "long", "order_id": "long", "product_id": "long", "quantity": "long", "unit_price": "decimal(18,2)", "discount": "decimal(18,2)"},
    "payments": {"payment_id": "long", "order_id": "long", "customer_id": "long", "amount": "decimal(18,2)", "payment_method": "string", "payment_status": "string", "transaction_timestamp": "timestamp"},
    "inventory": {"inventory_id": "long", "product_id": "long", "warehouse_id": "long", "quantity": "long", "reserved_quantity": "long"},
    "website_events": {"event_id": "long", "customer_id": "long", "session_id": "string", "event_type": "string", "product_id": "long", "event_timestamp": "timestamp"},
    "support_tickets": {"ticket_id": "long", "customer_id": "long", "created_at": "timestamp", "status": "string", "resolution_time_minutes": "int", "category": "string", "message": "string"},
    "marketing_events": {"marketing_event_id": "long", "campaign_id": "long", "customer_id": "long", "impression": "boolean", "click": "boolean", "conversion": "boolean", "cost": "decimal(18,2)", "event_timestamp": "timestamp"},
}
ORDER_CHANGE = {"order_id": "long", "customer_id": "long", "status": "string", "total_amount": "decimal(18,2)"}
