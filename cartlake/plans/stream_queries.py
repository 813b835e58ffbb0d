"""Streaming marts as registered queries: their final state against a batch answer in SQL.

Feeds hold creates, updates, stale updates, deletes and updates that come after a delete, of every entity.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.operators import cdc
from cartlake.plans.cdc_queries import order_changes, order_envelopes
from cartlake.plans.registry import query, relation
from cartlake.streaming import changes, gold, kept
from cartlake.streaming.runner import final_state, kept_state, streamed

#: Entity -> its identifier and what updates change: column -> SQL that both engines read.
FEEDS = {
    "customers": ("customer_id", {"customer_segment": "concat(customer_segment, '-new')"}),
    "products": ("product_id", {"price": "price + 1", "inventory_quantity": "inventory_quantity + 5"}),
    "orders": ("order_id", {"total_amount": "total_amount + 10", "status": "'returned'"}),
    "order_items": ("order_item_id", {"quantity": "quantity + 1", "discount": "discount + 0.5"}),
    "payments": ("payment_id", {"amount": "amount - 1", "payment_status": "'refunded'"}),
    "website_events": ("event_id", {}),
    "support_tickets": ("ticket_id", {"status": "'reopened'"}),
    "marketing_events": ("marketing_event_id", {"click": "not click"}),
}
#: Of each entity's rows: which, operation, time, whether as updated.
EVENTS = [("true", "r", 1000, False), ("{k} % 4 = 0", "u", 2000, True), ("{k} % 8 = 0", "u", 500, False), ("{k} % 5 = 1", "d", 3000, False), ("{k} % 10 = 1", "u", 2500, True)]

for entity, (k, edits) in FEEDS.items():
    replaced = f" replace ({', '.join(f'{sql} as {c}' for c, sql in edits.items())})" if edits else ""
    relation(f"feed_{entity}", " union all ".join(f"select *{replaced if edited else ''}, '{op}' as _op, {ts} as _ts_ms from src_{entity} where {which.format(k=k)}" for which, op, ts, edited in EVENTS))
    relation(f"live_{entity}", f"select * exclude (_op, _ts_ms) from (select *, row_number() over (partition by {k} order by _ts_ms desc) as rn from feed_{entity}) f where rn = 1 and _op <> 'd'")


def feed(c, entity: str) -> DataFrame:
    """An entity's change rows; the entity is read once."""
    k, edits = FEEDS[entity]
    rows, kinds = getattr(c, entity), dict(getattr(c, entity).dtypes)
    told = F.array(*(F.when(F.expr(which.format(k=k)), F.struct(F.lit(op).alias("_op"), F.lit(ts).cast("long").alias("_ts_ms"), F.lit(is_edited).alias("edited"))) for which, op, ts, is_edited in EVENTS))
    events = rows.withColumn("_event", F.explode(F.array_compact(told)))
    columns = (F.when(F.col("_event.edited"), F.expr(edits[n]).cast(kinds[n])).otherwise(F.col(n)).alias(n) if n in edits else F.col(n) for n in rows.columns)
    return events.select(*columns, "_event._op", "_event._ts_ms")


def newest_of(key: str, entities: list[str]) -> str:
    """The time and operation of the newest change of any of a key's rows; a deletion beside the profile's is an update."""
    union = " union all ".join(f"select {key}, _ts_ms, _op from feed_{e}" for e in entities)
    return f"select {key}, max(_ts_ms) as _ts_ms, case arg_max(_op, _ts_ms) when 'd' then 'u' else arg_max(_op, _ts_ms) end as _op from ({union}) u group by 1"


query("stream_order_rows", "select order_id, customer_id, status, total_amount, _op, _ts_ms, 'orders' as _source_table from order_changes", money=["total_amount"])(
    lambda c: streamed(c.spark, {"raw": order_envelopes(c.orders)}, partial(changes.stream_rows, entity="orders", schema=cdc.ORDER_CHANGE), "order_rows", mode="append").drop("batch", "_ingested_at")
)
query("stream_order_payment", """select o.order_id, o.customer_id, o.order_date, o.status as order_status, o.payment_method, o.total_amount, o.discount, o.tax, p.amount as payment_amount, p.payment_status, p.transaction_timestamp, p.payment_id is not null as payment_match,
    case when p._ts_ms > o._ts_ms then p._op else o._op end as _op, greatest(o._ts_ms, coalesce(p._ts_ms, 0)) as _ts_ms
    from (select * from (select *, row_number() over (partition by order_id order by _ts_ms desc) as rn from feed_orders) f where rn = 1 and _op <> 'd') o left join (select * from (select *, row_number() over (partition by order_id order by _ts_ms desc) as rn from feed_payments) f where rn = 1 and _op <> 'd') p on p.order_id = o.order_id""",
    money=["total_amount", "payment_amount", "discount", "tax"], stamps=["order_date", "transaction_timestamp"])(
    lambda c: final_state(c.spark, {"orders": feed(c, "orders"), "payments": feed(c, "payments")}, kept.order_payment, "order_id", "order_payment")
)
query("stream_product_performance", f"""select p.product_id, p.product_name, p.category, p.brand, coalesce(i.q, 0) as total_quantity_sold, coalesce(i.r, 0) as total_revenue, coalesce(i.d, 0) as total_discount, coalesce(i.n, 0) as order_count, p.price as current_price, p.inventory_quantity as current_inventory, t._op, t._ts_ms
    from live_products p left join (select product_id, sum(quantity) as q, sum(quantity * unit_price) as r, sum(discount) as d, count(distinct order_id) as n from live_order_items group by 1) i on i.product_id = p.product_id join ({newest_of('product_id', ['products', 'order_items'])}) t on t.product_id = p.product_id""", money=["total_quantity_sold", "total_revenue", "total_discount", "current_price"])(
    lambda c: kept_state(c.spark, {"profile": feed(c, "products"), "item": feed(c, "order_items")}, kept.PRODUCT, "product_performance")
)
query("stream_customer_360", f"""select c.customer_id, c.first_name, c.last_name, c.email, c.country, c.state, c.city, c.customer_segment, coalesce(o.n, 0) as total_orders, coalesce(o.s, 0) as total_spend, coalesce(p.s, 0) as total_payments, coalesce(w.n, 0) as website_event_count, coalesce(s.n, 0) as support_ticket_count,
    coalesce(m.i, 0) as marketing_impressions, coalesce(m.c, 0) as marketing_clicks, coalesce(m.v, 0) as marketing_conversions, o.t as last_order_date, p.t as last_payment_date, w.t as last_website_event, case when coalesce(o.n, 0) >= 10 then 'VIP' when coalesce(o.n, 0) >= 5 then 'ACTIVE' when coalesce(o.n, 0) >= 1 then 'CUSTOMER' else 'NEW' end as customer_status, t._op, t._ts_ms
    from live_customers c left join (select customer_id, count(*) as n, sum(total_amount) as s, max(order_date) as t from live_orders group by 1) o on o.customer_id = c.customer_id left join (select customer_id, sum(amount) as s, max(transaction_timestamp) as t from live_payments group by 1) p on p.customer_id = c.customer_id
    left join (select customer_id, count(*) as n, max(event_timestamp) as t from live_website_events group by 1) w on w.customer_id = c.customer_id left join (select customer_id, count(*) as n from live_support_tickets group by 1) s on s.customer_id = c.customer_id
    left join (select customer_id, sum(cast(impression as int)) as i, sum(cast(click as int)) as c, sum(cast(conversion as int)) as v from live_marketing_events group by 1) m on m.customer_id = c.customer_id join ({newest_of('customer_id', ['customers', 'orders', 'payments', 'website_events', 'support_tickets', 'marketing_events'])}) t on t.customer_id = c.customer_id""",
    money=["total_spend", "total_payments", "marketing_impressions", "marketing_clicks", "marketing_conversions"], stamps=["last_order_date", "last_payment_date", "last_website_event"])(
    lambda c: kept_state(c.spark, {name: feed(c, entity) for name, entity in (("profile", "customers"), ("order", "orders"), ("payment", "payments"), ("web", "website_events"), ("ticket", "support_tickets"), ("marketing", "marketing_events"))}, kept.CUSTOMER, "customer_360")
)
query("stream_customer_counters", "select customer_id, sum(case when _op = 'd' then -1 else 1 end) as total_orders, sum(case when _op = 'd' then -total_amount else total_amount end) as total_spend from order_changes group by 1", money=["total_orders", "total_spend"])(
    lambda c: final_state(c.spark, {"orders": order_changes(c)}, gold.customer_order_counters, "customer_id", "customer_counters")
)
