"""Cleaning, star schema, marts and reports as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlake.operators import cleaning, gold, reports
from cartlake.operators.star import Star
from cartlake.plans.registry import QUERIES, query, relation

# --- SQL relations of the star schema ------------------------------------------------------------------------

relation("stg_orders", "select order_id, customer_id, order_date, upper(status) as order_status, payment_method, total_amount, discount, tax from src_orders")
relation("stg_payments", "select payment_id, order_id, customer_id, amount, payment_method, upper(payment_status) as payment_status, transaction_timestamp from src_payments")
relation("dim_customer", "select customer_id, trim(first_name) as first_name, trim(last_name) as last_name, trim(first_name) || ' ' || trim(last_name) as customer_name, lower(trim(email)) as email, country, state, city, signup_date, customer_segment from src_customers")
relation("dim_product", "select product_id, product_name, category, subcategory, brand, price, cost, price - cost as unit_margin, case when price = 0 then 0.0 else round(cast(price - cost as double) / cast(price as double), 4) end as margin_pct, supplier_id, inventory_quantity from src_products")
# From the definitions: lines and payments of an order as rows of one list, of which each measure sums its own kind.
relation("order_lines", """select order_id, 'line' as kind, quantity as units, quantity * unit_price as value, discount as cut, null as stamp from src_order_items
    union all select order_id, 'payment', null, amount, null, transaction_timestamp from stg_payments""")
relation("fact_orders", """with totals as (select order_id, count(*) filter (where kind = 'line') as lines, sum(units) as units, sum(value) filter (where kind = 'line') as gross, sum(cut) as cut, sum(value) filter (where kind = 'payment') as paid, max(stamp) as stamp from order_lines group by order_id)
    select order_id, customer_id, cast(strftime(order_date, '%Y%m%d') as bigint) as date_key, order_date, order_status, payment_method, total_amount, discount as order_discount, tax, coalesce(lines, 0) as line_count, coalesce(units, 0) as item_quantity, coalesce(gross, 0) as gross_item_amount, coalesce(cut, 0) as item_discount_amount,
    coalesce(paid, 0) as payment_amount, stamp as last_payment_timestamp, coalesce(paid, 0) - total_amount as payment_variance, case when paid is null then 'NO_PAYMENT' when abs(paid - total_amount) <= 0.01 then 'MATCHED' else 'MISMATCH' end as payment_match_status from stg_orders left join totals using (order_id)""")
relation("fact_payments", "select p.payment_id, p.order_id, p.customer_id, year(p.transaction_timestamp) * 10000 + month(p.transaction_timestamp) * 100 + day(p.transaction_timestamp) as date_key, p.amount, p.payment_method, p.payment_status, p.transaction_timestamp, o.order_status, o.total_amount as order_total_amount from stg_payments p left join stg_orders o on o.order_id = p.order_id")
# From the definitions: what a customer did, as rows of one list, of which each measure counts its own kind.
relation("activity_rows", """select customer_id, 'visit' as kind, session_id, event_timestamp as stamp, null as is_open, null as minutes, null as shown, null as clicked, null as converted, null as cost from src_website_events
    union all select customer_id, 'ticket', null, null, upper(status) not in ('CLOSED', 'RESOLVED'), resolution_time_minutes, null, null, null, null from src_support_tickets
    union all select customer_id, 'contact', null, null, null, null, impression, click, conversion, cost from src_marketing_events""")
relation("fact_customer_activity", """select c.customer_id, count(*) filter (where kind = 'visit') as website_event_count, count(distinct session_id) as session_count, max(stamp) as last_website_event, count(*) filter (where kind = 'ticket') as support_ticket_count, count(*) filter (where is_open) as open_support_ticket_count, coalesce(avg(minutes), 0) as avg_resolution_time_minutes,
    count(*) filter (where shown) as marketing_impressions, count(*) filter (where clicked) as marketing_clicks, count(*) filter (where converted) as marketing_conversions, coalesce(sum(cost), 0) as marketing_cost from src_customers c left join activity_rows using (customer_id) group by c.customer_id""")
relation("mart_customer_value", """with sums as (select customer_id, count(order_id) as orders, sum(value) as value, max(bought) as bought, sum(paid) as paid, max(paid_at) as paid_at from (
        select customer_id, order_id, case when order_status in ('CANCELLED', 'CANCELED') then 0 else total_amount end as value, order_date as bought, null as paid, null as paid_at from fact_orders
        union all select customer_id, null, null, null, amount, transaction_timestamp from fact_payments) x group by customer_id)
    select customer_id, customer_name, email, country, state, city, customer_segment, coalesce(orders, 0) as total_orders, coalesce(value, 0) as lifetime_order_value, coalesce(paid, 0) as lifetime_payments, website_event_count, session_count, support_ticket_count, marketing_impressions, marketing_clicks, marketing_conversions,
    bought as last_order_date, paid_at as last_payment_date, case when orders >= 10 or value >= 5000 then 'HIGH_VALUE' when orders >= 3 or value >= 1000 then 'MEDIUM_VALUE' when orders > 0 then 'LOW_VALUE' else 'PROSPECT' end as customer_value_segment
    from dim_customer left join fact_customer_activity using (customer_id) left join sums using (customer_id)""")

# --- cleaning ------------------------------------------------------------------------------------------------

query("clean_customers", "select customer_id, trim(first_name) as first_name, trim(last_name) as last_name, lower(trim(email)) as email, country, state, city, signup_date, customer_segment from src_customers where email is not null", dates=["signup_date"])(lambda c: cleaning.clean_customers(c.customers).drop("phone"))
query("clean_products", "select product_id, trim(product_name) as product_name, trim(category) as category, trim(subcategory) as subcategory, trim(brand) as brand, cast(price as double) as price, cast(cost as double) as cost, supplier_id, inventory_quantity from src_products where price >= 0", money=["price", "cost"])(lambda c: cleaning.clean_products(c.products))
query("clean_orders", "select order_id, customer_id, order_date, status, payment_method, cast(total_amount as double) as total_amount, cast(discount as double) as discount, cast(tax as double) as tax from src_orders where customer_id is not null", money=["total_amount", "discount", "tax"], stamps=["order_date"])(lambda c: cleaning.clean_orders(c.orders).drop("shipping_country", "shipping_state"))
query("clean_order_items", "select order_item_id, order_id, product_id, quantity, unit_price, discount from src_order_items where quantity > 0", money=["quantity", "unit_price", "discount"])(lambda c: cleaning.clean_order_items(c.order_items))
query("clean_payments", "select payment_id, order_id, customer_id, amount, payment_method, payment_status, transaction_timestamp from src_payments where amount >= 0", money=["amount"], stamps=["transaction_timestamp"])(lambda c: cleaning.clean_payments(c.payments))
query("clean_inventory", "select inventory_id, product_id, warehouse_id, cast(quantity as int) as quantity, cast(reserved_quantity as int) as reserved_quantity from src_inventory where quantity >= 0")(lambda c: cleaning.clean_inventory(c.inventory))
query("clean_website_events", "select event_id, customer_id, session_id, upper(trim(event_type)) as event_type, product_id, event_timestamp from src_website_events", stamps=["event_timestamp"])(lambda c: cleaning.clean_website_events(c.website_events))
query("clean_support_tickets", "select ticket_id, customer_id, created_at, status, resolution_time_minutes from src_support_tickets", stamps=["created_at"])(lambda c: cleaning.clean_support_tickets(c.support_tickets).drop("category", "message"))
query("clean_marketing_events", "select marketing_event_id, campaign_id, customer_id, impression, click, conversion, cost, event_timestamp from src_marketing_events", money=["cost"], stamps=["event_timestamp"])(lambda c: cleaning.clean_marketing_events(c.marketing_events))
query("clean_lineitem_changes", "select l_orderkey, min(l_linenumber) as l_linenumber from lineitem group by 1")(lambda c: cleaning.one_per_key(c.table("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey"))
query("clean_all_counts", " union all ".join(f"select '{e}' as entity, (select count(*) from src_{e}) as rows_before, (select count(*) from src_{e}{w}) as rows_after" for e, w in (("customers", ""), ("products", " where price >= 0"), ("orders", ""), ("order_items", " where quantity > 0"), ("payments", " where amount >= 0"), ("inventory", " where quantity >= 0"), ("website_events", ""), ("support_tickets", ""), ("marketing_events", ""))))(lambda c: cleaning.row_counts(c.entities(), cleaning.clean_all(c.entities())))

# --- staging, dimensions, facts, mart ------------------------------------------------------------------------

query("stg_customers", "select customer_id, first_name, last_name, email, country, state, city, signup_date, customer_segment from dim_customer", dates=["signup_date"])(lambda c: Star(c).stg("customers").drop("phone", "created_at", "updated_at", "cdc_ts_ms"))
query("stg_products", "select product_id, product_name, category, subcategory, brand, price, cost, supplier_id, cast(inventory_quantity as bigint) as inventory_quantity from src_products", money=["price", "cost"])(lambda c: Star(c).stg("products").drop("created_at", "updated_at"))
query("stg_orders", "select * from stg_orders", money=["total_amount", "discount", "tax"], stamps=["order_date"])(lambda c: Star(c).stg("orders").drop("shipping_country", "shipping_state", "created_at", "updated_at"))
query("stg_order_items", "select * from src_order_items", money=["unit_price", "discount"])(lambda c: Star(c).stg("order_items"))
query("stg_payments", "select * from stg_payments", money=["amount"], stamps=["transaction_timestamp"])(lambda c: Star(c).stg("payments"))
query("stg_website_events", "select * from src_website_events", stamps=["event_timestamp"])(lambda c: Star(c).stg("website_events").drop("device", "browser", "ip_address"))
query("stg_support_tickets", "select ticket_id, customer_id, created_at, status, resolution_time_minutes from src_support_tickets", stamps=["created_at"])(lambda c: Star(c).stg("support_tickets").drop("category", "priority", "message"))
query("stg_marketing_events", "select marketing_event_id, campaign_id, customer_id, cast(impression as bigint) as impression, cast(click as bigint) as click, cast(conversion as bigint) as conversion, cost, event_timestamp from src_marketing_events", money=["cost"], stamps=["event_timestamp"])(lambda c: Star(c).stg("marketing_events").drop("campaign", "channel"))
query("dim_customer", "select * from dim_customer", dates=["signup_date"])(lambda c: Star(c).model("dim_customer").drop("phone", "created_at", "updated_at"))
query("dim_product", "select * from dim_product", money=["price", "cost", "unit_margin"], ratio=["margin_pct"])(lambda c: Star(c).model("dim_product").drop("created_at", "updated_at"))
query("dim_date", """select year(d) * 10000 + month(d) * 100 + day(d) as date_key, d as date_day, year(d) as year, quarter(d) as quarter, month(d) as month, strftime(d, '%B') as month_name, weekofyear(d) as week_of_year, day(d) as day_of_month, dayofweek(d) + 1 as day_of_week, strftime(d, '%A') as day_name, dayofweek(d) in (0, 6) as is_weekend
    from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from (select cast(min(order_date) as date) as lo, cast(max(order_date) as date) as hi from stg_orders) ends) days""", dates=["date_day"])(lambda c: Star(c).model("dim_date"))
query("fact_orders", "select * from fact_orders", money=["total_amount", "order_discount", "tax", "gross_item_amount", "item_discount_amount", "payment_amount", "payment_variance"], stamps=["order_date", "last_payment_timestamp"])(lambda c: Star(c).model("fact_orders").drop("shipping_country", "shipping_state", "created_at", "updated_at"))
query("fact_payments", "select * from fact_payments", money=["amount", "order_total_amount"], stamps=["transaction_timestamp"])(lambda c: Star(c).model("fact_payments"))
query("fact_customer_activity", "select * from fact_customer_activity", money=["avg_resolution_time_minutes", "marketing_cost"], stamps=["last_website_event"])(lambda c: Star(c).model("fact_customer_activity"))
query("mart_customer_value", "select * from mart_customer_value", money=["lifetime_order_value", "lifetime_payments"], stamps=["last_order_date", "last_payment_date"])(lambda c: Star(c).model("mart_customer_value"))

# --- gold marts ----------------------------------------------------------------------------------------------

ORDER_360 = "select c.*, coalesce(o.n, 0) as total_orders, coalesce(o.s, 0) as total_spend, coalesce(o.a, 0) as average_order_value, o.t as last_order_date from src_customers c left join (select customer_id, count(*) as n, sum(total_amount) as s, avg(cast(total_amount as double)) as a, max(order_date) as t from src_orders group by 1) o on o.customer_id = c.customer_id"
query("gold_customer_order_360", ORDER_360, money=["total_spend", "average_order_value"], stamps=["last_order_date"], dates=["signup_date"])(lambda c: gold.customer_order_360(c.customers.drop("phone"), c.orders))
query("gold_product_sales", "select p.*, coalesce(i.u, 0) as units_sold, coalesce(i.g, 0) as gross_sales from src_products p left join (select product_id, sum(quantity) as u, sum(quantity * unit_price) as g from src_order_items group by 1) i on i.product_id = p.product_id", money=["price", "cost", "gross_sales", "units_sold"])(lambda c: gold.product_sales(c.products, c.order_items))
query("gold_order_status_summary", "select status, count(*) as order_count, sum(total_amount) as total_revenue, avg(cast(total_amount as double)) as average_order_value from src_orders group by 1", money=["total_revenue", "average_order_value"])(lambda c: gold.order_status_summary(c.orders))
query("gold_order_payment_summary", """select o.order_id, o.customer_id, o.order_date, o.status as order_status, o.payment_method, o.total_amount, o.discount, o.tax, p.a as payment_amount, p.s as payment_status, p.t as last_payment_timestamp,
    case when p.a is null then 'NO_PAYMENT' when abs(p.a - o.total_amount) <= 0.01 then 'MATCHED' else 'MISMATCH' end as payment_match
    from src_orders o left join (select order_id, sum(amount) as a, max(transaction_timestamp) as t, max(payment_status) as s from src_payments group by 1) p on p.order_id = o.order_id""", money=["total_amount", "discount", "tax", "payment_amount"], stamps=["order_date", "last_payment_timestamp"])(lambda c: gold.order_payment_summary(c.orders, c.payments).drop("shipping_country", "shipping_state"))
relation("gold_products", """select p.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price as current_price, p.inventory_quantity as current_inventory, coalesce(s.q, 0) as total_quantity_sold, coalesce(s.r, 0) as total_revenue, coalesce(s.d, 0) as total_discount, coalesce(s.n, 0) as order_count
    from src_products p left join (select i.product_id, sum(i.quantity) as q, sum(i.quantity * i.unit_price) as r, sum(i.discount) as d, count(distinct i.order_id) as n from src_order_items i left join src_orders o on o.order_id = i.order_id where upper(coalesce(o.status, '')) not in ('CANCELLED', 'CANCELED') group by 1) s on s.product_id = p.product_id""")
query("gold_product_performance", "select * from gold_products", money=["current_price", "total_revenue", "total_discount", "total_quantity_sold"])(lambda c: gold.product_performance(c.products, c.order_items, c.orders))
relation("gold_customers", """select c.customer_id, c.first_name, c.last_name, c.email, c.country, c.state, c.city, c.customer_segment, coalesce(o.n, 0) as total_orders, coalesce(o.s, 0) as total_spend, coalesce(p.s, 0) as total_payments, coalesce(w.n, 0) as website_event_count, coalesce(s.n, 0) as support_ticket_count,
    coalesce(m.i, 0) as marketing_impressions, coalesce(m.c, 0) as marketing_clicks, coalesce(m.v, 0) as marketing_conversions, o.t as last_order_date, p.t as last_payment_date, w.t as last_website_event, case when coalesce(o.n, 0) > 0 then 'ACTIVE' else 'PROSPECT' end as customer_status from src_customers c
    left join (select customer_id, count(distinct order_id) as n, sum(total_amount) as s, max(order_date) as t from src_orders group by 1) o on o.customer_id = c.customer_id
    left join (select customer_id, sum(amount) as s, max(transaction_timestamp) as t from src_payments group by 1) p on p.customer_id = c.customer_id
    left join (select customer_id, count(*) as n, max(event_timestamp) as t from src_website_events group by 1) w on w.customer_id = c.customer_id
    left join (select customer_id, count(*) as n from src_support_tickets group by 1) s on s.customer_id = c.customer_id
    left join (select customer_id, sum(cast(impression as int)) as i, sum(cast(click as int)) as c, sum(cast(conversion as int)) as v from src_marketing_events group by 1) m on m.customer_id = c.customer_id""")


def profiles(c):
    return gold.customer_360(c.customers, c.orders, c.payments, c.website_events, c.support_tickets, c.marketing_events)


query("gold_customer_360", "select * from gold_customers", money=["total_spend", "total_payments"], stamps=["last_order_date", "last_payment_date", "last_website_event"])(profiles)

# --- reports -------------------------------------------------------------------------------------------------

query("q_executive_kpis", "select count(distinct order_id) as total_orders, sum(case when order_status in ('CANCELLED', 'CANCELED') then 0 else total_amount end) as total_revenue, avg(case when order_status not in ('CANCELLED', 'CANCELED') then cast(total_amount as double) end) as average_order_value, count(distinct customer_id) as purchasing_customers, sum(case when payment_match_status = 'MISMATCH' then 1 else 0 end) as payment_mismatch_orders from fact_orders", money=["total_revenue", "average_order_value", "payment_mismatch_orders"])(lambda c: reports.executive_kpis(Star(c).model("fact_orders")))
query("q_daily_revenue", "select cast(order_date as date) as order_date, count(distinct order_id) as orders, sum(total_amount) as revenue, avg(cast(total_amount as double)) as average_order_value from fact_orders where order_status not in ('CANCELLED', 'CANCELED') group by 1", money=["revenue", "average_order_value"], dates=["order_date"])(lambda c: reports.daily_revenue(Star(c).model("fact_orders")))
query("q_customer_segments", "select customer_value_segment, count(*) as customers, sum(lifetime_order_value) as lifetime_value, avg(cast(lifetime_order_value as double)) as avg_customer_value, avg(total_orders) as avg_orders from mart_customer_value group by 1", money=["lifetime_value", "avg_customer_value", "avg_orders"])(lambda c: reports.customer_segments(Star(c).model("mart_customer_value")))
query("q_top_customers", "select customer_id, customer_name, country, state, customer_segment, customer_value_segment, total_orders, lifetime_order_value, lifetime_payments, website_event_count, marketing_conversions, last_order_date from mart_customer_value order by lifetime_order_value desc, customer_id limit 100", money=["lifetime_order_value", "lifetime_payments"], stamps=["last_order_date"])(lambda c: reports.top_customers(Star(c).model("mart_customer_value")))
query("q_product_sales_report", "select p.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price, p.unit_margin, p.margin_pct, sum(i.quantity) as units_sold, sum(i.quantity * i.unit_price) as gross_revenue from dim_product p join src_order_items i on i.product_id = p.product_id group by all", money=["price", "unit_margin", "gross_revenue", "units_sold"], ratio=["margin_pct"])(lambda c: reports.product_sales_report(Star(c).model("dim_product"), Star(c).stg("order_items")))
query("q_payment_reconciliation", "select payment_match_status, count(*) as orders, sum(total_amount) as order_amount, sum(payment_amount) as payment_amount, sum(payment_variance) as payment_variance from fact_orders group by 1", money=["order_amount", "payment_amount", "payment_variance"])(lambda c: reports.payment_reconciliation(Star(c).model("fact_orders")))
query("q_marketing_support_by_segment", "select m.customer_value_segment, count(*) as customers, sum(a.website_event_count) as website_events, sum(a.session_count) as sessions, sum(a.support_ticket_count) as support_tickets, sum(a.open_support_ticket_count) as open_support_tickets, sum(a.marketing_impressions) as impressions, sum(a.marketing_clicks) as clicks, sum(a.marketing_conversions) as conversions, sum(a.marketing_cost) as marketing_cost from mart_customer_value m join fact_customer_activity a on a.customer_id = m.customer_id group by 1", money=["website_events", "sessions", "support_tickets", "open_support_tickets", "impressions", "clicks", "conversions", "marketing_cost"])(lambda c: reports.marketing_support_by_segment(Star(c).model("mart_customer_value"), Star(c).model("fact_customer_activity")))
query("q_orphan_check", "select 'orders.customer_id' as relation, (select count(*) from src_orders o where not exists (select 1 from src_customers c where c.customer_id = o.customer_id)) as orphans union all select 'order_items.order_id', (select count(*) from src_order_items i where not exists (select 1 from src_orders o where o.order_id = i.order_id)) union all select 'order_items.product_id', (select count(*) from src_order_items i where not exists (select 1 from src_products p where p.product_id = i.product_id)) union all select 'website_events.customer_id', (select count(*) from src_website_events w where not exists (select 1 from src_customers c where c.customer_id = w.customer_id))")(lambda c: reports.orphan_counts({"orders.customer_id": (c.orders, c.customers, "customer_id"), "order_items.order_id": (c.order_items, c.orders, "order_id"), "order_items.product_id": (c.order_items, c.products, "product_id"), "website_events.customer_id": (c.website_events, c.customers, "customer_id")}))
query("q_entity_counts", " union all ".join(f"select '{e}' as table_name, count(*) as row_count from src_{e}" for e in ("customers", "products", "orders", "order_items", "payments", "inventory", "website_events", "support_tickets", "marketing_events")))(lambda c: reports.entity_counts(c.entities()))
for _name, _entity, _column in (("q_order_status_distribution", "orders", "status"), ("q_payment_status_distribution", "payments", "payment_status"), ("q_event_type_distribution", "website_events", "event_type")):
    query(_name, f"select {_column} as value, count(*) as row_count from src_{_entity} group by 1")(lambda c, e=_entity, k=_column: reports.value_distribution(getattr(c, e), k))
query("q_top_spenders", "select c.customer_id, c.first_name, c.last_name, count(o.order_id) as total_orders, coalesce(sum(o.total_amount), 0) as total_spend from src_customers c left join src_orders o on o.customer_id = c.customer_id group by 1, 2, 3 order by total_spend desc, customer_id limit 10", money=["total_spend"])(lambda c: reports.top_spenders(c.customers, c.orders))
query("q_preview_orders", "select order_id, customer_id, total_amount from src_orders order by total_amount desc, order_id limit 20", money=["total_amount"])(lambda c: reports.preview(c.orders.select("order_id", "customer_id", "total_amount"), [F.desc("total_amount"), F.col("order_id")], 20))
query("q_metrics_aggregate", "select country, customer_segment, count(*) as customers, sum(total_orders) as orders, round(avg(total_orders), 2) as mean_orders from gold_customers where total_orders >= 2 and customer_segment in ('building', 'machinery') and website_event_count between 0 and 1000000 group by 1, 2 order by customers desc, country, customer_segment limit 100", money=["orders", "mean_orders"])(
    lambda c: reports.metrics_aggregate(profiles(c), allowed={"country", "customer_segment", "total_orders", "website_event_count"}, dims=["country", "customer_segment"], aggs={"customers": ("count", "*"), "orders": ("sum", "total_orders"), "mean_orders": ("avg", "total_orders")}, filters=[("total_orders", ">=", 2), ("customer_segment", "in", ["building", "machinery"]), ("website_event_count", "between", (0, 1_000_000))], order=[("customers", True)], limit=500)
)

__all__ = ["QUERIES", "profiles"]
