"""The nine commerce entities over the driver's star-schema tables, as DataFrames and as SQL for the oracle.

Columns that the driver's data lacks are typed nulls. Event times are moved back so that they fall inside the range of
order dates; amounts are built in decimal steps so that no engine rounds a binary fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHIFT_DAYS = 8279
MONEY = "decimal(18,2)"


class Commerce:
    """Lazy frames of the entities of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def customers(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"), F.lit("Customer").alias("first_name"), F.substring("c_name", 10, 1 << 20).alias("last_name"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"), F.lit(None).cast("string").alias("phone"),
            F.col("n_name").alias("country"), F.col("r_name").alias("state"), F.col("n_name").alias("city"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int")).alias("signup_date"), F.lower("c_mktsegment").alias("customer_segment"),
        )

    @property
    def products(self) -> DataFrame:
        price, size = F.col("p_retailprice").cast(MONEY), F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.concat("p_type", F.lit("-"), (size % 5).cast("string")).alias("subcategory"), F.col("p_brand").alias("brand"),
            price.alias("price"), (price - size.cast(MONEY)).cast(MONEY).alias("cost"), (F.col("p_partkey") % 100).alias("supplier_id"), (size * 20).alias("inventory_quantity"),
        )

    @property
    def orders(self) -> DataFrame:
        key, zero = F.col("o_orderkey"), F.lit(0).cast(MONEY)
        return self.table("orders").select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "shipped").otherwise("cancelled").alias("status"), _method(key),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"), zero.alias("discount"), zero.alias("tax"), F.lit(None).cast("string").alias("shipping_country"), F.lit(None).cast("string").alias("shipping_state"),
        )

    @property
    def order_items(self) -> DataFrame:
        newest = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*(F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")))
        return self.table("lineitem").repartition("l_orderkey").withColumn("rn", F.row_number().over(newest)).where("rn = 1").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("unit_price"), (F.col("l_discount") * 100).cast(MONEY).alias("discount"),
        )

    @property
    def order_lines(self) -> DataFrame:
        """Order, product and quantity of ``order_items``. What its order names after the quantity cannot change them, so it is not exchanged."""
        newest = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*(F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))
        return self.table("lineitem").repartition("l_orderkey").withColumn("rn", F.row_number().over(newest)).where("rn = 1").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"))

    @property
    def payments(self) -> DataFrame:
        key = F.col("o_orderkey")
        short = F.when(key % 7 == 0, 1).otherwise(0).cast(MONEY)
        return self.table("orders").where(key % 10 != 0).select(
            key.alias("payment_id"), key.alias("order_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_totalprice").cast(MONEY) - short).cast(MONEY).alias("amount"), _method(key),
            F.when(key % 11 == 0, "failed").otherwise("success").alias("payment_status"), F.col("o_orderdate").alias("transaction_timestamp"),
        )

    @property
    def website_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").where(kind != "error").select(
            "event_id", F.col("user_id").alias("customer_id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("session_id"),
            F.when(kind == "view", "PRODUCT_VIEW").when(kind == "click", "PAGE_VIEW").when(kind == "purchase", "PURCHASE").otherwise("LOGIN").alias("event_type"), F.get_json_object("props", "$.k").cast("long").alias("product_id"), _shifted().alias("event_timestamp"),
        )

    @property
    def support_tickets(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").where("event_type = 'error'").select(
            key.alias("ticket_id"), F.col("user_id").alias("customer_id"), _shifted().alias("created_at"), F.when(key % 3 == 0, "open").when(key % 3 == 1, "in_progress").otherwise("resolved").alias("status"), F.floor("value").cast("int").alias("resolution_time_minutes"),
            F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("message"),
        )

    @property
    def marketing_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").where(kind.isin("view", "click", "purchase")).select(
            F.col("event_id").alias("marketing_event_id"), (F.col("event_id") % 20 + 1).alias("campaign_id"), F.col("user_id").alias("customer_id"), F.lit(True).alias("impression"), kind.isin("click", "purchase").alias("click"), (kind == "purchase").alias("conversion"), F.col("value").cast(MONEY).alias("cost"), _shifted().alias("event_timestamp"),
        )

    @property
    def inventory(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(key.alias("inventory_id"), key.alias("product_id"), (key % 10 + 1).alias("warehouse_id"), (size * 20).alias("quantity"), size.alias("reserved_quantity"))

    def entities(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in KEYS}


KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id", "inventory": "inventory_id", "website_events": "event_id", "support_tickets": "ticket_id", "marketing_events": "marketing_event_id"}


def _method(key):
    return F.when(key % 3 == 0, "credit_card").when(key % 3 == 1, "paypal").otherwise("debit_card").alias("payment_method")


def _shifted():
    return F.col("ts") - F.expr(f"interval {SHIFT_DAYS} days")


VIEWS = {
    "src_customers": """select c_custkey as customer_id, 'Customer' as first_name, substr(c_name, 10) as last_name, concat(lower(c_name), '@example.com') as email,
        n_name as country, r_name as state, n_name as city, (date '1995-01-01' + cast(c_custkey % 1500 as int)) as signup_date, lower(c_mktsegment) as customer_segment
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "src_products": """select p_partkey as product_id, p_name as product_name, p_type as category, concat(p_type, '-', cast(p_size % 5 as varchar)) as subcategory, p_brand as brand,
        cast(p_retailprice as decimal(18,2)) as price, cast(cast(p_retailprice as decimal(18,2)) - cast(p_size as decimal(18,2)) as decimal(18,2)) as cost,
        p_partkey % 100 as supplier_id, p_size * 20 as inventory_quantity from part""",
    "src_orders": """select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_date, case o_orderstatus when 'F' then 'completed' when 'O' then 'shipped' else 'cancelled' end as status,
        case o_orderkey % 3 when 0 then 'credit_card' when 1 then 'paypal' else 'debit_card' end as payment_method, cast(o_totalprice as decimal(18,2)) as total_amount,
        cast(0 as decimal(18,2)) as discount, cast(0 as decimal(18,2)) as tax from orders""",
    "src_order_items": """select l_orderkey * 10 + l_linenumber as order_item_id, l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity,
        cast(l_extendedprice as decimal(18,2)) as unit_price, cast(l_discount * 100 as decimal(18,2)) as discount from (select *, row_number() over (partition by l_orderkey, l_linenumber
        order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc, l_discount desc, l_tax desc) as rn from lineitem) x where rn = 1""",
    "src_payments": """select o_orderkey as payment_id, o_orderkey as order_id, o_custkey as customer_id,
        cast(cast(o_totalprice as decimal(18,2)) - case when o_orderkey % 7 = 0 then 1 else 0 end as decimal(18,2)) as amount,
        case o_orderkey % 3 when 0 then 'credit_card' when 1 then 'paypal' else 'debit_card' end as payment_method,
        case when o_orderkey % 11 = 0 then 'failed' else 'success' end as payment_status, o_orderdate as transaction_timestamp from orders where o_orderkey % 10 <> 0""",
    "src_website_events": """select event_id, user_id as customer_id, concat(cast(user_id as varchar), '-', cast(cast(ts as date) as varchar)) as session_id,
        case event_type when 'view' then 'PRODUCT_VIEW' when 'click' then 'PAGE_VIEW' when 'purchase' then 'PURCHASE' else 'LOGIN' end as event_type,
        cast(json_extract_string(props, '$.k') as bigint) as product_id, ts - interval '8279' day as event_timestamp from events where event_type <> 'error'""",
    "src_support_tickets": """select event_id as ticket_id, user_id as customer_id, ts - interval '8279' day as created_at,
        case event_id % 3 when 0 then 'open' when 1 then 'in_progress' else 'resolved' end as status, cast(floor(value) as int) as resolution_time_minutes from events where event_type = 'error'""",
    "src_marketing_events": """select event_id as marketing_event_id, event_id % 20 + 1 as campaign_id, user_id as customer_id, true as impression, event_type in ('click', 'purchase') as click,
        event_type = 'purchase' as conversion, cast(value as decimal(18,2)) as cost, ts - interval '8279' day as event_timestamp from events where event_type in ('view', 'click', 'purchase')""",
    "src_inventory": """select p_partkey as inventory_id, p_partkey as product_id, p_partkey % 10 + 1 as warehouse_id, p_size * 20 as quantity, p_size as reserved_quantity from part""",
}
