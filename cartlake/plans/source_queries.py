"""Sources and sinks as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlake.plans.registry import query
from cartlake.sources import tables
from cartlake.streaming.runner import work_folder

query("source_bucketed_parquet", "select c_custkey, c_name, c_mktsegment from customer")(lambda c: tables.read_bucketed_parquet(c.spark, f"{c.sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"))
query("source_conform", "select customer_id, cast(last_name as varchar) as last_name, cast(null as double) as churn_probability, 'new' as tier from src_customers")(lambda c: tables.conform(c.customers, {"customer_id": "long", "last_name": "string", "churn_probability": "double", "tier": "string"}, {"tier": "new"}))


def _landed(c):
    """A table landed as bronze, frozen and read again, without its ingestion time."""
    folder = work_folder(c.spark, "bronze")
    tables.land_bronze(c.table("supplier"), folder)
    return tables.read_frozen(c.spark, folder).drop("_ingestion_timestamp")


query("source_land_bronze", "select * from supplier", money=["s_acctbal"])(_landed)


def _exported(c):
    folder = work_folder(c.spark, "export")
    tables.export_features(c.orders.select("order_id", "customer_id", "status"), folder, ["order_id"])
    return c.spark.read.parquet(folder)


query("source_export_features", "select order_id, customer_id, status from src_orders")(_exported)
query("source_sequence", "select d.r_name, i.i as step from region d, (select unnest(range(1, 4)) as i) i")(lambda c: c.table("region").select("r_name", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("step")))
