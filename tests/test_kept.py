"""Streaming marts over kept rows: the same as those by changes, what a batch touches, and restarts."""

from datetime import datetime

import pytest
from oracle import SMALL
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from cartlake.catalogue import QUERIES
from cartlake.plans.stream_queries import feed
from cartlake.sources.commerce import Commerce
from cartlake.streaming import gold, kept
from cartlake.streaming.runner import final_state, kept_state, work_folder


def told(df, *columns):
    return sorted(map(repr, df.select(*columns or df.columns).collect()))


def products(spark, least=0):
    c = Commerce(spark, SMALL)
    return {"profile": feed(c, "products").where(f"product_id < 30 and _ts_ms >= {least}"), "item": feed(c, "order_items").where(f"product_id < 30 and _ts_ms >= {least}")}


@pytest.mark.parametrize("name", ["stream_order_payment", "stream_product_performance", "stream_customer_360"])
def test_registered_marts_call_no_python_for_a_key(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("a call in Python for each key")

    monkeypatch.setattr(GroupedData, "transformWithState", never)
    assert QUERIES[name](spark, SMALL).count() > 100


def test_product_mart_is_that_by_changes(spark):
    feeds = products(spark)
    found = kept_state(spark, feeds, kept.PRODUCT, "kept_products")
    wanted = final_state(spark, {"products": feeds["profile"], "items": feeds["item"]}, gold.product_changes, "product_id", "changed_products", then=gold.product_performance)
    assert told(found, *wanted.columns) == told(wanted) and found.count() > 10


def test_order_mart_is_that_by_changes(spark):
    c = Commerce(spark, SMALL)
    feeds = {n: feed(c, n).where("order_id < 200") for n in ("orders", "payments")}
    found, wanted = (final_state(spark, feeds, mart, "order_id", "few_orders") for mart in (kept.order_payment, gold.order_payment))
    assert told(found, *wanted.columns) == told(wanted) and found.count() > 100


def test_orders_without_rows_to_tell_of(spark):
    """A payment before its order, an order that goes, null keys, and equal times: the deletion wins."""
    order = "order_id long, customer_id long, order_date timestamp, status string, payment_method string, total_amount double, discount double, tax double, _op string, _ts_ms long"
    day = datetime(2024, 1, 1)
    orders = [(1, 5, day, "a", "card", 2.0, None, 0.0, "c", 10), (2, 5, None, None, None, None, None, None, "c", 10), (2, 5, day, "x", "card", 1.0, 0.0, 0.0, "d", 10), (None, 5, day, "x", "card", 1.0, 0.0, 0.0, "c", 10)]
    payments = [(1, 7, 2.0, "ok", day, "c", 20), (3, 8, 1.0, "ok", day, "c", 1)]
    found = final_state(spark, {"orders": spark.createDataFrame(orders, order), "payments": spark.createDataFrame(payments, "order_id long, payment_id long, amount double, payment_status string, transaction_timestamp timestamp, _op string, _ts_ms long")}, kept.order_payment, "order_id", "kept_few").collect()
    assert [(r.order_id, r.payment_match, r.discount, r._ts_ms) for r in found] == [(1, True, None, 20)]


def test_customer_mart_resumes(spark):
    """What the second run adds to the first one's rows is what one run makes of all, also where changes arrive late."""
    c = Commerce(spark, SMALL)
    names = {"profile": "customers", "order": "orders", "payment": "payments", "web": "website_events", "ticket": "support_tickets", "marketing": "marketing_events"}
    changes = {n: feed(c, e).where("customer_id < 40") for n, e in names.items()}
    folder = work_folder(spark, "kept_resumed")
    kept_state(spark, {n: df.where("_ts_ms > 1000") for n, df in changes.items()}, kept.CUSTOMER, "kept_customers", files=2, folder=folder)
    found = kept_state(spark, {n: df.where("_ts_ms <= 1000") for n, df in changes.items()}, kept.CUSTOMER, "kept_customers", files=2, folder=folder)
    whole = kept_state(spark, changes, kept.CUSTOMER, "kept_at_once", files=2)
    assert told(found) == told(whole) and whole.count() > 20


def test_a_batch_writes_its_buckets_only_and_counts_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    each = kept.merging(kept.PRODUCT, folder, buckets=8)

    def batch(least, where):
        return kept.PRODUCT.rows(**{n: df.where(where) for n, df in products(spark, least).items()})

    def versions():
        return {b.name: sorted(int(f.parent.name[6:]) for f in tmp_path.glob(f"kept/batch=*/{b.name}")) for b in tmp_path.glob("kept/batch=*/_bucket=*")}

    each(batch(0, "_ts_ms <= 1000"), 0).collect()
    first = versions()
    late = batch(1500, "product_id = 4")
    once = told(each(late, 1))
    assert told(each(late, 1)) == once and len(once) == 1
    assert all(v[0] == 0 for v in versions().values()) and 0 < sum(1 in v for v in versions().values()) < len(first)
    each(batch(0, "product_id = 8"), 2).collect()
    assert all(len([n for n in v if n < 2]) == 1 for v in versions().values())
    assert told(each(batch(0, "false"), 3)) == []


def test_a_key_without_a_profile_is_told_as_deleted(spark, tmp_path):
    feeds = products(spark)
    each = kept.merging(kept.PRODUCT, f"file://{tmp_path}", buckets=4)
    found = each(kept.PRODUCT.rows(feeds["profile"].where("false"), item=feeds["item"].where("product_id = 3 and _ts_ms = 2000")), 0).collect()
    assert [(r.product_id, r._op, r.order_count, r._ts_ms) for r in found] == [(3, "d", None, 2000)]
    found = each(kept.PRODUCT.rows(feeds["profile"].where("product_id = 3"), item=feeds["item"].where("false")), 1).collect()
    assert len(found) == 1 and found[0]._op == "u" and found[0].order_count > 0


def test_feed_equals_the_union_of_its_events(spark):
    """The entity is read once; rows are those of the registered SQL."""
    df = feed(Commerce(spark, SMALL), "order_items")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {r._op: r["count"] for r in df.groupBy("_op").count().collect()}["r"] == Commerce(spark, SMALL).order_items.count()
    assert df.groupBy("order_item_id").agg(F.count("*").alias("n")).where("order_item_id % 8 = 0 and n < 3").count() == 0
