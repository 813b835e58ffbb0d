"""Streaming marts: state and work of a change, orders of arrival, and restarts from what a stopped run left."""

import json
import random
from datetime import datetime

import pandas as pd
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from cartlake.plans.stream_queries import feed
from cartlake.sources.commerce import Commerce
from cartlake.streaming import gold
from cartlake.streaming.runner import final_state, keyed_state, ran, stored_feed, work_folder


class Held:
    """State kept in a dictionary; counts how often it is asked."""

    def __init__(self):
        self.data, self.value, self.reads = {}, None, 0

    def exists(self):
        self.reads += 1
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.reads += 1
        return key in self.data

    def getValue(self, key):
        self.reads += 1
        return self.data[key]

    def updateValue(self, key, value):
        assert all(v is None or isinstance(v, bool | str) or -(1 << 63) <= v < 1 << 63 for v in value)
        self.data[key] = value

    def removeKey(self, key):
        del self.data[key]

    def iterator(self):
        self.reads += len(self.data)
        return iter(list(self.data.items()))


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held())

    getValueState = getMapState

    def reads(self):
        return sum(s.reads for s in self.states.values())


def started():
    processor, handle = gold.Differences(), Handle()
    processor.init(handle)
    return processor, handle


def told(processor, rows):
    frame = pd.DataFrame(rows, columns=["entity", "id", "op", "ts_ms", "body"])
    (out,) = processor.handleInputRows((1, 0), iter([frame]), None)
    return json.loads(out.iloc[0]["body"])


def row(amount, moment, order):
    return json.dumps({"sums": {"s": amount}, "last": {"t": moment}, "distinct": {"d": order}})


def test_work_of_a_change_does_not_grow():
    """State is read as often for a change of a key with four thousand rows as for one with forty."""
    reads = {}
    for n in (40, 4000):
        processor, handle = started()
        told(processor, [("x", str(i), "c", 1, row(1, 1_000 * i, str(i % 7))) for i in range(n)])
        for k, change in enumerate((("x", str(n - 1), "d", 2, row(1, 0, "0")), ("x", "3", "u", 2, row(5, 7, "9")), ("x", "new", "c", 2, row(5, 9, "9")))):
            before = handle.reads()
            told(processor, [change])
            reads.setdefault(k, []).append(handle.reads() - before)
    assert all(max(r) <= 60 and r[1] <= r[0] + 10 for r in reads.values()), reads


@pytest.mark.parametrize("seed", range(4))
def test_differences_equal_sums_over_the_newest_rows(seed):
    """Any order of arrival, repeats, null values and times before 1970 give the sums over what is newest."""
    rng = random.Random(seed)
    log = [("x", str(rng.randint(0, 8)), rng.choice("rcud"), rng.randint(0, 30), row(rng.choice([None, 0, 7, -3]), rng.choice([None, 5, 1 << 40, -(1 << 40), 86_400_000 * rng.randint(-9, 9)]), rng.choice([None, "a", "b", "c"]))) for _ in range(150)]
    newest = {}
    for _, ident, op, ts, body in log:
        newest[ident] = max(newest.get(ident, (-1,)), (ts, op == "d", body))
    rows = [json.loads(b) for _, gone, b in newest.values() if not gone]
    wanted = {"s": sum(r["sums"]["s"] or 0 for r in rows), "d": gold.UNIT * len({r["distinct"]["d"] for r in rows} - {None})}, max((r["last"]["t"] for r in rows if r["last"]["t"] is not None), default=None)
    for _ in range(3):
        rng.shuffle(log)
        processor, _ = started()
        at = 0
        while at < len(log):
            step = rng.randint(1, 20)
            found = told(processor, log[at : at + step])
            at += step
        assert ({k: found["sums"].get(k, 0) for k in wanted[0]}, found["last"]["t"]) == wanted


def test_moments_hold_no_node_that_is_empty():
    tree, rng, held = gold.Moments(Held()), random.Random(1), []
    for _ in range(2000):
        if held and rng.random() < 0.5:
            tree.remove("t", held.pop(rng.randrange(len(held))))
        else:
            held.append(rng.choice([rng.randint(-(1 << 41), 1 << 43), rng.randint(0, 50)]))
            tree.add("t", held[-1])
        assert tree.last("t") == max(held, default=None)
        if rng.random() < 0.3:
            tree.store()
    for moment in held:
        tree.remove("t", moment)
    tree.store()
    assert not tree.state.data


def test_salts_do_not_change_the_answer(spark):
    c = Commerce(spark, SMALL)
    changes = {"products": feed(c, "products").where("product_id < 30"), "items": feed(c, "order_items").where("product_id < 30")}
    found = [sorted(map(tuple, final_state(spark, changes, lambda salts=salts, **streams: gold.product_changes(**streams, salts=salts), "product_id", "salted", then=gold.product_performance).collect())) for salts in (1, 5)]
    assert found[0] == found[1] and len(found[0]) > 10


class Stopped(RuntimeError):
    pass


def stopping(df, folder, name):
    """Runs a stream until its second batch has been computed but not stored."""

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        if batch_id == 1:
            raise Stopped("in the middle")

    with pytest.raises(Exception, match="in the middle"):
        df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").queryName(name).trigger(availableNow=True).start().awaitTermination()


def held_state(spark, checkpoint, name, **options):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).options(**options).load()


def test_order_mart_resumes_after_a_stop_and_its_state_is_the_batch_answer(spark):
    """Stopped in its second batch and started again, the mart ends with the state and the rows of an undisturbed run."""
    c = Commerce(spark, SMALL)
    changes = {"orders": feed(c, "orders"), "payments": feed(c, "payments")}
    folder = work_folder(spark, "stopped")
    with keyed_state(spark):
        mart = gold.order_payment(**stored_feed(spark, changes, folder, 6))
        stopping(mart, folder, "stopped_orders")
        ran(mart, folder, name="stopped_orders")
        state = held_state(spark, f"{folder}/checkpoint", "order").select("key.key", "value.ts_ms", "value.deleted")
        newest = changes["orders"].groupBy(F.col("order_id").alias("key")).agg(F.max("_ts_ms").alias("ts_ms"), F.max_by(F.col("_op") == "d", "_ts_ms").alias("deleted"))
        assert sorted(map(tuple, state.collect())) == sorted(map(tuple, newest.collect()))
    whole = final_state(spark, changes, gold.order_payment, "order_id", "undisturbed")
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.join(rows.groupBy("order_id").agg(F.max("batch").alias("batch")), ["order_id", "batch"]).where("_op <> 'd'").drop("batch")
    assert sorted(map(repr, last.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_customer_mart_resumes_and_its_sums_are_the_batch_answer(spark):
    """Both stages start again from their checkpoints; the summaries in state add up to sums over the newest rows."""
    c = Commerce(spark, SMALL)
    names = {"customers": "customers", "orders": "orders", "payments": "payments", "web": "website_events", "tickets": "support_tickets", "marketing": "marketing_events"}
    changes = {n: feed(c, e) for n, e in names.items()}
    early = {n: df.where("_ts_ms <= 1000") for n, df in changes.items()}
    late = {n: df.where("_ts_ms > 1000 or _ts_ms is null") for n, df in changes.items()}
    folder = work_folder(spark, "resumed")
    final_state(spark, early, gold.customer_changes, "customer_id", "resumed", then=gold.customer_360, folder=folder, files=2)
    found = final_state(spark, late, gold.customer_changes, "customer_id", "resumed", then=gold.customer_360, folder=folder, files=2)
    whole = final_state(spark, changes, gold.customer_changes, "customer_id", "at_once", then=gold.customer_360, files=2)
    assert sorted(map(repr, found.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))
    with keyed_state(spark):
        state = held_state(spark, f"{folder}/first", "summary").select("key.key", F.get_json_object("value.body", "$.sums.total_spend").cast("decimal(38,0)").alias("s"))
        sums = {r.key: int(r.s or 0) for r in state.groupBy("key").agg(F.sum("s").alias("s")).collect()}
    live = changes["orders"].groupBy("order_id").agg(F.max_by(F.struct("customer_id", "total_amount", "_op"), "_ts_ms").alias("r")).where("r._op <> 'd'")
    wanted = {r.customer_id: int(r.s * gold.UNIT) for r in live.groupBy("r.customer_id").agg(F.sum("r.total_amount").alias("s")).collect()}
    assert {k: v for k, v in sums.items() if v} == wanted


def test_orders_without_rows_to_tell_of(spark):
    """A payment before its order, an order that goes, null keys, and equal times: the deletion wins."""
    order = "order_id long, customer_id long, order_date timestamp, status string, payment_method string, total_amount double, discount double, tax double, _op string, _ts_ms long"
    day = datetime(2024, 1, 1)
    orders = [(1, 5, day, "a", "card", 2.0, None, 0.0, "c", 10), (2, 5, None, None, None, None, None, None, "c", 10), (2, 5, day, "x", "card", 1.0, 0.0, 0.0, "d", 10), (None, 5, day, "x", "card", 1.0, 0.0, 0.0, "c", 10)]
    payments = [(1, 7, 2.0, "ok", day, "c", 20), (3, 8, 1.0, "ok", day, "c", 1)]
    found = final_state(spark, {"orders": spark.createDataFrame(orders, order), "payments": spark.createDataFrame(payments, "order_id long, payment_id long, amount double, payment_status string, transaction_timestamp timestamp, _op string, _ts_ms long")}, gold.order_payment, "order_id", "few").collect()
    assert [(r.order_id, r.payment_match, r.discount, r._ts_ms) for r in found] == [(1, True, None, 20)]


def test_moments_write_only_what_changed():
    """Looking up the last time writes nothing."""
    class Counted(Held):
        writes = 0

        def updateValue(self, key, value):
            self.writes += 1
            super().updateValue(key, value)

    tree = gold.Moments(Counted())
    tree.add("t", 1_000)
    tree.store()
    before = tree.state.writes
    assert tree.last("t") == 1_000
    tree.store()
    assert tree.state.writes == before == 9


def test_marts_are_told_by_rows(spark):
    """No frame is made for each key: a plan of each mart holds row-based stages only."""
    c = Commerce(spark, SMALL)
    with keyed_state(spark):
        feeds = stored_feed(spark, {"orders": feed(c, "orders"), "payments": feed(c, "payments")}, work_folder(spark, "rows"), 1)
        partials = gold.differences(gold.tagged("customer_id", (feeds["orders"], ["status"]), {"payment": (feeds["payments"], gold.Side("payment_id", {"s": ("amount",)}))}))
        plans = [df._jdf.queryExecution().analyzed().toString() for df in (gold.order_payment(**feeds), partials, gold.merged(partials, dict, "key long, _op string, _ts_ms long"))]
    assert all("TransformWithState" in p and "InPandas" not in p for p in plans), plans
