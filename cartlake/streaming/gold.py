"""Streaming marts by differences: work for a change does not grow with what its key holds.

Two stateful stages, joined by a stored stream. The first is keyed by (key, salt), where the salt is a hash of the row's
identifier, so a hot key is many states. It keeps each row's newest contribution; a change takes the old one off running
sums and puts the new one on. A last date that can be taken back is the greatest member of a counted set of times, held
as a tree of 64-way nodes (``Moments``): a change costs at most a path. Each batch tells one partial summary a (key, salt).
The second stage is keyed by key, holds the newest partial summary of each salt, adds them up and tells the mart's row.

Of changes to one row the one with the greatest (time, deletion, content) counts, whatever order they arrive in; what a
mart says of a key carries the time and operation of the newest change of any of its rows. Amounts are summed as whole
ten-thousandths. Queries must keep their name, state names and checkpoint to resume where they stopped. For batches that
touch many keys, ``kept`` makes the same marts faster.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
UNIT = 10_000  # parts of one that amounts are summed in
PROFILE = "profile"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
SALTS = 4
# State workers do not see the driver's module path, so this module's code travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Side:
    """What rows of one entity add to their key's summary.

    ``sums``: name -> columns whose product is added (none: one for each row); ``last``: name -> time column;
    ``distinct``: name -> column whose different values are counted (they also choose the salt).
    """

    ident: str
    sums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    last: dict[str, str] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)


def _amount(columns: tuple[str, ...]) -> Column:
    value = reduce(lambda a, b: a * b, (F.coalesce(F.col(c).cast("decimal(18,4)"), F.lit(0)) for c in columns), F.lit(1).cast("decimal(18,4)"))
    return F.round(value * UNIT).cast("long")


def tagged(key: str, profile: tuple[DataFrame, list[str]], sides: dict[str, tuple[DataFrame, Side]], salts: int = SALTS) -> DataFrame:
    """``key, salt, entity, id, op, ts_ms, body`` of all change streams of a mart; rows without the key go."""
    def part(df: DataFrame, entity: str, ident: str, salt: Column, body: Column) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), salt.cast("int").alias("salt"), F.lit(entity).alias("entity"), F.col(ident).cast("string").alias("id"), F.col("_op").alias("op"), F.col("_ts_ms").alias("ts_ms"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))

    about, columns = profile
    parts = [part(about, PROFILE, key, F.lit(-1), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)))]
    for entity, (df, side) in sides.items():
        body = F.struct(*(a for a in (
            F.struct(*(_amount(c).alias(n) for n, c in side.sums.items())).alias("sums") if side.sums else None,
            F.struct(*(F.unix_millis(F.col(c).cast("timestamp")).alias(n) for n, c in side.last.items())).alias("last") if side.last else None,
            F.struct(*(F.col(c).cast("string").alias(n) for n, c in side.distinct.items())).alias("distinct") if side.distinct else None,
        ) if a is not None))
        salt = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in (side.distinct.values() or [side.ident]))), F.lit(salts))
        parts.append(part(df, entity, side.ident, salt, body))
    return reduce(DataFrame.unionByName, parts)


class Moments:
    """A counted set of times in a map state: leaves count a time, inner nodes have a bit for each child that holds any."""

    BITS, LEVELS = 6, 8  # 48 bits: milliseconds of some 4,400 years on either side of 1970
    BIAS = 1 << 47

    def __init__(self, state) -> None:
        self.state, self.nodes, self.stored = state, {}, {}

    def _get(self, name: str, level: int, prefix: int) -> int:
        at = (name, level, prefix)
        if at not in self.nodes:
            self.nodes[at] = self.stored[at] = self.state.getValue(at)[0] & (1 << 64) - 1 if self.state.containsKey(at) else 0
        return self.nodes[at]

    def _put(self, name: str, level: int, prefix: int, value: int) -> None:
        self.nodes[name, level, prefix] = value

    def store(self) -> None:
        """Writes what one call has changed; nodes of zero go."""
        for at, value in self.nodes.items():
            if value == self.stored[at]:
                continue
            if value:
                self.state.updateValue(at, (value - (1 << 64) if value >> 63 else value,))
            else:
                self.state.removeKey(at)
        self.nodes, self.stored = {}, {}

    def _path(self, leaf: int) -> Iterator[tuple[int, int, int]]:
        """(level, prefix, bit of the child) from the leaf's parent up."""
        for level in range(self.LEVELS - 1, -1, -1):
            below = leaf >> self.BITS * (self.LEVELS - 1 - level)
            yield level, below >> self.BITS, 1 << (below & (1 << self.BITS) - 1)

    def add(self, name: str, moment: int) -> None:
        leaf = moment + self.BIAS
        n = self._get(name, self.LEVELS, leaf)
        self._put(name, self.LEVELS, leaf, n + 1)
        for level, prefix, bit in self._path(leaf) if not n else ():
            mask = self._get(name, level, prefix)
            self._put(name, level, prefix, mask | bit)
            if mask:
                return

    def remove(self, name: str, moment: int) -> None:
        leaf = moment + self.BIAS
        n = self._get(name, self.LEVELS, leaf)
        self._put(name, self.LEVELS, leaf, n - 1)
        if n > 1:
            return
        for level, prefix, bit in self._path(leaf):
            mask = self._get(name, level, prefix) & ~bit
            self._put(name, level, prefix, mask)
            if mask:
                return

    def last(self, name: str) -> int | None:
        prefix = 0
        for level in range(self.LEVELS):
            mask = self._get(name, level, prefix)
            if not mask:
                return None
            prefix = prefix << self.BITS | mask.bit_length() - 1
        return prefix - self.BIAS


PARTIAL = "key long, salt int, seq long, op string, ts_ms long, body string"
PARTIALS = [c.split()[0] for c in PARTIAL.split(", ")]


class Differences(StatefulProcessor):
    """The first stage: rows' contributions, and the running summary of a (key, salt)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "entity string, id string", "ts_ms long, deleted boolean, body string")
        self.summary = handle.getValueState("summary", "seq long, op string, ts_ms long, body string")
        self.moments = Moments(handle.getMapState("moments", "name string, level int, prefix long", "n long"))
        self.parts = handle.getMapState("parts", "name string, part string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = (change for part in rows for change in part[["entity", "id", "op", "ts_ms", "body"]].itertuples(index=False))
        yield pd.DataFrame([self.summarised(key, changes)], columns=PARTIALS, dtype=object)

    def summarised(self, key, changes: Iterable[tuple]) -> list:
        """The partial summary after these changes."""
        held = self.summary.get() if self.summary.exists() else None
        seq, op, ts, body = held if held is not None else (0, "", -(1 << 62), "{}")
        total = json.loads(body)
        newest: dict[tuple[str, str], tuple[int, bool, str]] = {}
        for entity, ident, its_op, its_ts, content in changes:
            change, at = (int(its_ts), its_op == "d", content), (entity, ident)
            newest[at] = max(newest.get(at, change), change)
            ts, op = max((ts, op), (int(its_ts), its_op))
        for at, change in newest.items():
            old = tuple(self.rows.getValue(at)) if self.rows.containsKey(at) else None
            if old is not None and change <= old:
                continue
            self.rows.updateValue(at, change)
            if at[0] == PROFILE:
                total["profile"] = None if change[1] else json.loads(change[2])
                continue
            if old is not None and not old[1]:
                self._put(total, json.loads(old[2]), -1)
            if not change[1]:
                self._put(total, json.loads(change[2]), 1)
        for name in total.get("last", ()):
            total["last"][name] = self.moments.last(name)
        self.moments.store()
        self.summary.update((seq + 1, op, ts, json.dumps(total)))
        return [int(key[0]), int(key[1]), seq + 1, op, ts, json.dumps(total)]

    def _put(self, total: dict, row: dict, sign: int) -> None:
        sums = total.setdefault("sums", {})
        for name, amount in row.get("sums", {}).items():
            sums[name] = sums.get(name, 0) + sign * (amount or 0)
        for name, moment in row.get("last", {}).items():
            total.setdefault("last", {})[name] = None
            if moment is not None:
                self.moments.add(name, moment) if sign > 0 else self.moments.remove(name, moment)
        for name, value in row.get("distinct", {}).items():
            if value is None:
                continue
            at = (name, value)
            n = self.parts.getValue(at)[0] if self.parts.containsKey(at) else 0
            self.parts.updateValue(at, (n + sign,)) if n + sign else self.parts.removeKey(at)
            sums[name] = sums.get(name, 0) + UNIT * ((n + sign > 0) - (n > 0))

    def close(self) -> None:
        pass


class RowDifferences(Differences):
    """The first stage over plain rows, as most keys have too few for a frame of each to be worth its making."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield Row(**dict(zip(PARTIALS, self.summarised(key, ((r.entity, r.id, r.op, r.ts_ms, r.body) for r in rows)), strict=True)))


class Merged(StatefulProcessor):
    """The second stage: the newest partial summary of each salt, added up; at most ``SALTS`` + 1 for a key."""

    def __init__(self, build: Callable[[int, dict, dict, dict], dict], columns: list[str]) -> None:
        self.build, self.columns = build, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.partials = handle.getMapState("partials", "salt int", "seq long, op string, ts_ms long, body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict[int, tuple] = {}
        for row in rows:
            newest[row.salt] = max(newest.get(row.salt, (-1,)), (row.seq, row.op, row.ts_ms, row.body))
        for salt, partial in newest.items():
            if not self.partials.containsKey((salt,)) or self.partials.getValue((salt,))[0] < partial[0]:
                self.partials.updateValue((salt,), partial)
        profile, sums, last, at = None, {}, {}, (-(1 << 62), "")
        for _, (_, op, ts, body) in self.partials.iterator():
            at, held = max(at, (ts, op)), json.loads(body)
            profile = held.get("profile", profile)
            for name, amount in held.get("sums", {}).items():
                sums[name] = sums.get(name, 0) + amount
            for name, moment in held.get("last", {}).items():
                last[name] = max((m for m in (last.get(name), moment) if m is not None), default=None)
        # A key without a profile is told as deleted, so that readers drop what an earlier batch said of it; where only one
        # of a key's rows is deleted, the key is updated.
        made = {self.columns[0]: int(key[0]), "_op": "d"} if profile is None else self.build(int(key[0]), profile, sums, last) | {"_op": "u" if at[1] == "d" else at[1]}
        made["_ts_ms"] = at[0]
        yield Row(**{c: made.get(c) for c in self.columns})

    def close(self) -> None:
        pass


def differences(changes: DataFrame) -> DataFrame:
    """The first stage over tagged changes."""
    return changes.groupBy("key", "salt").transformWithState(statefulProcessor=RowDifferences(), outputStructType=PARTIAL, outputMode="Append", timeMode="None")


def merged(partials: DataFrame, build: Callable[[int, dict, dict, dict], dict], schema: str) -> DataFrame:
    """The second stage over the first one's stored stream."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    return partials.groupBy("key").transformWithState(statefulProcessor=Merged(build, names), outputStructType=schema, outputMode="Update", timeMode="None")


def _money(sums: dict, name: str) -> float:
    return sums.get(name, 0) / UNIT


def _count(sums: dict, name: str) -> int:
    return sums.get(name, 0) // UNIT


def _moment(last: dict, name: str) -> datetime | None:
    return None if last.get(name) is None else EPOCH + timedelta(milliseconds=last[name])


# --- products ------------------------------------------------------------------------------------------------

PRODUCT = "product_id long, product_name string, category string, brand string, total_quantity_sold double, total_revenue double, total_discount double, order_count long, current_price double, current_inventory long, _op string, _ts_ms long"


PRODUCT_ABOUT = ("product_name", "category", "brand", "price", "inventory_quantity")
ITEM = Side("order_item_id", {"total_quantity_sold": ("quantity",), "total_revenue": ("quantity", "unit_price"), "total_discount": ("discount",)}, distinct={"order_count": "order_id"})


def product_changes(products: DataFrame, items: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """The first stage of product performance."""
    return differences(tagged("product_id", (products, list(PRODUCT_ABOUT)), {"item": (items, ITEM)}, salts))


def _product(key: int, profile: dict, sums: dict, last: dict) -> dict:
    return {"product_id": key, **{n: profile[n] for n in ("product_name", "category", "brand")}, **{n: _money(sums, n) for n in ("total_quantity_sold", "total_revenue", "total_discount")}, "order_count": _count(sums, "order_count"), "current_price": float(profile["price"] or 0), "current_inventory": int(float(profile["inventory_quantity"] or 0))}


def product_performance(partials: DataFrame) -> DataFrame:
    """A product's profile and the sums of its order items; nothing before the profile is there."""
    return merged(partials, _product, PRODUCT)


# --- customers -----------------------------------------------------------------------------------------------

CUSTOMER = "customer_id long, first_name string, last_name string, email string, country string, state string, city string, customer_segment string, total_orders long, total_spend double, total_payments double, website_event_count long, support_ticket_count long, marketing_impressions long, marketing_clicks long, marketing_conversions long, last_order_date timestamp, last_payment_date timestamp, last_website_event timestamp, customer_status string, _op string, _ts_ms long"
ABOUT = ["first_name", "last_name", "email", "country", "state", "city", "customer_segment"]
CUSTOMER_SIDES = {
    "order": Side("order_id", {"total_orders": (), "total_spend": ("total_amount",)}, {"last_order_date": "order_date"}),
    "payment": Side("payment_id", {"total_payments": ("amount",)}, {"last_payment_date": "transaction_timestamp"}),
    "web": Side("event_id", {"website_event_count": ()}, {"last_website_event": "event_timestamp"}),
    "ticket": Side("ticket_id", {"support_ticket_count": ()}),
    "marketing": Side("marketing_event_id", {f"marketing_{n}s": (n,) for n in ("impression", "click", "conversion")}),
}


def customer_changes(customers: DataFrame, orders: DataFrame, payments: DataFrame, web: DataFrame, tickets: DataFrame, marketing: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """The first stage of the customer view."""
    streams = {"order": orders, "payment": payments, "web": web, "ticket": tickets, "marketing": marketing}
    sides = {entity: (streams[entity], side) for entity, side in CUSTOMER_SIDES.items()}
    return differences(tagged("customer_id", (customers, ABOUT), sides, salts))


def _customer(key: int, profile: dict, sums: dict, last: dict) -> dict:
    n = _count(sums, "total_orders")
    counts = {c: _count(sums, c) for c in ("website_event_count", "support_ticket_count", "marketing_impressions", "marketing_clicks", "marketing_conversions")}
    status = "VIP" if n >= 10 else "ACTIVE" if n >= 5 else "CUSTOMER" if n >= 1 else "NEW"
    return {"customer_id": key, **profile, "total_orders": n, "total_spend": _money(sums, "total_spend"), "total_payments": _money(sums, "total_payments"), **counts, **{c: _moment(last, c) for c in ("last_order_date", "last_payment_date", "last_website_event")}, "customer_status": status}


def customer_360(partials: DataFrame) -> DataFrame:
    """A customer's profile, counters, sums and last dates; nothing before the profile is there; status by the number of orders."""
    return merged(partials, _customer, CUSTOMER)


# --- orders --------------------------------------------------------------------------------------------------

ORDER_PAYMENT = "order_id long, customer_id long, order_date timestamp, order_status string, payment_method string, total_amount double, discount double, tax double, payment_amount double, payment_status string, transaction_timestamp timestamp, payment_match boolean, _op string, _ts_ms long"


class OrderPayment(StatefulProcessor):
    """An order and the newest payment change of its key, one value each; a deletion clears its side."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {n: handle.getValueState(n, "ts_ms long, deleted boolean, body string, op string") for n in ("order", "payment")}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {n: tuple(s.get()) if s.exists() else None for n, s in self.sides.items()}
        before = dict(held)
        for row in rows:
            change = (row.ts_ms, row.op == "d", row.body, row.op)
            held[row.entity] = change if held[row.entity] is None else max(held[row.entity], change)
        for n, s in self.sides.items():
            if held[n] != before[n]:
                s.update(held[n])
        newest = max(h for h in held.values() if h is not None)
        order, payment = (json.loads(h[2]) if h is not None and not h[1] else None for h in (held["order"], held["payment"]))
        if order is None:
            made = {"order_id": key[0], "_op": "d", "_ts_ms": newest[0]}
        else:
            later = payment is not None and held["payment"][0] > held["order"][0]
            paid = payment or {}
            numbers = {n: None if v is None else float(v) for n, v in [*((n, order[n]) for n in ("total_amount", "discount", "tax")), ("payment_amount", paid.get("amount"))]}
            times = {n: None if v is None else EPOCH + timedelta(microseconds=v) for n, v in (("order_date", order["order_date"]), ("transaction_timestamp", paid.get("transaction_timestamp")))}
            made = {"order_id": key[0], "customer_id": None if order["customer_id"] is None else int(order["customer_id"]), "order_status": order["status"], "payment_method": order["payment_method"], "payment_status": paid.get("payment_status"), "payment_match": payment is not None, **numbers, **times, "_op": held["payment" if later else "order"][3], "_ts_ms": held["payment" if later else "order"][0]}
        yield Row(**{n: made.get(n) for n in (f.strip().split()[0] for f in ORDER_PAYMENT.split(","))})

    def close(self) -> None:
        pass


def order_payment(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with their payment; nothing before the order is there. State and work of an order are two rows."""
    def part(df: DataFrame, entity: str, columns: list[str], time: str) -> DataFrame:
        body = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns), F.unix_micros(F.col(time).cast("timestamp")).alias(time)), {"ignoreNullFields": "false"})
        return df.where(F.col("order_id").isNotNull()).select(F.col("order_id").cast("long").alias("key"), F.lit(entity).alias("entity"), F.col("_op").alias("op"), F.col("_ts_ms").alias("ts_ms"), body.alias("body"))

    both = part(orders, "order", ["customer_id", "status", "payment_method", "total_amount", "discount", "tax"], "order_date").unionByName(part(payments, "payment", ["amount", "payment_status"], "transaction_timestamp"))
    return both.groupBy("key").transformWithState(statefulProcessor=OrderPayment(), outputStructType=ORDER_PAYMENT, outputMode="Update", timeMode="None")


def customer_order_counters(orders: DataFrame) -> DataFrame:
    """Running counters for feeds that only insert: each row adds, a delete subtracts."""
    sign = F.when(F.col("_op") == "d", -1).otherwise(1)
    return orders.groupBy("customer_id").agg(F.sum(sign).alias("total_orders"), F.sum(sign * F.col("total_amount").cast("double")).alias("total_spend"))
