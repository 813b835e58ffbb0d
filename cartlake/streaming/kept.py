"""The streaming marts over kept rows, by joins and aggregations only: for feeds whose batches touch many keys.

``gold`` goes from change to change in Python, with several calls to the state's server for each key; its work for a change does
not grow with what the key holds. Here a batch is merged into the newest rows of its buckets, and the marts of its keys
are added up again from those: work grows with the rows of the buckets that the batch falls into, at the speed of a scan.
Both give the same marts: of changes to one row the one with the greatest (time, deletion, content) counts, and a mart
carries the time and operation of the newest change of any of its rows. Last times are kept to the microsecond here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartlake.streaming import gold
from cartlake.streaming.gold import PROFILE, SALTS, UNIT, Side

ROW = ("key", "salt", "entity", "id")


@dataclass(frozen=True)
class Mart:
    """A mart of one key: columns of its profile, sides by entity, and what makes the columns that it shows of ``added``'s."""

    key: str
    about: tuple[str, ...]
    sides: dict[str, Side]
    shown: Callable[[], dict[str, Column]]
    salts: int = SALTS

    def _named(self) -> dict[str, str]:
        """Type of each value that a row may have."""
        sides = self.sides.values()
        return {c: "string" for c in self.about} | {n: "long" for s in sides for n in s.sums} | {n: "timestamp" for s in sides for n in s.last} | {n: "string" for s in sides for n in s.distinct}

    def rows(self, profile: DataFrame, **feeds: DataFrame) -> DataFrame:
        """``key, salt, entity, id, newest, at`` of all change streams; rows without the key go."""
        def part(df: DataFrame, entity: str, ident: str, salt: Column, values: dict[str, Column]) -> DataFrame:
            all_values = F.struct(*(values.get(n, F.lit(None)).cast(k).alias(n) for n, k in self._named().items()))
            newest = F.struct(F.col("_ts_ms").alias("ts_ms"), F.col("_op").eqNullSafe("d").alias("deleted"), all_values.alias("values"))
            return df.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("key"), salt.cast("int").alias("salt"), F.lit(entity).alias("entity"), F.col(ident).cast("string").alias("id"), newest.alias("newest"), F.struct(F.col("_ts_ms").alias("ts_ms"), F.col("_op").alias("op")).alias("at"))

        parts = [part(profile, PROFILE, self.key, F.lit(-1), {c: F.col(c) for c in self.about})]
        for entity, side in self.sides.items():
            values = {n: gold._amount(c) for n, c in side.sums.items()} | {n: F.col(c) for n, c in (side.last | side.distinct).items()}
            salt = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in (side.distinct.values() or [side.ident]))), F.lit(self.salts))
            parts.append(part(feeds[entity], entity, side.ident, salt, values))
        return reduce(DataFrame.unionByName, parts)

    def added(self, rows: DataFrame) -> DataFrame:
        """A row a key: its profile (``alive`` if there is one), sums, last times and numbers of different values of the rows that are not deleted, with ``at`` and ``seen`` of all."""
        def value(name: str) -> Column:
            return F.when(~F.col("newest.deleted"), F.col(f"newest.values.{name}"))

        sides = self.sides.values()
        about = {c: F.max(value(c)) for c in self.about}
        sums = {n: F.coalesce(F.sum(value(n)), F.lit(0)) for s in sides for n in s.sums}
        last = {n: F.max(value(n)) for s in sides for n in s.last}
        distinct = {n: UNIT * F.count_distinct(value(n)) for s in sides for n in s.distinct}
        alive = F.max(~F.col("newest.deleted") & (F.col("entity") == PROFILE))
        return rows.groupBy("key").agg(*(v.alias(n) for n, v in (about | sums | last | distinct).items()), alive.alias("alive"), F.max("at").alias("at"), F.max("seen").alias("seen"))

    def told(self, added: DataFrame) -> DataFrame:
        """The mart's rows. A key without a profile is told as deleted, so that readers drop what an earlier batch said of it."""
        op = F.when(~F.col("alive"), "d").when(F.col("at.op") == "d", "u").otherwise(F.col("at.op"))
        return added.select(F.col("key").alias(self.key), *(F.when(F.col("alive"), v).alias(n) for n, v in self.shown().items()), op.alias("_op"), F.col("at.ts_ms").alias("_ts_ms"))


@dataclass(frozen=True)
class KeptRows:
    """The newest rows at ``path``, in buckets by key and salt; the number of buckets must not change once there are rows.

    A batch writes its buckets whole into a folder of its own (``batch=n``), so a bucket lies in the newest batch that has it. A batch that
    is repeated after a stop reads what the batches before it left and writes its folder anew: it counts once. ``seen`` is the
    batch of a row's latest change.
    """

    spark: SparkSession
    path: str
    schema: StructType
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key", "salt"), F.lit(self.buckets)).cast("int")

    def _folders(self, batch_id: int) -> tuple[dict[int, str], list]:
        """Each bucket's folder of the newest batch up to ``batch_id``, and the folders that newer ones stand for."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_bucket=*")
        found: dict[int, list] = {}
        for status in at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or ():
            batch, bucket = (int(p.getName().split("=")[1]) for p in (status.getPath().getParent(), status.getPath()))
            if batch <= batch_id:
                found.setdefault(bucket, []).append((batch, status.getPath()))
        ordered = {b: sorted(versions, key=lambda v: v[0]) for b, versions in found.items()}
        return {b: v[-1][1].toString() for b, v in ordered.items()}, [path for v in ordered.values() for _, path in v[:-1]]

    def read(self, batch_id: int, buckets: set[int]) -> DataFrame | None:
        """The rows of these buckets after this batch; none if there are none."""
        folders = [f for b, f in self._folders(batch_id)[0].items() if b in buckets]
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders).drop("batch") if folders else None

    def merge(self, rows: DataFrame, batch_id: int) -> set[int]:
        """Puts a batch's rows into its buckets, where the newest of each row stays; the buckets, of which at most a number each comes to the driver."""
        for path in self._folders(batch_id - 1)[1]:
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        rows = rows.withColumn("_bucket", self.bucket())
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}
        old = self.read(batch_id - 1, touched)
        both = rows if old is None else old.unionByName(rows)
        newest = both.repartitionById(self.buckets, "_bucket").groupBy(*ROW, "_bucket").agg(*(F.max(c).alias(c) for c in ("newest", "at", "seen")))
        newest.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(f"{self.path}/batch={batch_id}")
        return touched

    def beside(self, touched: set[int], batch_id: int, salts: int) -> set[int]:
        """All buckets that the keys of a batch may have rows in."""
        if len(touched) == self.buckets:
            return touched
        keys = self.read(batch_id, touched).where(F.col("seen") == batch_id).select("key").distinct()
        salted = keys.select("key", F.explode(F.sequence(F.lit(-1), F.lit(salts - 1))).alias("salt"))
        return {r[0] for r in salted.select(self.bucket()).distinct().collect()}


def merging(mart: Mart, folder: str, buckets: int = 64) -> Callable[[DataFrame, int], DataFrame]:
    """What makes of a batch of a mart's ``rows`` the mart's rows of the keys in it."""
    def of_batch(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = batch.withColumn("seen", F.lit(batch_id).cast("long"))
        kept = KeptRows(batch.sparkSession, f"{folder}/kept", rows.schema, buckets)
        touched = kept.merge(rows, batch_id)
        held = kept.read(batch_id, kept.beside(touched, batch_id, mart.salts)) if touched else rows
        return mart.told(mart.added(held).where(F.col("seen") == batch_id))

    return of_batch


def _money(name: str) -> Column:
    return F.col(name).cast("double") / UNIT


def _count(name: str) -> Column:
    return F.expr(f"{name} div {UNIT}")


# --- products, customers ---------------------------------------------------------------------------------------

def _product() -> dict[str, Column]:
    stock = F.coalesce(F.col("inventory_quantity").cast("double").cast("long"), F.lit(0))
    return {n: F.col(n) for n in ("product_name", "category", "brand")} | {n: _money(n) for n in ("total_quantity_sold", "total_revenue", "total_discount")} | {"order_count": _count("order_count"), "current_price": F.coalesce(F.col("price").cast("double"), F.lit(0.0)), "current_inventory": stock}


def _customer() -> dict[str, Column]:
    counts = {n: _count(n) for n in ("total_orders", "website_event_count", "support_ticket_count", "marketing_impressions", "marketing_clicks", "marketing_conversions")}
    n = counts["total_orders"]
    status = F.when(n >= 10, "VIP").when(n >= 5, "ACTIVE").when(n >= 1, "CUSTOMER").otherwise("NEW")
    return {c: F.col(c) for c in gold.ABOUT} | counts | {c: _money(c) for c in ("total_spend", "total_payments")} | {c: F.col(c) for c in ("last_order_date", "last_payment_date", "last_website_event")} | {"customer_status": status}


PRODUCT = Mart("product_id", gold.PRODUCT_ABOUT, {"item": gold.ITEM}, _product)
CUSTOMER = Mart("customer_id", tuple(gold.ABOUT), gold.CUSTOMER_SIDES, _customer)


# --- orders ----------------------------------------------------------------------------------------------------


def order_payment(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with their payment; nothing before the order is there. The state of an order is its newest change and that of its payment, by Spark's own running maxima."""
    def change(columns: dict[str, Column]) -> Column:
        return F.struct(F.col("_ts_ms").alias("ts_ms"), F.col("_op").eqNullSafe("d").alias("deleted"), F.struct(*(v.alias(n) for n, v in columns.items())).alias("row"), F.col("_op").alias("op"))

    def columns(texts: tuple[str, ...], numbers: dict[str, str], time: str) -> dict[str, Column]:
        return {c: F.col(c).cast("string") for c in texts} | {n: F.col(c).cast("double") for n, c in numbers.items()} | {time: F.col(time).cast("timestamp")}

    order = change({"customer_id": F.col("customer_id").cast("long")} | columns(("status", "payment_method"), {c: c for c in ("total_amount", "discount", "tax")}, "order_date"))
    payment = change(columns(("payment_status",), {"payment_amount": "amount"}, "transaction_timestamp"))
    sides = [df.where(F.col("order_id").isNotNull()).select(F.col("order_id").cast("long").alias("order_id"), own.alias(name)) for df, name, own in ((orders, "order", order), (payments, "payment", payment))]
    held = sides[0].unionByName(sides[1], allowMissingColumns=True).groupBy("order_id").agg(F.max("order").alias("order"), F.max("payment").alias("payment"))
    ordered, paid = (F.col(n).isNotNull() & ~F.col(f"{n}.deleted") for n in ("order", "payment"))
    later = paid & (F.col("payment.ts_ms") > F.col("order.ts_ms"))
    shown = {n: F.col(f"order.row.{n}") for n in ("customer_id", "order_date", "status", "payment_method", "total_amount", "discount", "tax")} | {n: F.when(paid, F.col(f"payment.row.{n}")) for n in ("payment_amount", "payment_status", "transaction_timestamp")} | {"payment_match": paid}
    return held.select(
        "order_id", *(F.when(ordered, v).alias("order_status" if n == "status" else n) for n, v in shown.items()),
        F.when(~ordered, "d").when(later, F.col("payment.op")).otherwise(F.col("order.op")).alias("_op"),
        F.when(~ordered, F.greatest("order.ts_ms", "payment.ts_ms")).when(later, F.col("payment.ts_ms")).otherwise(F.col("order.ts_ms")).alias("_ts_ms"),
    )
