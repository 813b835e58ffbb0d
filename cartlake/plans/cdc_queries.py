"""Change capture, quality, freshness and serving as registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.functions.expressions import cdc_timestamp
from cartlake.operators import cdc, quality, serving, vectors
from cartlake.operators.star import Star
from cartlake.plans.registry import ORACLES, query, relation
from cartlake.plans.star_queries import profiles
from cartlake.sources.commerce import KEYS
from cartlake.streaming.runner import work_folder

def order_envelopes(orders: DataFrame) -> DataFrame:
    """A change log made from orders: reads, updates, stale updates, repeats, deletes and malformed rows."""
    t0 = F.unix_millis(F.col("order_date").cast("timestamp"))
    columns = ("order_id", "customer_id", "status", "total_amount")

    def envelope(op: str, ts: Column, *, amount: float = 0, status: Column | None = None, deleted: bool = False, wrapped: bool = True) -> Column:
        row = F.struct(*(F.col(c).cast("string").alias(c) for c in columns[:2]), (F.col("status") if status is None else status).alias("status"), (F.col("total_amount") + F.lit(amount).cast("decimal(18,2)")).cast("string").alias("total_amount"))
        none = F.lit(None).cast("struct<order_id:string>")
        body = F.struct(F.lit(op).alias("op"), ts.alias("ts_ms"), (row if deleted else none).alias("before"), (none if deleted else row).alias("after"))
        return F.to_json(F.struct(body.alias("payload")) if wrapped else body).alias("value")

    key, day = F.col("order_id"), 86_400_000
    parts = [
        orders.select(envelope("r", t0)),
        orders.where(key % 4 == 0).select(envelope("u", t0 + day, amount=10, status=F.lit("returned"))),
        orders.where(key % 8 == 0).select(envelope("u", t0 - 1000, amount=999, wrapped=False)),
        orders.where(key % 5 == 0).select(envelope("r", t0, wrapped=False)),
        orders.where(key % 20 == 0).select(envelope("d", t0 + 2 * day, deleted=True)),
        orders.where(key % 100 == 1).select(F.explode(F.array(*map(F.lit, ("no json", '{"payload": null}', '{"payload": {"ts_ms": 1, "after": {"order_id": "1"}}}', '{"payload": {"op": "x", "ts_ms": 1, "after": {"order_id": "1"}}}', '{"payload": {"op": "u", "ts_ms": 1, "after": null}}')))).alias("value")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def envelopes(rows, key: str):
    """An entity's rows as envelopes: a read of each, an update in upper case of every third, a delete of every seventh."""
    def envelope(op: str, ts: int, deleted: bool):
        row, none = F.struct(*(F.col(c).cast("string").alias(c) for c in rows.columns)), F.lit(None)
        return F.to_json(F.struct(F.lit(op).alias("op"), F.lit(ts).alias("ts_ms"), (row if deleted else none).alias("before"), (none if deleted else row).alias("after"))).alias("value")

    return rows.select(envelope("r", 1, False)).unionByName(rows.where(F.col(key) % 3 == 0).select(envelope("U", 2, False))).unionByName(rows.where(F.col(key) % 7 == 0).select(envelope("d", 3, True)))


DAY = 86_400_000
relation("order_times", "select *, epoch_ms(order_date) as t0 from src_orders")
relation("order_changes", f"""select order_id, customer_id, status, total_amount, 'r' as _op, t0 as _ts_ms from order_times
    union all select order_id, customer_id, 'returned', total_amount + 10, 'u', t0 + {DAY} from order_times where order_id % 4 = 0
    union all select order_id, customer_id, status, total_amount + 999, 'u', t0 - 1000 from order_times where order_id % 8 = 0
    union all select order_id, customer_id, status, total_amount, 'r', t0 from order_times where order_id % 5 = 0
    union all select order_id, customer_id, status, total_amount, 'd', t0 + {2 * DAY} from order_times where order_id % 20 = 0""")


def order_changes(c):
    return cdc.bronze_rows(order_envelopes(c.orders), "orders", cdc.ORDER_CHANGE).drop("_ingested_at")


query("cdc_bronze_rows", "select *, 'orders' as _source_table from order_changes", money=["total_amount"])(order_changes)
ENTITY_STAMPS = {"customers": [], "orders": ["order_date"], "payments": ["transaction_timestamp"], "website_events": ["event_timestamp"], "support_tickets": ["created_at"], "marketing_events": ["event_timestamp"]}
for _entity, _schema in cdc.CHANGES.items():
    _money = [n for n, k in _schema.items() if k.startswith("decimal")]
    _key = KEYS[_entity]
    _columns = ", ".join(_schema)
    query(f"cdc_typed_{_entity}", f"select {_columns}, op as _op, ts as _ts_ms from (select *, 'r' as op, 1 as ts from src_{_entity} union all select *, 'u', 2 from src_{_entity} where {_key} % 3 = 0 union all select *, 'd', 3 from src_{_entity} where {_key} % 7 = 0) e".replace("phone, ", "cast(null as varchar) as phone, " if _entity == "customers" else "phone, ").replace("shipping_country, shipping_state", "cast(null as varchar) as shipping_country, cast(null as varchar) as shipping_state").replace("category, message", "cast(null as varchar) as category, cast(null as varchar) as message"), money=_money, stamps=ENTITY_STAMPS.get(_entity, []), dates=["signup_date"] if _entity == "customers" else [])(
        lambda c, e=_entity, schema=_schema, key=_key: cdc.bronze_rows(envelopes(getattr(c, e), key), e, schema).drop("_ingested_at", "_source_table")
    )
query("cdc_parse_envelope", "select _op as op, count(*) as n, min(_ts_ms) as lo, max(_ts_ms) as hi from order_changes group by 1 union all select 'x', count(*), 1, 1 from order_times where order_id % 100 = 1 having count(*) > 0")(lambda c: cdc.select_image(cdc.parse_envelope(order_envelopes(c.orders), "order_id string")).groupBy("op").agg(F.count("*").alias("n"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")))
query("cdc_timestamp", "select order_id, case when order_id % 4 = 3 then null else epoch_ms(order_date) end as millis from src_orders")(
    lambda c: c.orders.select("order_id", F.when(F.col("order_id") % 4 == 0, F.unix_millis(F.col("order_date").cast("timestamp")).cast("string")).when(F.col("order_id") % 4 == 1, F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(F.col("order_id") % 4 == 2, F.concat(F.lit(" "), F.unix_millis(F.col("order_date").cast("timestamp")).cast("string"), F.lit(" "))).otherwise("abc").alias("t")).select("order_id", F.unix_millis(cdc_timestamp("t")).alias("millis"))
)
query("cdc_latest_per_key", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as rn from lineitem) x where rn = 1", stamps=["l_shipdate"], money=["l_quantity", "l_extendedprice"])(lambda c: cdc.latest_per_key(c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"), ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
query("cdc_incremental_slice", f"select order_id, _op, _ts_ms from order_changes where _ts_ms >= {915148800000 - 300000}")(lambda c: cdc.incremental_slice(order_changes(c), high_water=915148800000).select("order_id", "_op", "_ts_ms"))
STATE = "select order_id, customer_id, case when order_id % 4 = 0 then 'returned' else status end as status, total_amount + case when order_id % 4 = 0 then 10 else 0 end as total_amount, t0 + case when order_id % 4 = 0 then 86400000 else 0 end as _ts_ms from order_times where order_id % 20 <> 0"


def applied(c, **options):
    """The first third of the log as a snapshot, the rest applied to it, the late updates after deletes last."""
    changes = order_changes(c).drop("_source_table")
    first = cdc.bootstrap_current_state(changes.where("_op = 'r'"), ["order_id"])
    state = cdc.apply_changes(first, changes.where("_op <> 'r'"), ["order_id"], **options)
    late = c.orders.where("order_id % 40 = 0").select("order_id", "customer_id", "status", F.col("total_amount").alias("total_amount"), F.lit("u").alias("_op"), (F.unix_millis(F.col("order_date").cast("timestamp")) + 90_000_000).alias("_ts_ms"))
    return cdc.live(cdc.apply_changes(state, late, ["order_id"], **options))


query("cdc_apply_changes", STATE, money=["total_amount"])(applied)
query("cdc_apply_changes_plain_merge", STATE + " union all select order_id, customer_id, status, total_amount, t0 + 90000000 from order_times where order_id % 40 = 0", money=["total_amount"])(lambda c: applied(c, tombstones=False))
query("cdc_bootstrap_current_state", STATE, money=["total_amount"])(lambda c: cdc.bootstrap_current_state(order_changes(c).drop("_source_table"), ["order_id"], tombstones=False))
query("cdc_apply_unguarded", "select order_id, customer_id, status, total_amount + 999 as total_amount, t0 - 1000 as _ts_ms from order_times where order_id % 8 = 0 union all select order_id, customer_id, status, total_amount, t0 from order_times where order_id % 8 <> 0", money=["total_amount"])(
    lambda c: cdc.live(cdc.apply_changes(cdc.bootstrap_current_state(order_changes(c).drop("_source_table").where("_op = 'r'"), ["order_id"]), order_changes(c).drop("_source_table").where("_op = 'u' and order_id % 8 = 0 and total_amount > 0").join(c.orders.select("order_id", F.unix_millis(F.col("order_date").cast("timestamp")).alias("t0")), "order_id").where("_ts_ms < t0").drop("t0"), ["order_id"], guard=False))
)

# --- quality -------------------------------------------------------------------------------------------------

_SQL_RULE = {
    "not_null": "sum(case when {c} is null then 1 else 0 end)",
    "unique": "count({c}) - count(distinct {c})",
    "non_negative": "sum(case when {c} < 0 then 1 else 0 end)",
    "in_set": "sum(case when {c} not in ({v}) then 1 else 0 end)",
}
relation("dim_date_keys", "select distinct date_key, date_day from (select year(d) * 10000 + month(d) * 100 + day(d) as date_key, d as date_day from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from (select cast(min(order_date) as date) as lo, cast(max(order_date) as date) as hi from stg_orders) ends) days) keys")
_RULES_SQL = " union all ".join(f"select '{t}' as table_name, '{r.name}' as expectation, cast({_SQL_RULE[r.kind].format(c=r.column, v=', '.join(repr(v) for v in r.values))} as bigint) as broken, {_SQL_RULE[r.kind].format(c=r.column, v=', '.join(repr(v) for v in r.values))} = 0 as success from {'dim_date_keys' if t == 'dim_date' else t}" for t, rules in quality.STAR_RULES.items() for r in rules)
query("quality_rules", _RULES_SQL)(lambda c: quality.run_checked(c, work_folder(c.spark, "star"))[1])
query("quality_audit", " union all ".join(f"select '{run}' as run_id, table_name, expectation, success, timestamp '{at}' as checked_at from ({_RULES_SQL}) r" for run, at in (("run-1", "2001-08-05"), ("run-2", "2001-08-04"))), stamps=["checked_at"])(lambda c: _audited(c))


def _audited(c):
    """Verdicts of two runs, the first of them told twice."""
    _, verdicts = quality.run_checked(c, work_folder(c.spark, "star"))
    path = work_folder(c.spark, "audit")
    for run, at in (("run-1", "2001-08-03"), ("run-2", "2001-08-04"), ("run-1", "2001-08-05")):
        rows = quality.audit(verdicts, path, run_id=run, checked_at=F.lit(at).cast("timestamp_ntz"))
    return rows


query("quality_raw_lineitem_rules", "select 'lineitem' as table_name, 'unique(l_orderkey)' as expectation, count(l_orderkey) - count(distinct l_orderkey) as broken, false as success from lineitem union all select 'lineitem', 'in_set(l_returnflag)', sum(case when l_returnflag <> 'A' then 1 else 0 end), false from lineitem", money=["broken"])(lambda c: quality.run_expectations(c.table("lineitem"), "lineitem", [quality.Rule("unique", "l_orderkey"), quality.Rule("in_set", "l_returnflag", ("A",))]))
query("quality_relationships", "select 'fact_orders' as table_name, 'relationships(customer_id)' as expectation, count(*) as broken, count(*) = 0 as success from fact_orders f where not exists (select 1 from dim_customer d where d.customer_id = f.customer_id) union all select 'website_events', 'relationships(customer_id)', count(*), count(*) = 0 from src_website_events f where not exists (select 1 from dim_customer d where d.customer_id = f.customer_id)")(
    lambda c: quality.relationship(Star(c).model("fact_orders"), "customer_id", Star(c).model("dim_customer"), "customer_id", "fact_orders").unionByName(quality.relationship(c.website_events, "customer_id", Star(c).model("dim_customer"), "customer_id", "website_events"))
)
query("quality_singular_tests", "select 'negative_order_totals' as test, count(*) as broken, count(*) = 0 as success from fact_orders where total_amount < 0 union all select 'negative_payments', count(*), count(*) = 0 from fact_payments where amount < 0 union all select 'mismatches', count(*), count(*) = 0 from fact_orders where payment_match_status = 'MISMATCH'")(
    lambda c: quality.assert_empty(Star(c).model("fact_orders").where("total_amount < 0"), "negative_order_totals").unionByName(quality.assert_empty(Star(c).model("fact_payments").where("amount < 0"), "negative_payments")).unionByName(quality.assert_empty(Star(c).model("fact_orders").where("payment_match_status = 'MISMATCH'"), "mismatches"))
)
NOW = 996_624_000_000
query("quality_freshness", f"select 'orders' as table_name, max(_ts_ms) as newest_ms, round(({NOW} - max(_ts_ms)) / 60000.0, 2) as age_minutes, case when ({NOW} - max(_ts_ms)) / 60000.0 <= 1440 then 'FRESH' else 'STALE' end as status from order_changes union all select 'early', max(_ts_ms), round(({NOW} - max(_ts_ms)) / 60000.0, 2), 'STALE' from order_changes where _ts_ms < 900000000000 union all select 'customers', null, null, 'MISSING'", money=["age_minutes"])(lambda c: quality.freshness({"orders": order_changes(c), "early": order_changes(c).where("_ts_ms < 900000000000"), "customers": c.customers}, now_ms=NOW))
query("quality_table_age", "select 'orders' as table_name, 'order_date' as time_column, strftime(max(order_date), '%Y-%m-%d %H:%M:%S') as newest, count(*) as row_count from src_orders union all select 'products', null, null, count(*) from src_products")(lambda c: quality.table_age({"orders": c.orders, "products": c.products}).withColumn("newest", F.date_format(F.col("newest").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")))
query("quality_validate_layers", "select 'orders' as table_name, count(*) as row_count, 'OK' as status from src_orders union all select 'refunds', null, 'MISSING' union all select 'late_orders', count(*), 'EMPTY' from src_orders where order_id < 0")(lambda c: quality.validate_layers({"orders": c.orders, "late_orders": c.orders.where("order_id < 0")}, ["orders", "refunds", "late_orders"]))

# --- serving, knowledge --------------------------------------------------------------------------------------

query("serve_customer_360", "select customer_id, first_name, last_name, customer_segment, country, total_orders, total_spend, website_event_count, support_ticket_count, last_order_date from gold_customers", money=["total_spend"], stamps=["last_order_date"])(lambda c: serving.serve_customer_360(profiles(c)))
query("recent_turns", "select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn, role, text) as place from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as rn from conversations) x where rn <= 3")(lambda c: serving.recent_turns(c.table("conversations").select("conv_id", "turn", "role", "text"), 3))
query("chunk_windows", """select doc_id, cast(i as int) as chunk_index, substr(text, cast(i * 850 + 1 as bigint), 1000) as chunk from (select doc_id, text, unnest(generate_series(0, case when length(text) <= 1000 then 0 else cast(ceil((length(text) - 1000) / 850.0) as bigint) end)) as i from documents where length(text) > 0) x""")(lambda c: serving.chunk_windows(c.table("documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk"))
query("chunk_documents", """with l as (select doc_id as id, i, lines[i] as line, i = len(lines) as last from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents) d),
    h as (select *, regexp_matches(line, '^#{1,6} ') as head from l), s as (select *, sum(cast(head as int)) over (partition by id order by i) - first_value(cast(head as int)) over (partition by id order by i) as section from h),
    b as (select id, section, nullif(coalesce(max(case when head then regexp_extract(line, '^#{1,6} +(.*)$', 1) end), ''), '') as heading, coalesce(string_agg(line || case when last then '' else chr(10) end, '' order by i) filter (where not head), '') as body from s group by 1, 2),
    w as (select *, unnest(generate_series(0, case when length(body) <= 1000 then 0 else cast(ceil((length(body) - 1000) / 850.0) as bigint) end)) as n from b where trim(body) <> '')
    select id, cast('0x' || substr(sha256(cast(id as varchar) || '/' || cast(section as varchar) || ':' || cast(n as varchar)), 1, 15) as bigint) as chunk_id, cast(section as int) as section, heading, cast(n as int) as chunk_index, substr(body, cast(n * 850 + 1 as bigint), 1000) as chunk from w""")(lambda c: serving.chunk_documents(c.table("documents")))
query("vector_top_k", """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), q as (select * from v where vec_id % 50 = 0),
    s as (select q.vec_id as query_id, d.vec_id, list_sum(list_transform(range(1, 65), lambda i: q.e[i] * d.e[i])) / sqrt(list_sum(list_transform(q.e, lambda x: x * x))) / sqrt(list_sum(list_transform(d.e, lambda x: x * x))) as score from q, v d where d.vec_id <> q.vec_id)
    select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s where score >= 0.3) r where rank <= 5""", ratio=["score"])(lambda c: vectors.vector_top_k(c.table("embeddings").where("vec_id % 50 = 0"), c.table("embeddings")))


def indexed(c):
    """What an index with chosen probes finds of the exact answer, for all queries."""
    rows = c.table("embeddings")
    asked = rows.where("vec_id % 50 = 0")
    index = vectors.build_index(rows)
    found = vectors.search_index(index, asked, probes=vectors.choose_probes(index, asked, rows))
    return vectors.recall(found, vectors.vector_top_k(asked, rows)).select("wanted", (F.col("recall") >= 0.9).alias("enough"))


query("vector_index_recall", f"select count(*) as wanted, true as enough from ({ORACLES['vector_top_k']}) x")(indexed)
