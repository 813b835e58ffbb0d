"""Churn features, labels, scores and their monitoring as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlake.operators import churn, monitoring, reports, serving
from cartlake.operators.star import Star
from cartlake.plans import recommend_queries
from cartlake.plans.registry import query, relation
from cartlake.plans.star_queries import profiles
from cartlake.sources.staging import staged
from cartlake.streaming.runner import work_folder

AS_OF = "2001-08-02"
relation("live_orders", "select * from src_orders where status <> 'cancelled'")
relation("profile_features", f"""select c.customer_id, date '{AS_OF}' as feature_date, c.customer_segment, c.country, c.state, date_diff('day', c.signup_date, date '{AS_OF}') as tenure_days, coalesce(date_diff('day', cast(o.t as date), date '{AS_OF}'), 9999) as days_since_last_order, coalesce(date_diff('day', cast(p.t as date), date '{AS_OF}'), 9999) as days_since_last_payment,
    coalesce(o.n, 0) as total_orders, coalesce(o.s, 0) as lifetime_order_value, coalesce(o.a, 0) as average_order_value, coalesce(p.s, 0) as lifetime_payments, coalesce(p.n, 0) as payment_count, coalesce(o.s, 0) - coalesce(p.s, 0) as payment_gap, a.website_event_count, a.session_count, a.support_ticket_count, a.open_support_ticket_count, a.avg_resolution_time_minutes, a.marketing_impressions, a.marketing_clicks, a.marketing_conversions, a.marketing_cost
    from dim_customer c left join fact_customer_activity a on a.customer_id = c.customer_id left join (select customer_id, count(*) as n, sum(total_amount) as s, avg(cast(total_amount as double)) as a, max(order_date) as t from fact_orders where order_status <> 'CANCELLED' group by 1) o on o.customer_id = c.customer_id
    left join (select customer_id, count(*) as n, sum(amount) as s, max(transaction_timestamp) as t from fact_payments group by 1) p on p.customer_id = c.customer_id""")
relation("training_dates", "select cast(unnest(generate_series(cast(date_trunc('month', lo) as date) + interval 6 month, hi - interval 60 day, interval 1 month)) as date) as d from (select cast(min(order_date) as date) as lo, cast(max(order_date) as date) as hi from live_orders) e")
relation("scoring_dates", "select cast(max(order_date) as date) as d from live_orders")


def panel_sql(dates: str) -> str:
    """Snapshots with windows by one range join for each table."""
    return f"""select concat(cast(s.customer_id as varchar), '_', strftime(s.d, '%Y%m%d')) as snapshot_id, s.*, coalesce(o.recency, 9999) as days_since_last_order, coalesce(o.o30, 0) as orders_30d, coalesce(o.o90, 0) as orders_90d, coalesce(o.o180, 0) as orders_180d, coalesce(o.r30, 0) as revenue_30d, coalesce(o.r90, 0) as revenue_90d, coalesce(o.r180, 0) as revenue_180d,
        case when o.o90 > 0 then cast(o.r90 as double) / o.o90 else 0 end as avg_order_value_90d, coalesce(p.n, 0) as payments_90d, coalesce(p.s, 0) as payment_amount_90d, coalesce(w.w30, 0) as website_events_30d, coalesce(w.w90, 0) as website_events_90d, coalesce(w.s30, 0) as sessions_30d, coalesce(t.n, 0) as support_tickets_90d,
        coalesce(m.i, 0) as marketing_impressions_90d, coalesce(m.c, 0) as marketing_clicks_90d, coalesce(m.v, 0) as marketing_conversions_90d, coalesce(m.k, 0) as marketing_cost_90d, case when o.o90 > 0 then o.o30 / (o.o90 / 3.0) else 0 end as order_frequency_ratio, case when o.r90 > 0 then cast(o.r30 as double) / (cast(o.r90 as double) / 3) else 0 end as revenue_frequency_ratio
        from (select c.customer_id, x.d, c.customer_segment, c.country, c.state, date_diff('day', c.signup_date, x.d) as tenure_days from src_customers c, {dates} x where c.signup_date <= x.d) s
        left join (select customer_id, d, count(distinct case when age < 30 then order_id end) as o30, count(distinct case when age < 90 then order_id end) as o90, count(distinct order_id) as o180, coalesce(sum(case when age < 30 then total_amount end), 0) as r30, coalesce(sum(case when age < 90 then total_amount end), 0) as r90, sum(total_amount) as r180, min(age) as recency
            from (select o.*, x.d, date_diff('day', cast(o.order_date as date), x.d) as age from live_orders o, {dates} x where cast(o.order_date as date) <= x.d and cast(o.order_date as date) > x.d - 180) a group by 1, 2) o on o.customer_id = s.customer_id and o.d = s.d
        left join (select customer_id, x.d, count(*) as n, sum(amount) as s from src_payments p, {dates} x where cast(transaction_timestamp as date) <= x.d and cast(transaction_timestamp as date) > x.d - 90 group by 1, 2) p on p.customer_id = s.customer_id and p.d = s.d
        left join (select customer_id, x.d, count(case when cast(event_timestamp as date) > x.d - 30 then 1 end) as w30, count(*) as w90, count(distinct case when cast(event_timestamp as date) > x.d - 30 then session_id end) as s30 from src_website_events w, {dates} x where cast(event_timestamp as date) <= x.d and cast(event_timestamp as date) > x.d - 90 group by 1, 2) w on w.customer_id = s.customer_id and w.d = s.d
        left join (select customer_id, x.d, count(*) as n from src_support_tickets t, {dates} x where cast(created_at as date) <= x.d and cast(created_at as date) > x.d - 90 group by 1, 2) t on t.customer_id = s.customer_id and t.d = s.d
        left join (select customer_id, x.d, sum(cast(impression as int)) as i, sum(cast(click as int)) as c, sum(cast(conversion as int)) as v, sum(cost) as k from src_marketing_events m, {dates} x where cast(event_timestamp as date) <= x.d and cast(event_timestamp as date) > x.d - 90 group by 1, 2) m on m.customer_id = s.customer_id and m.d = s.d"""


COLUMNS = ", ".join(churn.ORDER)
relation("training_panel", panel_sql("training_dates"))
relation("scoring_panel", panel_sql("scoring_dates"))
relation("training_set", f"select p.snapshot_id, p.customer_id, p.d as observation_date, {COLUMNS}, coalesce(f.n, 0) as future_orders_60d, case when coalesce(f.n, 0) = 0 then 1 else 0 end as churned from training_panel p left join (select customer_id, x.d, count(*) as n from live_orders o, training_dates x where cast(order_date as date) > x.d and cast(order_date as date) <= x.d + 60 group by 1, 2) f on f.customer_id = p.customer_id and f.d = p.d")
AMOUNTS = ["revenue_30d", "revenue_90d", "revenue_180d", "avg_order_value_90d", "payment_amount_90d", "marketing_cost_90d", "marketing_impressions_90d", "marketing_clicks_90d", "marketing_conversions_90d"]
RATIOS = ["order_frequency_ratio", "revenue_frequency_ratio"]

query("churn_customer_features", "select * from profile_features", dates=["feature_date"], money=["lifetime_order_value", "average_order_value", "lifetime_payments", "payment_gap", "avg_resolution_time_minutes", "marketing_cost", "marketing_impressions", "marketing_clicks", "marketing_conversions"])(lambda c: churn.customer_features(Star(c).model("dim_customer"), Star(c).model("fact_orders"), Star(c).model("fact_payments"), Star(c).model("fact_customer_activity"), as_of=F.lit(AS_OF).cast("date")))
query("churn_observation_dates", "select d as observation_date from training_dates", dates=["observation_date"])(lambda c: churn.observation_dates(churn.live_orders(c.orders)))
query("churn_snapshots", "select snapshot_id, customer_id, d as observation_date, customer_segment, country, state, tenure_days from training_panel", dates=["observation_date"])(lambda c: churn.snapshots(c.customers, churn.observation_dates(churn.live_orders(c.orders))))
query("churn_training_set", "select * from training_set", dates=["observation_date"], money=AMOUNTS, ratio=RATIOS)(lambda c: churn.churn_training_set(c))
query("churn_scoring_features", f"select customer_id, d as prediction_date, {COLUMNS} from scoring_panel", dates=["prediction_date"], money=AMOUNTS, ratio=RATIOS)(lambda c: churn.scoring_features(c))
query("churn_time_split", "select side, count(*) as row_count, count(distinct observation_date) as dates, sum(churned) as churned from (select t.*, case when observation_date < (select observation_date from (select observation_date, row_number() over (order by observation_date) as rn, count(*) over () as n from (select distinct observation_date from training_set) d) r where rn = least(greatest(cast(floor(n * 0.8) as int), 1), n - 1) + 1) then 'train' else 'test' end as side from training_set t) s group by 1", money=["churned"])(lambda c: _sides(c))


def _sides(c):
    sides = churn.time_split(churn.churn_training_set(c))
    parts = [df.agg(F.count("*").alias("row_count"), F.countDistinct("observation_date").alias("dates"), F.sum("churned").alias("churned")).withColumn("side", F.lit(n)) for n, df in zip(("train", "test"), sides, strict=True)]
    return parts[0].unionByName(parts[1]).select("side", "row_count", "dates", "churned")


#: A rule in a model's place, so that SQL can check what follows the model.
RULE = "case when days_since_last_order > 150 then 0.9 when days_since_last_order > 90 then 0.7 when orders_90d > 2 then 0.1 else 0.4 end"
relation("rule_scores", f"select customer_id, d as prediction_date, {RULE} as churn_probability, revenue_180d from scoring_panel")


def ruled(c):
    scored = churn.scoring_features(c).withColumn("churn_probability", F.expr(RULE).cast("double"))
    return churn.with_bands(scored).withColumn("model_version", F.lit("1"))


query("churn_bands", "select customer_id, prediction_date, churn_probability, case when churn_probability >= 0.5 then 1 else 0 end as churn_prediction, case when churn_probability >= 0.8 then 'CRITICAL' when churn_probability >= 0.6 then 'HIGH' when churn_probability >= 0.3 then 'MEDIUM' else 'LOW' end as risk_band, cast(revenue_180d as double) * churn_probability as revenue_at_risk from rule_scores", dates=["prediction_date"], money=["revenue_at_risk", "churn_probability"])(lambda c: ruled(c).select("customer_id", "prediction_date", "churn_probability", "churn_prediction", "risk_band", "revenue_at_risk"))
query("churn_classification_metrics", f"select tp, fp, tn, fn, cast(tp + tn as double) / (tp + fp + tn + fn) as accuracy, cast(tp as double) / (tp + fp) as precision, cast(tp as double) / (tp + fn) as recall, 2.0 * tp / (2 * tp + fp + fn) as f1 from (select sum(case when churned = 1 and p = 1 then 1 else 0 end) as tp, sum(case when churned = 0 and p = 1 then 1 else 0 end) as fp, sum(case when churned = 0 and p = 0 then 1 else 0 end) as tn, sum(case when churned = 1 and p = 0 then 1 else 0 end) as fn from (select churned, case when {RULE} >= 0.5 then 1 else 0 end as p from training_set) x) y", ratio=["accuracy", "precision", "recall", "f1"], money=["tp", "fp", "tn", "fn"])(lambda c: churn.classification_metrics(churn.churn_training_set(c).withColumn("churn_prediction", (F.expr(RULE) >= 0.5).cast("int"))))
relation("rule_labels", f"select churned, cast({RULE} as double) as p from training_set")
query("churn_areas", """with g as (select p, sum(churned) as pos, count(*) - sum(churned) as neg from rule_labels group by 1), a as (select *, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp from g)
    select cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives, sum(neg * (tp - pos / 2.0)) / sum(pos) / sum(neg) as roc_auc, sum(pos * (cast(tp as double) / (tp + fp))) / sum(pos) as pr_auc from a""", ratio=["roc_auc", "pr_auc"])(lambda c: churn.area_metrics(churn.churn_training_set(c).withColumn("churn_probability", F.expr(RULE).cast("double"))))
query("churn_class_report", """with k as (select churned as y, case when p >= 0.5 then 1 else 0 end as g from rule_labels), r as (select cast(c.c as varchar) as class, cast(count(*) filter (where y = c.c and g = c.c) as double) as hit, count(*) filter (where g = c.c) as given, count(*) filter (where y = c.c) as support from k, (select unnest([0, 1]) as c) c group by 1),
    e as (select class, case when given > 0 then hit / given else 0 end as precision, case when support > 0 then hit / support else 0 end as recall, support from r), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from e)
    select class, precision, recall, f1, support from f union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support) from f union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from f""", ratio=["precision", "recall", "f1"], money=["support"])(
    lambda c: churn.class_report(churn.churn_training_set(c).withColumn("churn_prediction", (F.expr(RULE) >= 0.5).cast("int")))
)
query("churn_validate_predictions", "select count(*) as row_count, 0 as invalid, count(*) - count(distinct customer_id) as duplicates from rule_scores")(lambda c: monitoring.validate_churn_predictions(ruled(c)))
query("churn_monitor", "select timestamp '2001-08-03' as monitored_at, 'PASS' as status, count(*) as prediction_count, (select count(*) from scoring_panel) as feature_count, cast(count(distinct customer_id) as double) / (select count(distinct customer_id) from scoring_panel) as prediction_coverage, avg(churn_probability) as avg_churn_probability, min(churn_probability) as min_churn_probability, max(churn_probability) as max_churn_probability, avg(case when churn_probability >= 0.5 then 1.0 else 0.0 end) as predicted_churn_rate, sum(cast(revenue_180d as double) * churn_probability) as revenue_at_risk, sum(case when churn_probability < 0.3 then 1 else 0 end) as low_risk_customers, sum(case when churn_probability >= 0.3 and churn_probability < 0.6 then 1 else 0 end) as medium_risk_customers, sum(case when churn_probability >= 0.6 and churn_probability < 0.8 then 1 else 0 end) as high_risk_customers, sum(case when churn_probability >= 0.8 then 1 else 0 end) as critical_risk_customers, 0 as invalid_probability_count, count(*) - count(distinct customer_id) as duplicate_customer_count, 'rule' as model_name, '1' as model_version, 'champion' as model_alias, '[]' as validation_errors from rule_scores",
    ratio=["prediction_coverage", "avg_churn_probability", "min_churn_probability", "max_churn_probability", "predicted_churn_rate"], money=["revenue_at_risk", "low_risk_customers", "medium_risk_customers", "high_risk_customers", "critical_risk_customers"], stamps=["monitored_at"])(
    lambda c: monitoring.monitor_churn(ruled(c).withColumns({"model_name": F.lit("rule"), "model_alias": F.lit("champion")}), churn.scoring_features(c), monitored_at=F.lit("2001-08-03").cast("timestamp_ntz"))
)


def _loaded(c):
    """Rule scores stored, loaded twice into the same table and read from it."""
    source, target = work_folder(c.spark, "scores"), work_folder(c.spark, "predictions")
    ruled(c).select("customer_id", "prediction_date", "churn_probability", "churn_prediction", "risk_band", "revenue_180d", "revenue_at_risk", F.lit("rule").alias("model_name"), "model_version").write.parquet(source)
    churn.load_predictions(c.spark, source, target)
    return churn.load_predictions(c.spark, source, target)


query("churn_loaded_predictions", "select customer_id, prediction_date, churn_probability, case when churn_probability >= 0.5 then 1 else 0 end as churn_prediction, case when churn_probability >= 0.8 then 'CRITICAL' when churn_probability >= 0.6 then 'HIGH' when churn_probability >= 0.3 then 'MEDIUM' else 'LOW' end as risk_band, revenue_180d, cast(revenue_180d as double) * churn_probability as revenue_at_risk, 'rule' as model_name, '1' as model_version, 'champion' as model_alias from rule_scores", dates=["prediction_date"], money=["revenue_180d", "revenue_at_risk", "churn_probability"])(_loaded)
query("serve_churn", "select customer_id, prediction_date, churn_probability, case when churn_probability >= 0.5 then 1 else 0 end as churn_prediction, case when churn_probability >= 0.8 then 'CRITICAL' when churn_probability >= 0.6 then 'HIGH' when churn_probability >= 0.3 then 'MEDIUM' else 'LOW' end as risk_band, cast(revenue_180d as double) * churn_probability as revenue_at_risk from rule_scores", dates=["prediction_date"], money=["revenue_at_risk", "churn_probability"])(lambda c: serving.serve_churn(ruled(c)))
query("q_customer_metrics", "select g.customer_segment, g.country, g.total_orders, g.total_spend, g.website_event_count, g.support_ticket_count, r.churn_probability, case when r.churn_probability >= 0.8 then 'CRITICAL' when r.churn_probability >= 0.6 then 'HIGH' when r.churn_probability >= 0.3 then 'MEDIUM' when r.churn_probability is not null then 'LOW' end as risk_band from gold_customers g left join rule_scores r on r.customer_id = g.customer_id", money=["total_spend", "churn_probability"])(lambda c: reports.customer_metrics(profiles(c), ruled(c)))
query("serve_customer_intelligence", "select g.customer_id, g.total_orders, r.churn_probability, (select count(*) from production p where p.customer_id = g.customer_id and p.recommendation_rank <= 10) as recommended, (select min(product_id) from production p where p.customer_id = g.customer_id and p.recommendation_rank = 1) as first_product from gold_customers g left join rule_scores r on r.customer_id = g.customer_id", money=["churn_probability"])(lambda c: _intelligence(c))


def _intelligence(c):
    record = serving.customer_intelligence(profiles(c), ruled(c), recommend_queries.production_of(c))
    return record.select("customer_id", "total_orders", F.col("churn.churn_probability").alias("churn_probability"), F.size("recommendations").cast("long").alias("recommended"), F.col("recommendations")[0]["product_id"].alias("first_product"))


#: Small sizes, so that the registered queries end soon; the operator's own defaults are larger.
SMALL_MODELS = {"logistic": {"maxIter": 20}, "forest": {"numTrees": 10, "maxDepth": 5}, "boosted": {"maxIter": 3}}


def _compared(c):
    """Metrics of a model of each kind on the test dates, the models by kind, and the test rows with each one's probabilities.

    The panel is stored once, in the numbers that models take and without the names of snapshots; the test rows are prepared and
    scored by all models in one pass.
    """
    rows = []
    panel = churn.churn_training_set(c).drop("snapshot_id")
    train, test = churn.time_split(staged(churn.as_numbers(panel, churn.assemble_features(panel)[0]), "training"))
    models = churn.train_models(train, SMALL_MODELS)
    scored = staged(churn.probabilities(test, models).select("customer_id", "observation_date", "revenue_180d", "churned", *models), "scored")
    for kind in SMALL_MODELS:
        one = scored.select("churned", F.col(kind).alias("churn_probability"))
        counted = churn.classification_metrics(one.withColumn("churn_prediction", (F.col("churn_probability") >= 0.5).cast("int")))
        rows.append(counted.crossJoin(churn.area_metrics(one)).withColumn("model", F.lit(kind)))  # one row each
    return rows[0].unionByName(rows[1]).unionByName(rows[2]), models, scored


def _champion(c):
    """The model that the comparison picks, and the test rows with its probabilities."""
    metrics, models, scored = _compared(c)
    best = churn.select_champion(metrics).first()["model"]
    return models[best], scored.withColumn("churn_probability", F.col(best))


relation("rule_models", " union all ".join(f"select '{m}' as model, least(1.0, greatest(0.0, p + {d})) as p, churned from rule_labels" for m, d in (("as_is", 0.0), ("bolder", 0.15), ("shyer", -0.35))))
query("churn_select_champion", """with g as (select model, p, sum(churned) as pos, count(*) - sum(churned) as neg from rule_models group by 1, 2), a as (select *, sum(pos) over (partition by model order by p desc) as tp, sum(neg) over (partition by model order by p desc) as fp from g),
    m as (select model, sum(neg * (tp - pos / 2.0)) / sum(pos) / sum(neg) as roc_auc, sum(pos * (cast(tp as double) / (tp + fp))) / sum(pos) as pr_auc from a group by 1), f as (select model, coalesce(2.0 * sum(case when p >= 0.5 then churned else 0 end) / nullif(sum(case when p >= 0.5 then 1 else 0 end) + sum(churned), 0), 0) as f1 from rule_models group by 1)
    select m.model, m.pr_auc, m.roc_auc, f.f1 from m join f on f.model = m.model order by round(m.pr_auc, 9) desc, round(m.roc_auc, 9) desc, round(f.f1, 9) desc, m.model limit 1""", ratio=["pr_auc", "roc_auc", "f1"])(lambda c: _rule_champion(c))


def _rule_champion(c):
    """The choice among the rule and two that shift its scores: equal areas, so that F1 and the name decide."""
    parts = []
    labelled = staged(churn.churn_training_set(c).select("churned", F.expr(RULE).cast("double").alias("rule")), "labelled")
    for name, shift in (("as_is", 0.0), ("bolder", 0.15), ("shyer", -0.35)):
        scored = labelled.withColumn("churn_probability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rule") + shift))).withColumn("churn_prediction", (F.col("churn_probability") >= 0.5).cast("int"))
        parts.append(churn.classification_metrics(scored).crossJoin(churn.area_metrics(scored)).withColumn("model", F.lit(name)))
    return churn.select_champion(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("model", "pr_auc", "roc_auc", "f1")


query("churn_champion")(lambda c: churn.select_champion(_compared(c)[0]))
query("churn_scores")(lambda c: churn.score_churn(churn.scoring_features(c), _champion(c)[0]))
query("churn_holdout_predictions")(lambda c: churn.labelled_predictions(_champion(c)[1].withColumn("snapshot_id", churn.snapshot_id())))
