"""Recommender, its evaluation and its monitoring as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlake.operators import evaluation as E
from cartlake.operators import monitoring, serving
from cartlake.operators import recommend as R
from cartlake.operators import vectors as vectors_of
from cartlake.plans.registry import query, relation
from cartlake.sources.staging import staged
from cartlake.sources.tables import record_run
from cartlake.streaming.runner import work_folder

LIVE = "upper(coalesce(o.status, '')) not in ('CANCELLED', 'CANCELED')"
relation("rec_events", f"""select customer_id, product_id, event_type, event_timestamp, max(interaction_weight) as interaction_weight, source, source_event_id, cast(event_timestamp as date) as event_date from (
    select o.customer_id, i.product_id, 'purchase' as event_type, o.order_date as event_timestamp, 5.0 * i.quantity as interaction_weight, 'orders' as source, cast(o.order_id as varchar) as source_event_id from src_orders o join src_order_items i on i.order_id = o.order_id where {LIVE}
    union all select customer_id, product_id, 'product_view', event_timestamp, 1.0, 'website_events', cast(event_id as varchar) from src_website_events where event_type = 'PRODUCT_VIEW' and product_id is not null) e group by 1, 2, 3, 4, 6, 7""")


def chain(prefix: str, events: str) -> None:
    """Pairs, popularity, similarity and personal candidates learned from these events."""
    relation(f"{prefix}_pairs", f"""select customer_id, product_id, count(distinct case when event_type = 'purchase' then source_event_id end) as purchase_count, coalesce(sum(case when event_type = 'purchase' then interaction_weight / 5.0 end), 0) as units_purchased, count(distinct case when event_type <> 'purchase' then source_event_id end) as product_view_count,
        max(event_timestamp) as last_interaction_at, 5.0 * count(distinct case when event_type = 'purchase' then source_event_id end) + count(distinct case when event_type <> 'purchase' then source_event_id end) as interaction_score from {events} group by 1, 2""")
    relation(f"{prefix}_pop", f"""select t.*, round(0.30 * unique_customers / max(unique_customers) over () + case when max(total_purchases) over () > 0 then 0.35 * total_purchases / max(total_purchases) over () else 0 end + case when max(total_views) over () > 0 then 0.10 * total_views / max(total_views) over () else 0 end + 0.25 * total_interaction_score / max(total_interaction_score) over (), 9) as popularity_score from (
        select product_id, count(distinct customer_id) as unique_customers, cast(sum(purchase_count) as double) as total_purchases, cast(sum(units_purchased) as double) as total_units, cast(sum(product_view_count) as double) as total_views, cast(sum(interaction_score) as double) as total_interaction_score, max(last_interaction_at) as last_interaction_at from {prefix}_pairs group by 1) t""")
    relation(f"{prefix}_kept", f"select p.customer_id, p.product_id, s.n from {prefix}_pairs p join (select product_id, count(*) as n from {prefix}_pairs group by 1 having count(*) >= 2) s on s.product_id = p.product_id")
    relation(f"{prefix}_edges", f"select a.product_id as a, b.product_id as b, count(*) as co, min(a.n) as n_a, min(b.n) as n_b from {prefix}_kept a join {prefix}_kept b on b.customer_id = a.customer_id and b.product_id <> a.product_id group by 1, 2 having count(*) >= 2")
    relation(f"{prefix}_sim", f"""select * from (select a as source_product_id, b as similar_product_id, co as co_interaction_count, n_a as source_customer_count, n_b as similar_customer_count, least(1.0, round(co / sqrt(cast(n_a as double) * n_b), 9)) as similarity_score, round(cast(co as double) / (n_a + n_b - co), 9) as jaccard_score,
        row_number() over (partition by a order by least(1.0, round(co / sqrt(cast(n_a as double) * n_b), 9)) desc, co desc, b) as similarity_rank from {prefix}_edges) e where similarity_rank <= 50""")
    relation(f"{prefix}_personal", f"""select customer_id, product_id, round(sum(c), 9) as raw_personalized_score, max(s) as max_similarity, count(distinct source_product_id) as supporting_products, min(case when best = 1 then source_product_id end) as primary_source_product_id from (
        select p.customer_id, e.similar_product_id as product_id, e.source_product_id, cast(p.interaction_score as double) * e.similarity_score as c, e.similarity_score as s, row_number() over (partition by p.customer_id, e.similar_product_id order by round(cast(p.interaction_score as double) * e.similarity_score, 9) desc, e.source_product_id) as best
        from {prefix}_pairs p join {prefix}_sim e on e.source_product_id = p.product_id where not exists (select 1 from {prefix}_pairs q where q.customer_id = p.customer_id and q.product_id = e.similar_product_id)) m group by 1, 2""")


def candidates_sql(prefix: str, customers: str) -> str:
    """Both sides' candidates of these customers with scores."""
    return f"""select m.customer_id, m.product_id, coalesce(x.p, 0.0) as personalized_score, coalesce(s.popularity_score, 0.0) as popularity_score, x.customer_id is not null as is_personal, x.max_similarity, x.supporting_products, x.primary_source_product_id, exists (select 1 from {prefix}_pairs h where h.customer_id = m.customer_id) as has_history from (
        select c.customer_id, t.product_id from {customers} c, (select product_id from {prefix}_pop order by popularity_score desc, unique_customers desc, product_id limit 100) t union select y.customer_id, y.product_id from {prefix}_personal y join {customers} c on c.customer_id = y.customer_id) m
        left join (select *, round(case when max(raw_personalized_score) over (partition by customer_id) > 0 then raw_personalized_score / max(raw_personalized_score) over (partition by customer_id) else 0 end, 9) as p from {prefix}_personal) x on x.customer_id = m.customer_id and x.product_id = m.product_id
        left join {prefix}_pop s on s.product_id = m.product_id where not exists (select 1 from {prefix}_pairs q where q.customer_id = m.customer_id and q.product_id = m.product_id)"""


def metrics_sql(rankings: str, targets: str) -> str:
    """Metrics of each model and customer."""
    return f"""select g.model, g.customer_id, cast(sum(hit) as double) / count(*) as precision, cast(sum(hit) as double) / max(a.n) as recall, case when sum(hit) > 0 then 1.0 else 0.0 end as hit_rate, coalesce(sum(case when hit = 1 then cast(sofar as double) / rank end), 0) / least(max(a.n), 10) as average_precision, sum(hit / log2(rank + 1)) as dcg,
        list_sum(list_transform(range(1, cast(least(max(a.n), 10) as bigint) + 1), lambda i: 1 / log2(i + 1))) as idcg, sum(hit / log2(rank + 1)) / list_sum(list_transform(range(1, cast(least(max(a.n), 10) as bigint) + 1), lambda i: 1 / log2(i + 1))) as ndcg from (
        select r.model, r.customer_id, r.rank, case when t.product_id is null then 0 else 1 end as hit, sum(case when t.product_id is null then 0 else 1 end) over (partition by r.model, r.customer_id order by r.rank) as sofar from {rankings} r left join {targets} t on t.customer_id = r.customer_id and t.product_id = r.product_id) g
        join (select customer_id, count(*) as n from {targets} group by 1) a on a.customer_id = g.customer_id group by 1, 2"""


def rankings_sql(candidates: str, grid: list[tuple[str, float, float]]) -> str:
    each = " union all ".join(f"select customer_id, product_id, '{m}' as model, round(personalized_score * {p!r} + popularity_score * {q!r}, 9) as s from {candidates}" for m, p, q in grid)
    return f"select model, customer_id, product_id, rank from (select *, row_number() over (partition by model, customer_id order by s desc, product_id) as rank from ({each}) e) r where rank <= 10"


chain("all", "rec_events")
relation("pair_units", f"select o.customer_id, i.product_id, sum(cast(i.quantity as double)) as q from src_orders o join src_order_items i on i.order_id = o.order_id where {LIVE} group by 1, 2")


def pairs_of(c):
    return R.interactions(c.orders, c.order_lines, c.website_events, c.products)


def scored_of(c):
    return R.scored_pairs(c.orders, c.order_lines, c.website_events)


def events_of(c):
    return R.customer_product_events(c.orders, c.order_lines, c.website_events)


query("rec_events", "select * from rec_events", stamps=["event_timestamp"], dates=["event_date"], money=["interaction_weight"])(events_of)
query("rec_interactions", "select a.customer_id, a.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price, a.purchase_count, coalesce(u.q, 0) as units_purchased, a.product_view_count, 5.0 * a.purchase_count as purchase_score, a.product_view_count as view_score, a.interaction_score, a.last_interaction_at from all_pairs a left join src_products p on p.product_id = a.product_id left join pair_units u on u.customer_id = a.customer_id and u.product_id = a.product_id", stamps=["last_interaction_at"], money=["price", "units_purchased", "purchase_score", "view_score", "interaction_score"])(lambda c: pairs_of(c).drop("last_purchase_at", "last_view_at"))
query("rec_popularity", "select a.product_id, a.unique_customers, a.total_purchases, coalesce(u.q, 0) as total_units, a.total_views, a.total_interaction_score, a.last_interaction_at, a.popularity_score from all_pop a left join (select product_id, sum(q) as q from pair_units group by 1) u on u.product_id = a.product_id", stamps=["last_interaction_at"], money=["total_purchases", "total_units", "total_views", "total_interaction_score"], ratio=["popularity_score"])(lambda c: R.product_popularity(scored_of(c)))
query("rec_popularity_ranks", """select s.product_id, s.popularity_score, row_number() over (order by s.popularity_score desc, s.unique_customers desc, s.product_id) as popularity_rank, row_number() over (partition by p.category order by s.popularity_score desc, s.unique_customers desc, s.product_id) as category_rank,
    row_number() over (partition by p.category, p.subcategory order by s.popularity_score desc, s.unique_customers desc, s.product_id) as subcategory_rank, row_number() over (partition by p.brand order by s.popularity_score desc, s.unique_customers desc, s.product_id) as brand_rank from all_pop s left join src_products p on p.product_id = s.product_id""", ratio=["popularity_score"])(lambda c: R.popularity_ranks(R.product_popularity(scored_of(c)), c.products).select("product_id", "popularity_score", "popularity_rank", "category_rank", "subcategory_rank", "brand_rank"))
query("rec_similarity", "select * from all_sim", ratio=["similarity_score", "jaccard_score"])(lambda c: R.product_similarity(staged(scored_of(c), "pairs")))
query("rec_item_item", "select r.customer_id, r.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price, r.raw_personalized_score as recommendation_score, r.recommendation_rank, r.max_similarity, r.supporting_products, r.primary_source_product_id, 'similar_to_customer_history' as recommendation_reason, 'item_item_cosine_v1' as model_name, timestamp '2001-08-02' as generated_at from (select *, row_number() over (partition by customer_id order by raw_personalized_score desc, product_id) as recommendation_rank from all_personal) r left join src_products p on p.product_id = r.product_id where recommendation_rank <= 10", money=["price"], ratio=["recommendation_score", "max_similarity"], stamps=["generated_at"])(lambda c: item_item_of(c))
query("rec_normalised_scores", "select customer_id, product_id, round(raw_personalized_score / max(raw_personalized_score) over (partition by customer_id), 9) as personalized_score from all_personal", ratio=["personalized_score"])(lambda c: normalised_of(c))
query("rec_cold_start", "select c.customer_id, t.product_id, t.popularity_score, t.recommendation_rank from src_customers c, (select product_id, popularity_score, row_number() over (order by popularity_score desc, unique_customers desc, product_id) as recommendation_rank from all_pop) t where t.recommendation_rank <= 10 and not exists (select 1 from all_pairs p where p.customer_id = c.customer_id)", ratio=["popularity_score"])(lambda c: R.cold_start_recommend(c.customers, pairs_of(c), R.product_popularity(pairs_of(c))))
relation("all_candidates", candidates_sql("all", "src_customers"))


def hybrid_sql(scaled: bool) -> str:
    mixed = "round(personalized_score * 0.8 + popularity_score * 0.2, 9)"
    used = mixed if scaled else f"case when is_personal then {mixed} else popularity_score end"
    return f"""select h.customer_id, h.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price, h.recommendation_rank, h.recommendation_score, h.personalized_score, h.popularity_score, h.hybrid_score, h.max_similarity, h.supporting_products, h.primary_source_product_id, h.has_history,
        case when not has_history then 'popular_cold_start' when is_personal and popularity_score > 0 then 'hybrid_personalized' when is_personal then 'personalized_similarity' else 'popular_fallback' end as recommendation_reason, 'hybrid_item_item_popularity' as model_name, 'v1' as model_version, timestamp '2001-08-02' as generated_at
        from (select *, {used} as recommendation_score, {mixed} as hybrid_score, row_number() over (partition by customer_id order by {used} desc, product_id) as recommendation_rank from all_candidates) h left join src_products p on p.product_id = h.product_id where h.recommendation_rank <= 10"""


HYBRID, PRODUCTION = hybrid_sql(False), hybrid_sql(True)
relation("production", PRODUCTION)


def run_at():
    return F.lit("2001-08-02").cast("timestamp_ntz")


def sides_of(c):
    """Pairs, similarity and popularity, each stored once."""
    pairs = staged(scored_of(c), "pairs")
    popularity = staged(R.product_popularity(pairs), "popularity")
    return pairs, staged(R.product_similarity(pairs, support=R.supports_of(popularity)), "similarity"), popularity


def hybrid_of(c, attributes: bool = True):
    pairs, similarity, popularity = sides_of(c)
    return R.hybrid_recommend(c.customers, pairs, R.customer_rows(pairs, similarity, popularity, c.customers), popularity, c.products, generated_at=run_at(), attributes=attributes)


def item_item_of(c):
    pairs = staged(scored_of(c), "pairs")
    return R.item_item_recommend(pairs, staged(R.product_similarity(pairs), "similarity"), c.products, generated_at=run_at())


def normalised_of(c):
    pairs = staged(scored_of(c), "pairs")
    return R.normalise_per_customer(R.item_item_candidates(pairs, staged(R.product_similarity(pairs), "similarity"))).select("customer_id", "product_id", "personalized_score")


def production_of(c, attributes: bool = True):
    pairs, similarity, popularity = sides_of(c)
    return R.production_recommend(c.customers, pairs, similarity, popularity, c.products, weights=R.Weights(), run_id="run-1", generated_at=run_at(), attributes=attributes)


SCORES = ["recommendation_score", "personalized_score", "popularity_score", "hybrid_score", "max_similarity"]
query("rec_hybrid", HYBRID, ratio=SCORES, money=["price"], stamps=["generated_at"])(hybrid_of)
query("rec_production", "select *, 'run-1' as run_id, 0.8 as personalized_weight, 0.2 as popularity_weight from production", ratio=[*SCORES, "personalized_weight", "popularity_weight"], money=["price"], stamps=["generated_at"])(production_of)
query("rec_reasons", f"select recommendation_reason, count(*) as n from ({HYBRID}) x group by 1")(lambda c: hybrid_of(c, attributes=False).groupBy("recommendation_reason").agg(F.count("*").alias("n")))
query("rec_run_history", "select count(*) as recommendations, count(distinct customer_id) as customers_reached, count(distinct product_id) as products_recommended, " + ", ".join(f"sum(case when recommendation_reason = '{r}' then 1 else 0 end) as {r}" for r in R.REASONS) + ", (select count(*) from src_customers) as customers, 'run-1' as run_id, 0.0 as duration_seconds, 'SUCCESS' as status from production", money=[*R.REASONS, "duration_seconds"])(lambda c: R.run_history_row(production_of(c, attributes=False), c.customers, run_id="run-1"))

# --- evaluation ----------------------------------------------------------------------------------------------

relation("split_events", """select e.*, l.d - 30 as test_start, l.d - 60 as validation_start, case when e.event_date < l.d - 60 then 'TRAIN' when e.event_date < l.d - 30 then 'VALIDATION' else 'TEST' end as split from rec_events e, (select max(event_date) as d from rec_events) l""")
relation("train_events", "select * from split_events where split = 'TRAIN'")
relation("known_events", "select * from split_events where split in ('TRAIN', 'VALIDATION')")
chain("train", "train_events")
chain("known", "known_events")


def targets_sql(part: str, before: str) -> str:
    return f"select distinct customer_id, product_id from split_events s where split = '{part}' and exists (select 1 from {before} t where t.customer_id = s.customer_id) and not exists (select 1 from {before} t where t.customer_id = s.customer_id and t.product_id = s.product_id)"


relation("validation_targets", targets_sql("VALIDATION", "train_events"))
relation("final_targets", targets_sql("TEST", "known_events"))
relation("baseline_targets", targets_sql("TEST", "train_events"))
relation("validation_customers", "select distinct customer_id from validation_targets")
relation("final_customers", "select distinct customer_id from final_targets")
relation("baseline_customers", "select distinct customer_id from baseline_targets")
relation("validation_candidates", candidates_sql("train", "validation_customers"))
relation("baseline_candidates", candidates_sql("train", "baseline_customers"))
relation("final_candidates", candidates_sql("known", "final_customers"))
relation("tuned_rankings", rankings_sql("validation_candidates", E.GRID))
relation("baseline_rankings", rankings_sql("baseline_candidates", E.BASELINES))
relation("final_rankings", rankings_sql("final_candidates", [("champion", 0.8, 0.2)]))
relation("tuned_metrics", metrics_sql("tuned_rankings", "validation_targets"))
relation("baseline_metrics", metrics_sql("baseline_rankings", "baseline_targets"))
relation("final_metrics", metrics_sql("final_rankings", "final_targets"))


def split_of(c):
    return E.temporal_split(staged(events_of(c), "events"))


def baseline_of(c):
    split = split_of(c)
    wanted = staged(E.actuals(split, "TEST", ("TRAIN",)), "wanted")
    return staged(E.baseline_predictions(split, wanted), "predictions"), wanted


def summary_sql(metrics: str, rankings: str) -> str:
    return f"select m.model, m.n as evaluated_customers, m.precision, m.recall, m.hit_rate, m.map, m.ndcg, r.n as recommended_products, cast(r.n as double) / (select count(*) from src_products) as catalog_coverage, 10 as k from (select model, count(*) as n, avg(precision) as precision, avg(recall) as recall, avg(hit_rate) as hit_rate, avg(average_precision) as map, avg(ndcg) as ndcg from {metrics} group by 1) m join (select model, count(distinct product_id) as n from {rankings} group by 1) r on r.model = m.model"


MEANS = ["precision", "recall", "hit_rate", "map", "ndcg", "catalog_coverage"]
query("eval_temporal_split", "select split, count(*) as events, count(distinct customer_id) as customers, count(distinct product_id) as products from split_events group by 1")(lambda c: E.split_statistics(split_of(c)))
relation("dated_pairs", "select p.*, cast(last_interaction_at as date) >= l.d - 30 as future from all_pairs p, (select cast(max(last_interaction_at) as date) as d from all_pairs) l")
query("eval_holdout_targets", "select customer_id, product_id from dated_pairs d where future and customer_id in (select customer_id from dated_pairs group by 1 having sum(case when future then 0 else 1 end) >= 2 and sum(case when future then 1 else 0 end) > 0)")(lambda c: E.holdout_pairs(pairs_of(c))[1])
query("eval_baseline_predictions", "select * from baseline_rankings")(lambda c: baseline_of(c)[0])
query("eval_customer_metrics", "select * from baseline_metrics", ratio=["precision", "recall", "hit_rate", "average_precision", "dcg", "idcg", "ndcg"])(lambda c: E.customer_metrics(*baseline_of(c)))
query("eval_score_hits", "select r.model, count(*) as rows_ranked, sum(case when t.product_id is null then 0 else 1 end) as hits from baseline_rankings r left join baseline_targets t on t.customer_id = r.customer_id and t.product_id = r.product_id group by 1", money=["hits"])(lambda c: E.score_hits(*baseline_of(c)).groupBy("model").agg(F.count("*").alias("rows_ranked"), F.sum("hit").alias("hits")))
query("eval_catalog_coverage", "select model, count(distinct product_id) as recommended_products, (select count(*) from src_products) as catalog, cast(count(distinct product_id) as double) / (select count(*) from src_products) as catalog_coverage from baseline_rankings group by 1", ratio=["catalog_coverage"])(lambda c: E.catalog_coverage(baseline_of(c)[0], c.products))
query("eval_model_metrics", summary_sql("baseline_metrics", "baseline_rankings"), ratio=MEANS)(lambda c: E.model_metrics(*baseline_of(c), c.products))
TUNED = "select model, count(*) as evaluated_customers, avg(precision) as precision, avg(recall) as recall, avg(hit_rate) as hit_rate, case model " + " ".join(f"when '{m}' then {p!r}" for m, p, _ in E.GRID) + " end as personalized_weight, 1 - case model " + " ".join(f"when '{m}' then {p!r}" for m, p, _ in E.GRID) + " end as popularity_weight from tuned_metrics group by 1"
query("eval_tune_weights", TUNED, ratio=["precision", "recall", "hit_rate", "personalized_weight", "popularity_weight"])(lambda c: E.tune_weights(split_of(c)))
query("eval_select_config", f"select * from ({TUNED}) t order by round(hit_rate, 9) desc, round(recall, 9) desc, round(precision, 9) desc, model limit 1", ratio=["precision", "recall", "hit_rate", "personalized_weight", "popularity_weight"])(lambda c: E.select_config(E.tune_weights(split_of(c))))
query("eval_final_test", summary_sql("final_metrics", "final_rankings"), ratio=MEANS)(lambda c: E.final_test(split_of(c), R.Weights(), c.products))
query("eval_retrieval", """with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), s as (select q.vec_id as query_id, d.vec_id, d.label = q.label as same, list_sum(list_transform(range(1, 65), lambda i: q.e[i] * d.e[i])) / sqrt(list_sum(list_transform(q.e, lambda x: x * x))) / sqrt(list_sum(list_transform(d.e, lambda x: x * x))) as score from v q, v d where q.vec_id % 50 = 0 and d.vec_id <> q.vec_id),
    r as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s where score >= 0.3) x where rank <= 5), f as (select query_id, min(rank) as first from r where same group by 1)
    select count(*) as queries, avg(case when f.first is null then 0.0 else 1.0 end) as hit_rate, avg(coalesce(1.0 / f.first, 0)) as mrr from (select vec_id from v where vec_id % 50 = 0) q left join f on f.query_id = q.vec_id""", ratio=["hit_rate", "mrr"])(lambda c: _retrieval(c))


def _retrieval(c):
    vectors = c.table("embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    relevant = asked.select(F.col("vec_id").alias("query_id"), "label").join(vectors.select("vec_id", "label"), "label").drop("label")
    return E.retrieval_metrics(vectors_of.vector_top_k(asked, vectors), relevant, asked.select(F.col("vec_id").alias("query_id")))


# --- validation, monitoring, serving of recommendations ------------------------------------------------------

query("validate_recommendations", "select count(*) as row_count, 0 as null_keys, count(*) - count(distinct customer_id * 1000000000 + product_id) as duplicates, sum(case when recommendation_rank not between 1 and 10 then 1 else 0 end) as bad_ranks, sum(case when recommendation_score < 0 then 1 else 0 end) as bad_scores, (select count(*) from production p join all_pairs a on a.customer_id = p.customer_id and a.product_id = p.product_id) as seen, 1 as runs, cast(count(distinct customer_id) as double) / (select count(*) from src_customers) as coverage from production", ratio=["coverage"], money=["bad_ranks", "bad_scores"])(lambda c: monitoring.validate_recommendations(production_of(c), pairs_of(c), c.customers))
MONITOR = """select '{run}' as run_id, 'hybrid_item_item_popularity' as model_name, 'v1' as model_version, 0.8 as personalized_weight, 0.2 as popularity_weight, (select count(*) from src_customers) as total_customers, count(distinct customer_id) as recommended_customers, cast(count(distinct customer_id) as double) / (select count(*) from src_customers) as customer_coverage, (select count(*) from src_products) as total_products, count(distinct product_id) as recommended_products, cast(count(distinct product_id) as double) / (select count(*) from src_products) as catalog_coverage,
    count(*) as total_recommendations, cast(count(*) as double) / count(distinct customer_id) as avg_recommendations_per_customer, avg(recommendation_score) as avg_score, min(recommendation_score) as min_score, max(recommendation_score) as max_score, count(*) filter (where recommendation_reason in ('hybrid_personalized', 'personalized_similarity')) as personalized_count, cast(count(*) filter (where recommendation_reason in ('hybrid_personalized', 'personalized_similarity')) as double) / count(*) as personalized_pct,
    count(*) filter (where recommendation_reason = 'popular_fallback') as fallback_count, cast(count(*) filter (where recommendation_reason = 'popular_fallback') as double) / count(*) as fallback_pct, count(*) filter (where recommendation_reason = 'popular_cold_start') as cold_start_count, cast(count(*) filter (where recommendation_reason = 'popular_cold_start') as double) / count(*) as cold_start_pct, 0 as duplicate_pairs, 0 as invalid_scores, timestamp '{at}' as monitored_at from production"""
MONITORED = ["personalized_weight", "popularity_weight", "customer_coverage", "catalog_coverage", "avg_recommendations_per_customer", "avg_score", "min_score", "max_score", "personalized_pct", "fallback_pct", "cold_start_pct"]


def monitored(c, made, run: str, at: str):
    return monitoring.monitor_recommendations(made.withColumn("run_id", F.lit(run)), c.customers, c.products, monitored_at=F.lit(at).cast("timestamp_ntz"))


query("monitor_recommendations", MONITOR.format(run="run-1", at="2001-08-03"), ratio=MONITORED, stamps=["monitored_at"])(lambda c: monitored(c, production_of(c), "run-1", "2001-08-03").drop("median_score"))
query("monitor_history", f"{MONITOR.format(run='run-1', at='2001-08-05')} union all {MONITOR.format(run='run-2', at='2001-08-04')}", ratio=MONITORED, stamps=["monitored_at"])(lambda c: _history(c).drop("median_score"))


def _history(c):
    """Two runs, the first of them repeated: its later rows take the place of its earlier ones."""
    made, path = staged(production_of(c), "production"), work_folder(c.spark, "monitoring")
    for run, at in (("run-1", "2001-08-03"), ("run-2", "2001-08-04"), ("run-1", "2001-08-05")):
        history = record_run(monitored(c, made, run, at), path)
    return history


query("serve_recommendations", "select customer_id, product_id, recommendation_rank, recommendation_score, recommendation_reason from production", ratio=["recommendation_score"])(lambda c: serving.serve_recommendations(production_of(c, attributes=False)))
query("top_recommendations", "select customer_id, product_id, recommendation_rank from production where recommendation_rank <= 3")(lambda c: serving.top_recommendations(production_of(c, attributes=False), 3).select("customer_id", "product_id", "recommendation_rank"))
