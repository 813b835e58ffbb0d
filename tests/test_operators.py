"""Invariants of operators that SQL does not cover."""

import datetime
import random

import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from cartlake.operators import churn, evaluation, quality, recommend, reports, serving, vectors
from cartlake.sources.commerce import Commerce


def test_star_rules_fail_on_broken_rows(spark):
    rows = spark.createDataFrame([(1, -1.0, "A"), (1, 2.0, "B"), (None, 3.0, None)], "k int, amount double, status string")
    rules = [quality.Rule("not_null", "k"), quality.Rule("unique", "k"), quality.Rule("non_negative", "amount"), quality.Rule("in_set", "status", ("A",))]
    found = {r.expectation: (r.broken, r.success) for r in quality.run_expectations(rows, "t", rules).collect()}
    assert found == {"not_null(k)": (1, False), "unique(k)": (1, False), "non_negative(amount)": (1, False), "in_set(status)": (1, False)}
    with pytest.raises(ValueError):
        quality.require_quality(quality.run_expectations(rows, "t", rules))
    assert not any(r.success for r in quality.run_expectations(rows.limit(0), "t", rules).collect())


def test_metrics_aggregate_refuses(spark):
    df = spark.range(3).withColumn("secret", F.lit(1))
    for options in ({"dims": ["secret"], "aggs": {"n": ("count", "*")}}, {"aggs": {"n": ("stddev", "id")}}, {"aggs": {}}, {"aggs": {"n": ("count", "*")}, "filters": [("id", "like", "x")]}, {"aggs": {"n": ("count", "*")}, "order": [("m", True)]}):
        with pytest.raises(ValueError):
            reports.metrics_aggregate(df, allowed={"id"}, **options)


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        recommend.Weights(0.8, 0.3)
    with pytest.raises(ValueError):
        recommend.champion_weights(spark.createDataFrame([(0.8, 0.2), (0.5, 0.5)], "personalized_weight double, popularity_weight double"))


def test_ranking_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 11, 2), ("m", 1, 12, 3)], "model string, customer_id int, product_id int, rank int")
    wanted = spark.createDataFrame([(1, 11), (1, 99)], "customer_id int, product_id int")
    r = evaluation.customer_metrics(ranking, wanted).first()
    assert (round(r.precision, 6), r.recall, r.hit_rate, r.average_precision) == (0.333333, 0.5, 1.0, 0.25)
    assert 0 < r.ndcg < 1


def test_no_leak_and_time_split(spark):
    training = churn.churn_training_set(Commerce(spark, SMALL))
    numeric, categorical = churn.assemble_features(training)
    assert not [c for c in numeric if c.startswith("future") or c == "churned"] and categorical == list(churn.CATEGORIES)
    with pytest.raises(ValueError):
        churn.guard_features(["future_orders_60d"])
    train, test = churn.time_split(training)
    assert train.agg(F.max("observation_date")).first()[0] < test.agg(F.min("observation_date")).first()[0]


def test_chunks_cover_texts(spark):
    docs = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 1000, 1001, 1850, 1851)], "doc_id int, text string")
    found = {}
    for r in serving.chunk_windows(docs).collect():
        found.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_start, len(r.chunk)))
    assert {k: len(v) for k, v in found.items()} == {1: 1, 1000: 1, 1001: 2, 1850: 2, 1851: 3}
    assert all(max(s + n for _, s, n in v) == k for k, v in found.items())


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two\nmore")], "doc_id int, text string")
    assert [(r.heading, r.body.strip()) for r in serving.sections(docs).orderBy("section").collect()] == [(None, "intro"), ("One", "body"), ("Two", "more")]


def test_similarity_in_blocks_is_exact(spark):
    """Cut into many blocks, a customer with all products gives the same pairs, and no join key has many rows."""
    rows = [(c, p) for c in range(12) for p in range(60) if c == 0 or (p * 7 + c * 5) % 11 < 4]
    pairs = spark.createDataFrame(rows, "customer_id int, product_id long")
    whole, cut = (sorted(map(tuple, recommend.product_similarity(pairs, block=b, top_n=100).collect())) for b in (2000, 7))
    support, met = {}, {}
    for c, p in rows:
        support[p] = support.get(p, 0) + 1
        for d, q in rows:
            if c == d and p != q:
                met[p, q] = met.get((p, q), 0) + 1
    assert whole == cut and {(r[0], r[1]): r[2] for r in whole} == {k: n for k, n in met.items() if n >= 2 and support[k[0]] >= 2 and support[k[1]] >= 2}


def test_a_customer_of_all_products_is_no_long_task(spark):
    """The self join's largest key holds the pairs of two blocks: its rows do not grow with one customer's products."""
    most = {}
    for n in (400, 1600):
        pairs = spark.range(n).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("customer_id"), F.col("id").alias("product_id")).where("customer_id = 1 or product_id < 20")
        pairs = pairs.unionByName(spark.range(n).select((F.col("id") + 10).cast("int").alias("customer_id"), F.col("id").alias("product_id")))
        kept = pairs.join(pairs.groupBy("customer_id").agg(F.ceil(F.count("*") / 100).cast("int").alias("n")), "customer_id").withColumn("b", F.pmod(F.xxhash64("product_id"), F.col("n")))
        most[n] = kept.groupBy("customer_id", "b").count().agg(F.max("count")).first()[0]
        assert recommend.product_similarity(pairs, block=100, top_n=5).count() == 20 * 5
    assert most[1600] < 2 * most[400]


def test_ranks_of_ties_and_missing_groups(spark):
    popularity = spark.createDataFrame([(i, 0.5 if i % 3 else 0.0, 2) for i in range(200)], "product_id long, popularity_score double, unique_customers long")
    products = spark.createDataFrame([(i, "n", "c" if i % 2 else None, "s", "b", 1.0) for i in range(0, 180)], "product_id long, product_name string, category string, subcategory string, brand string, price double")
    rows = recommend.popularity_ranks(popularity, products).collect()
    order = sorted(rows, key=lambda r: (-r.popularity_score, r.product_id))
    assert [r.popularity_rank for r in order] == list(range(1, 201))
    for rank, group in (("category_rank", lambda r: r.category), ("subcategory_rank", lambda r: (r.category, r.subcategory)), ("brand_rank", lambda r: r.brand)):
        seen = {}
        for r in order:
            seen[group(r)] = seen.get(group(r), 0) + 1
            assert r[rank] == seen[group(r)]


@pytest.mark.parametrize("scaled", [False, True])
def test_hybrid_ranking_equals_scoring_every_candidate(spark, scaled):
    """Customers with no, some and very many products, popular products that are seen or personal, and tied scores."""
    customers = spark.createDataFrame([(c,) for c in range(6)], "customer_id long")
    pairs = spark.createDataFrame([(c, p, float(1 + (c * p) % 3)) for c in range(1, 6) for p in range(0, 40, 7 - c)], "customer_id long, product_id long, interaction_score double")
    similarity = spark.createDataFrame([(a, b, ((a * 3 + b) % 10 + 1) / 11) for a in range(0, 40, 2) for b in range(a % 3, 60, 3) if a != b], "source_product_id long, similar_product_id long, similarity_score double")
    popularity = spark.createDataFrame([(p, ((p * 13) % 8) / 8, p % 3) for p in range(50)], "product_id long, popularity_score double, unique_customers long")
    products = spark.createDataFrame([(p, f"n{p}", "c", "s", "b", 2.0) for p in range(60)], "product_id long, product_name string, category string, subcategory string, brand string, price double")
    personal = recommend.item_item_candidates(pairs, similarity, popularity)
    found = {}
    for r in recommend.hybrid_recommend(customers, pairs, personal, popularity, products, k=4, candidate_limit=20, fallback_scaled=scaled).collect():
        found.setdefault(r.customer_id, []).append((r.recommendation_rank, r.product_id, r.recommendation_score, r.recommendation_reason, r.has_history, r.product_name))
    all_ = recommend.hybrid_candidates(customers, pairs, personal.drop("popularity_score"), popularity, candidate_limit=20).withColumn("s", recommend.hybrid_score(recommend.Weights(), fallback_scaled=scaled)).collect()
    for c in range(6):
        best = sorted((r for r in all_ if r.customer_id == c), key=lambda r: (-r.s, r.product_id))[:4]
        reasons = ["popular_cold_start" if not r.has_history else ("hybrid_personalized" if r.popularity_score > 0 else "personalized_similarity") if r.is_personal else "popular_fallback" for r in best]
        assert sorted(found[c]) == [(i + 1, r.product_id, r.s, why, c > 0, f"n{r.product_id}") for i, (r, why) in enumerate(zip(best, reasons, strict=True))]


def test_vectors_of_odd_rows_and_many_blocks(spark):
    """Blocks of any size give the same answer; null, zero and broken vectors go; lengths do not mix; a cell of equal vectors is many blocks."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(1000 + i, [1.0, 2.0]) for i in range(200)] + [(None, [1.0] * 6), (2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None]), (2004, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    whole, cut = (sorted(map(tuple, vectors.vector_top_k(asked, df, query_rows=q, vector_rows=v).select("query_id", "vec_id", "rank").collect())) for q, v in ((512, 4096), (3, 17)))
    assert whole == cut and {q for q, _, _ in whole} >= {0, 50, 1000} and not {v for _, v, _ in whole} & {2000, 2001, 2002, 2003}
    assert [v for q, v, _ in whole if q == 1000] == [1001, 1002, 1003, 1004, 1005]
    index = vectors.build_index(df, cells=4, block_rows=16)
    assert index.blocks.groupBy("width", "cell", "block").count().count() == index.blocks.count() and index.blocks.where("size(ids) > 64").count() == 0
    every = sorted(map(tuple, vectors.search_index(index, asked, probes=100).select("query_id", "vec_id", "rank").collect()))
    assert every == whole
    assert vectors.vector_top_k(asked.limit(0), df).count() == 0 and vectors.search_index(vectors.build_index(df.limit(0)), asked, probes=2).count() == 0


def test_index_probes_few_cells_of_clustered_vectors(spark):
    """On clusters a part of the cells finds nearly all that the exact way finds."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    df = spark.createDataFrame([(i, [float(v) for v in centres[i % 40] + rng.normal(size=16) * 0.4]) for i in range(4000)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 7")
    index = vectors.build_index(df)
    probes = vectors.choose_probes(index, asked, df)
    cells = len(index.centres[16])
    assert probes <= cells // 2 and vectors.recall(vectors.search_index(index, asked, probes=probes), vectors.vector_top_k(asked, df)).first()["recall"] >= 0.9


def test_checked_writes_tell_the_same_as_expectations(spark, tmp_path):
    rows = spark.createDataFrame([(1, -1.0, "A"), (1, 2.0, "B"), (1, 2.0, None), (None, 3.0, None)], "k int, amount double, status string")
    rules = [quality.Rule("not_null", "k"), quality.Rule("unique", "k"), quality.Rule("non_negative", "amount"), quality.Rule("in_set", "status", ("A",))]
    stored, found = quality.write_checked(rows, f"{tmp_path}/t", "t", rules)
    assert stored.count() == 4 and sorted(map(tuple, found.collect())) == sorted(map(tuple, quality.run_expectations(rows, "t", rules).collect()))
    _, empty = quality.write_checked(rows.limit(0), f"{tmp_path}/e", "t", rules)
    assert not any(r.success for r in empty.collect())
    assert sum(len(r) for r in quality.STAR_RULES.values()) == 44


def test_windows_equal_looking_at_every_event(spark):
    """Identifiers on several days, windows of several lengths, both directions, missing values and customers without events."""
    rng = random.Random(6)
    day = datetime.date(2024, 1, 1)
    events = [(rng.randint(1, 4), rng.choice([None, *"abcdef"]), day + datetime.timedelta(rng.randint(0, 120)), rng.choice([None, 1, 5])) for _ in range(300)]
    dates = [day + datetime.timedelta(n) for n in (0, 31, 60, 90, 130, 400)]
    df = spark.createDataFrame(events, "customer_id int, id string, t date, v int")
    when = spark.createDataFrame([(d,) for d in dates], "observation_date date")
    for future in (False, True):
        found = {(r.customer_id, r.observation_date): (r.n7, r.n30, r.s, r.age) for r in churn.window_values(df, "t", when, distinct={"n7": ("id", 7), "n30": ("id", 30)}, sums={"s": ("v", 14)}, last=("age", 20), future=future).collect()}
        for c in range(1, 5):
            for d in dates:
                def inside(days, e):
                    gap = (e[2] - d).days if future else (d - e[2]).days
                    return e[0] == c and (0 < gap <= days if future else 0 <= gap < days)

                n7, n30 = (len({e[1] for e in events if inside(n, e)} - {None}) for n in (7, 30))
                # The last day is that of an event with an identifier or a value.
                ages = [(d - e[2]).days for e in events if e[0] == c and e[2] <= d and (e[1] is not None or e[2] is not None)]
                age = min(ages, default=None)
                assert found[c, d] == (n7, n30, sum(e[3] or 0 for e in events if inside(14, e)), age if age is not None and age < 20 else None)


def test_areas_with_ties(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0, 1]), rng.randint(0, 5) / 5) for _ in range(400)] + [(None, 0.5), (1, None)]
    r = churn.area_metrics(spark.createDataFrame(rows, "churned int, churn_probability double").repartition(5)).first()
    pos, neg = ([p for y, p in rows[:400] if y == side] for side in (1, 0))
    roc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    precision = {s: sum(p >= s for p in pos) / sum(p >= s for p in pos + neg) for s in set(pos)}
    assert (r.positives, r.negatives) == (len(pos), len(neg)) and r.roc_auc == pytest.approx(roc) and r.pr_auc == pytest.approx(sum(precision[p] for p in pos) / len(pos))
    one = churn.area_metrics(spark.createDataFrame([(1, 0.5)], "churned int, churn_probability double")).first()
    assert one.roc_auc is None and one.pr_auc == 1.0


def test_broken_predictions_are_not_loaded(spark, tmp_path):
    good = [(1, datetime.date(2024, 1, 1), 0.5, 1, "MEDIUM", 1.0, 0.5, "m", "1")]
    schema = "customer_id long, prediction_date date, churn_probability double, churn_prediction int, risk_band string, revenue_180d double, revenue_at_risk double, model_name string, model_version string"
    for name, rows in (("empty", []), ("bad", [(1, None, *good[0][2:])]), ("high", [(*good[0][:2], 1.5, *good[0][3:])])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        with pytest.raises(ValueError):
            churn.load_predictions(spark, f"{tmp_path}/{name}", f"{tmp_path}/table")
    spark.createDataFrame(good, schema).write.parquet(f"{tmp_path}/good")
    assert churn.load_predictions(spark, f"{tmp_path}/good", f"{tmp_path}/table").first().model_alias == "champion"


def test_pipeline_of_features_and_model(spark):
    """Missing numbers are filled, unknown categories scored, weights balance the classes."""
    rows = [(i, f"s{i}", None if i % 9 == 0 else float(i % 10), "ab"[i % 2], "xyz"[i % 3], "pq"[i % 2], int(i % 10 > 6)) for i in range(120)]
    df = spark.createDataFrame(rows, "customer_id int, snapshot_id string, orders_30d double, customer_segment string, country string, state string, churned int")
    trained = churn.train_churn(df, "logistic", maxIter=20)
    weights = churn.balanced(df).groupBy("churned").agg(F.sum("weight").alias("w")).collect()
    assert len({round(r.w, 6) for r in weights}) == 1
    scored = churn.probability(df.withColumn("customer_segment", F.lit("never seen")), trained).collect()
    assert all(0 <= r.churn_probability <= 1 for r in scored) and churn.area_metrics(churn.probability(df, trained)).first().roc_auc > 0.9


@pytest.mark.parametrize("kind, options", [("logistic", {"maxIter": 2}), ("forest", {"numTrees": 2, "maxDepth": 2}), ("boosted", {"maxIter": 1})])
def test_models_score_in_a_session_that_has_observed(spark, kind, options):
    """A session that has observed a query holds what cannot be sent to tasks; models must not carry it there."""
    spark.range(3).observe("seen", F.count("*").alias("n")).collect()
    df = spark.createDataFrame([(i, float(i % 10), "ab"[i % 2], int(i % 10 > 6)) for i in range(40)], "customer_id int, orders_30d double, customer_segment string, churned int")
    assert churn.probability(df, churn.train_churn(df, kind, **options)).count() == len([r for r in churn.probability(df, churn.train_churn(df, kind, **options)).collect() if 0 <= r.churn_probability <= 1])


def test_windows_work_follows_events_and_not_dates(spark):
    """A customer with one event meets the few dates whose windows hold it, however many dates there are."""
    when = spark.sql("select explode(sequence(date '1990-01-01', date '2023-12-01', interval 1 month)) as observation_date")
    events = spark.createDataFrame([(1, "a", datetime.date(2000, 1, 15), 2)], "customer_id int, id string, t date, v int")
    windows = churn.Windows(events, "t", {"n": ("id", 60)}, {"s": ("v", 90)}, ("age", 90))
    assert windows.met(when).count() == 6  # an identifier and a value on three dates
    assert [(str(r.observation_date), r.n, r.s, r.age) for r in churn.window_rows(when, windows).orderBy("observation_date").collect()] == [("2000-02-01", 1, 2, 17), ("2000-03-01", 1, 2, 46), ("2000-04-01", 0, 2, 77)]


def test_rows_by_customer_give_the_same_ranking_without_another_exchange(spark):
    """Candidates, what was seen and customers in one exchange rank as the three apart do, also for customers without history."""
    c = Commerce(spark, SMALL)
    pairs = recommend.interactions(c.orders, c.order_items, c.website_events, c.products).where("customer_id % 3 = 0").localCheckpoint()
    similarity, popularity = recommend.product_similarity(pairs).localCheckpoint(), recommend.product_popularity(pairs).localCheckpoint()
    together = recommend.customer_rows(pairs, similarity, popularity, c.customers)
    apart = recommend.item_item_candidates(pairs, similarity, popularity)
    found, wanted = (recommend.hybrid_recommend(c.customers, pairs, personal, popularity, c.products, generated_at=F.lit(0)) for personal in (together, apart))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert together.where("is_personal and product_id is null").count() == 0 and together.where("is_personal is null").count() == c.customers.count()
    ranked = together.groupBy("customer_id").agg(F.max("max_similarity"))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(customer_id") == 1


def test_only_judged_customers_get_candidates(spark):
    split = spark.createDataFrame([(c, p, "purchase", datetime.datetime(2024, 1, 1), 5.0, "orders", f"{c}-{p}", "TRAIN") for c in range(6) for p in range(6) if (c + p) % 3], "customer_id int, product_id int, event_type string, event_timestamp timestamp, interaction_weight double, source string, source_event_id string, split string")
    pairs, _, personal = evaluation.training_sides(split, ("TRAIN",), spark.createDataFrame([(1, 2)], "customer_id int, product_id int"))
    assert pairs.select("customer_id").distinct().count() == 6 and [r[0] for r in personal.select("customer_id").distinct().collect()] == [1]


def test_rounding_by_whole_numbers_equals_round(spark):
    """Nine places as ``round`` gives them, also at ties, below zero, for large and for missing numbers."""
    values = [(x,) for x in (0.1234567895, 0.1234567885, -0.1234567895, 5e-10, 0.0, 1 / 3, 2 / 3, 1234.5678901235, 1e13 / 7, 1e300, float("nan"), None, 0.3 * 0.9 + 0.123456789 * 0.1)] + [(k * 0.7e-9 + 0.3 * k / 7,) for k in range(500)]
    got = spark.createDataFrame(values, "x double").select(recommend.score("x").alias("a"), F.round("x", 9).alias("b")).collect()
    assert all(repr(r.a) == repr(r.b) for r in got)


@pytest.mark.parametrize("shift", [0, 2**40])
def test_meetings_and_contributions_travel_in_arrays(spark, shift):
    """Rows of an exchange are a customer's products and not their pairs; parts of a hot product and wide ids give the same."""
    rows = [(c, p + shift) for c in range(40) for p in range(30) if (p * 7 + c * 5) % 11 < 6 or p == 3]
    pairs = spark.createDataFrame(rows, "customer_id int, product_id long").withColumn("interaction_score", F.lit(5.0))
    whole, parted = (sorted(map(tuple, recommend.product_similarity(pairs, task_rows=n, top_n=100).collect())) for n in (2_000_000, 100))
    met = {}
    for c, p in rows:
        for d, q in rows:
            if c == d and p != q:
                met[p, q] = met.get((p, q), 0) + 1
    assert whole == parted and {(r[0], r[1]): r[2] for r in whole} == {k: n for k, n in met.items() if n >= 2}
    similarity = recommend.product_similarity(pairs, top_n=100).localCheckpoint()
    made = {(r.customer_id, r.product_id): r for r in recommend.item_item_candidates(pairs, similarity).collect()}
    close, seen = {(r[0], r[1]): r.similarity_score for r in similarity.collect()}, set(rows)
    for c in range(40):
        for p in {q for _, q in rows}:
            sources = {s: close[s, p] for d, s in rows if d == c and (s, p) in close}
            if (c, p) in seen or not sources:
                assert (c, p) not in made
            else:
                r = made[c, p]
                assert abs(r.raw_personalized_score - 5 * sum(sources.values())) < 1e-8 and r.max_similarity == max(sources.values()) and r.supporting_products == len(sources)
                assert r.primary_source_product_id == min(s for s in sources if sources[s] == max(sources.values()))
    plan = recommend.item_item_candidates(pairs, similarity)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Repartition")  # the plan's root comes first: rows are made after the exchange


def test_targets_and_pairs_are_told_in_one_exchange(spark):
    """First meetings of known customers equal looking at each pair; events are not expanded for distinct counts."""
    parts = ("TRAIN", "VALIDATION", "TEST")
    rows = [(c, p, "purchase" if (c + p) % 2 else "product_view", datetime.datetime(2024, 1, 1 + i), 5.0, "orders", f"{c}-{p}-{i % 2}", parts[(c * 5 + p * 3 + i) % 3]) for c in range(9) for p in range(9) for i in range((c * p) % 4)]
    split = spark.createDataFrame(rows, "customer_id int, product_id int, event_type string, event_timestamp timestamp, interaction_weight double, source string, source_event_id string, split string")
    for part, before in (("TEST", ("TRAIN",)), ("TEST", ("TRAIN", "VALIDATION")), ("VALIDATION", ("TRAIN",))):
        earlier = {(r[0], r[1]) for r in rows if r[7] in before}
        wanted = {(r[0], r[1]) for r in rows if r[7] == part and r[0] in {c for c, _ in earlier}} - earlier
        found = evaluation.actuals(split, part, before)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    pairs = recommend.interactions_of_events(split)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan
    for r in pairs.collect():
        mine = [x for x in rows if (x[0], x[1]) == (r.customer_id, r.product_id)]
        assert (r.purchase_count, r.product_view_count) == tuple(len({x[6] for x in mine if x[2] == k}) for k in ("purchase", "product_view")) and r.last_interaction_at == max(x[3] for x in mine)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_customers_give_the_same_rows_without_another_exchange(spark):
    """More contributions than a task's are dealt by ranges of customers; what follows by customer is local to them too."""
    c = Commerce(spark, SMALL)
    pairs = recommend.scored_pairs(c.orders, c.order_items, c.website_events).localCheckpoint()
    similarity, popularity = recommend.product_similarity(pairs).localCheckpoint(), recommend.product_popularity(pairs).localCheckpoint()
    dealt, usual = (recommend.customer_rows(pairs, similarity, popularity, c.customers, task_rows=n) for n in (1000, 10**9))
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, usual.collect()))
    grouped = _plan(dealt.groupBy("customer_id").agg(F.max("max_similarity")))
    assert grouped.count("Exchange rangepartitioning(customer_id") == 1 and "Exchange hashpartitioning(customer_id" not in grouped


def test_similarity_by_ranges_and_without_the_exchange_for_supports(spark):
    """Ranges and known supports change no pair, nor do many products of one customer; few of them cost no table of their own."""
    c = Commerce(spark, SMALL)
    pairs = recommend.scored_pairs(c.orders, c.order_items, c.website_events).localCheckpoint()
    supports = recommend.supports_of(recommend.product_popularity(pairs)).localCheckpoint()
    single = pairs.unionByName(pairs.withColumn("product_id", F.col("product_id") + 1_000_000 * (F.col("customer_id") + 1)))  # each added product has one customer
    wanted = sorted(map(repr, recommend.product_similarity(pairs, task_rows=10**9).collect()))
    assert wanted and all(sorted(map(repr, found.collect())) == wanted for found in (recommend.product_similarity(pairs, support=supports, task_rows=500), recommend.product_similarity(single, task_rows=500)))
    assert sorted(map(repr, recommend.product_similarity(pairs, support=supports, min_customers=30).collect())) == sorted(map(repr, recommend.product_similarity(pairs, min_customers=30, task_rows=500).collect()))


def test_rankings_without_attributes_exchange_nothing_by_product(spark):
    """Queries that show no attribute join no products; popularity adds up pairs once, not again for the largest totals."""
    c = Commerce(spark, SMALL)
    pairs = recommend.scored_pairs(c.orders, c.order_items, c.website_events).localCheckpoint()
    similarity, popularity = recommend.product_similarity(pairs).localCheckpoint(), recommend.product_popularity(pairs)
    assert "hashpartitioning(product_id" not in _plan(popularity)
    popularity = popularity.localCheckpoint()
    rows = recommend.customer_rows(pairs, similarity, popularity, c.customers)
    plain, full = (recommend.hybrid_recommend(c.customers, pairs, rows, popularity, c.products, generated_at=F.lit(0), attributes=a) for a in (False, True))
    assert plain.columns == [n for n in full.columns if n not in recommend.ATTRIBUTES]
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, full.drop(*recommend.ATTRIBUTES).collect()))
    assert "part.parquet" in _plan(full) and "part.parquet" not in _plan(plain)


def test_order_lines_are_those_of_the_items(spark, tmp_path):
    """Of repeated lines the same one stays, though discount and tax are not read."""
    base = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    again = base.where("l_orderkey % 3 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    moved = base.where("l_orderkey % 5 = 0").withColumns({"l_partkey": F.col("l_partkey") + 1, "l_tax": F.col("l_tax") + 1})
    base.unionByName(again).unionByName(moved).unionByName(base.where("l_orderkey % 2 = 0")).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = Commerce(spark, str(tmp_path))
    lines, items = c.order_lines, c.order_items.select("order_id", "product_id", "quantity")
    assert lines.exceptAll(items).count() == items.exceptAll(lines).count() == 0 < lines.count()
    assert "l_tax" in _plan(items) and "l_tax" not in _plan(lines)
