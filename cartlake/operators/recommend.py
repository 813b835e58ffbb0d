"""Co-occurrence recommender: events, interactions, popularity, similarity, candidates and hybrid ranking.

Scores are rounded to nine places before they order anything, and every order ends with an identifier, so ranks do not
depend on how sums were split among tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlake.functions.expressions import is_cancelled
from cartlake.functions.ordered import placed
from cartlake.sources.staging import staged

VIEWS = ("product_view", "view_product", "product_viewed")
ATTRIBUTES = ("product_name", "category", "subcategory", "brand", "price")
BILLION = 1e9  # scores have nine places, so k / 1e9 is the very double that rounding gives


@dataclass(frozen=True)
class Weights:
    """Shares of the personal and the popularity score; not negative, one in sum."""

    personal: float = 0.8
    popularity: float = 0.2

    def __post_init__(self) -> None:
        if min(self.personal, self.popularity) < 0 or abs(self.personal + self.popularity - 1) > 1e-6:
            raise ValueError("weights must not be negative and must sum to 1")


def champion_weights(config: DataFrame) -> Weights:
    """Weights of a configuration table that must have one row."""
    rows = config.select("personalized_weight", "popularity_weight").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} configuration rows instead of one")
    return Weights(*rows[0])


def score(value: Column | str) -> Column:
    """``value`` rounded to nine places, as ``round`` does it. Where no tie is near that is told by whole numbers, as ``round`` takes a
    decimal number a row, which cost more than the ranking itself."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    units = value * BILLION
    plain = (F.abs(units - F.floor(units) - 0.5) > 1e-3) & (F.abs(units) < 1e12)
    return F.when(plain, F.floor(units + 0.5) / BILLION).otherwise(F.round(value, 9))


def _is_whole(column: str) -> Column:
    """Whether the score is a number of billionths that an int holds."""
    units = F.rint(F.col(column) * BILLION)
    return F.coalesce((F.abs(units) < 2**31) & (units / BILLION == F.col(column)), F.lit(False))


def _shortened(column: str, whole: bool) -> Column:
    return F.rint(F.col(column) * BILLION).cast("int") if whole else F.col(column).cast("double")


def customer_product_events(orders: DataFrame, items: DataFrame, web: DataFrame, *, purchase_weight: float = 5.0, view_weight: float = 1.0) -> DataFrame:
    """Purchases of orders that were not cancelled, by quantity, and product views; repeated events count once."""
    bought = orders.where(~is_cancelled("status")).join(items, "order_id").select(
        "customer_id", "product_id", F.lit("purchase").alias("event_type"), F.col("order_date").alias("event_timestamp"), (F.coalesce(F.col("quantity").cast("double"), F.lit(1.0)) * purchase_weight).alias("interaction_weight"), F.lit("orders").alias("source"), F.col("order_id").cast("string").alias("source_event_id"),
    )
    named = F.coalesce(F.col("event_id").cast("string"), F.sha2(F.concat_ws("|", "customer_id", "product_id", F.col("event_timestamp").cast("string")), 256))
    seen = web.where(F.lower("event_type").isin(*VIEWS)).select("customer_id", "product_id", F.lit("product_view").alias("event_type"), "event_timestamp", F.lit(view_weight).alias("interaction_weight"), F.lit("website_events").alias("source"), named.alias("source_event_id"))
    events = bought.unionByName(seen).where("customer_id is not null and product_id is not null and event_timestamp is not null")
    keys = ["customer_id", "product_id", "event_type", "event_timestamp", "source", "source_event_id"]
    return events.groupBy(*keys).agg(F.max("interaction_weight").alias("interaction_weight")).select(*keys[:4], "interaction_weight", *keys[4:], F.col("event_timestamp").cast("date").alias("event_date"))


def interactions_of_events(events: DataFrame, *, purchase_weight: float = 5.0, view_weight: float = 1.0) -> DataFrame:
    """Customer-product pairs with counts and scores. Rows meet in one exchange by pair; there each event counts once."""
    is_purchase = F.col("event_type") == "purchase"
    known = F.col("source_event_id").isNotNull()
    once = events.repartition("customer_id", "product_id").groupBy("customer_id", "product_id", "source_event_id").agg(
        F.max(is_purchase & known).cast("long").alias("bought"), F.max(~is_purchase & known).cast("long").alias("seen"), F.sum(F.when(is_purchase, F.col("interaction_weight") / purchase_weight)).alias("units"),
        F.max(F.when(is_purchase, F.col("event_timestamp"))).alias("bought_at"), F.max(F.when(~is_purchase, F.col("event_timestamp"))).alias("seen_at"),
    )
    return _scored(once, purchase_weight, view_weight)


def _scored(once: DataFrame, purchase_weight: float = 5.0, view_weight: float = 1.0) -> DataFrame:
    """Pairs of rows that each hold a number of purchases or views, with counts, times and scores."""
    pairs = once.groupBy("customer_id", "product_id").agg(
        F.coalesce(F.sum("bought"), F.lit(0)).alias("purchase_count"), F.coalesce(F.sum("units"), F.lit(0.0)).alias("units_purchased"), F.coalesce(F.sum("seen"), F.lit(0)).alias("product_view_count"), F.max("bought_at").alias("last_purchase_at"), F.max("seen_at").alias("last_view_at"),
    )
    return pairs.withColumns({"purchase_score": F.col("purchase_count") * purchase_weight, "view_score": F.col("product_view_count") * view_weight, "last_interaction_at": F.greatest("last_purchase_at", "last_view_at")}).withColumn("interaction_score", F.col("purchase_score") + F.col("view_score"))


def scored_pairs(orders: DataFrame, items: DataFrame, web: DataFrame) -> DataFrame:
    """Purchases and views of each customer and product, from their own tables. An order's lines of a product become one row
    where the order is, and views one row a pair, so that both meet in one exchange without distinct counts."""
    bought = orders.where(~is_cancelled("status")).join(items, "order_id").where("customer_id is not null and product_id is not null")
    bought = bought.groupBy("order_id", "customer_id", "product_id").agg(F.sum(F.coalesce(F.col("quantity").cast("double"), F.lit(1.0))).alias("units"), F.max("order_date").alias("bought_at")).select("customer_id", "product_id", F.lit(1).cast("long").alias("bought"), "units", "bought_at")
    seen = web.where(F.lower("event_type").isin(*VIEWS)).where("customer_id is not null and product_id is not null").groupBy("customer_id", "product_id").agg(F.countDistinct("event_id").alias("seen"), F.max("event_timestamp").alias("seen_at"))
    return _scored(bought.unionByName(seen, allowMissingColumns=True))


def interactions(orders: DataFrame, items: DataFrame, web: DataFrame, products: DataFrame) -> DataFrame:
    """``scored_pairs`` with the product's attributes."""
    attributes = products.select("product_id", *ATTRIBUTES[:-1], F.col("price").cast("double").alias("price"))
    return scored_pairs(orders, items, web).join(attributes, "product_id", "left").select(
        "customer_id", "product_id", *ATTRIBUTES, "purchase_count", "units_purchased", "product_view_count", "purchase_score", "view_score", "interaction_score", "last_purchase_at", "last_view_at", "last_interaction_at",
    )


METRICS = {"unique_customers": 0.30, "total_purchases": 0.35, "total_views": 0.10, "total_interaction_score": 0.25}


def product_popularity(pairs: DataFrame) -> DataFrame:
    """Each product's totals and the weighted sum of their shares of the largest product's totals; ``pairs`` has one row a pair."""
    totals = pairs.groupBy("product_id").agg(F.count("customer_id").alias("unique_customers"), F.sum("purchase_count").alias("total_purchases"), F.sum("units_purchased").alias("total_units"), F.sum("product_view_count").alias("total_views"), F.sum("interaction_score").alias("total_interaction_score"), F.max("last_interaction_at").alias("last_interaction_at"))
    totals = staged(totals, "totals")  # read twice: for the largest ones, and for the shares
    most = totals.agg(*(F.max(c).alias(f"max_{c}") for c in METRICS))  # one row
    shares = [F.when(F.col(f"max_{c}") > 0, F.col(c) / F.col(f"max_{c}")).otherwise(F.lit(0.0)) * w for c, w in METRICS.items()]
    return totals.crossJoin(F.broadcast(most)).withColumn("popularity_score", score(sum(shares[1:], shares[0]))).drop(*(f"max_{c}" for c in METRICS))


def ranked_within(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """``name``: place from 1 within the groups (of all rows, if none are named), in an order that leaves no ties.

    Rows are sorted by range over (groups, order), so a group is as many tasks as its rows need; a group's rank is the
    place less the group's first one.
    """
    rows = placed(df, [*groups, *order], name="_place")
    if not groups:
        return rows.withColumn(name, F.col("_place") + 1).drop("_place")
    first = rows.groupBy(*(F.col(g).alias(f"_{g}") for g in groups)).agg(F.min("_place").alias("_first"))
    same = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups))
    return rows.join(first, same).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", *(f"_{g}" for g in groups))


def popularity_ranks(popularity: DataFrame, products: DataFrame) -> DataFrame:
    """Rank among all products and within category, subcategory and brand; ties by customers, then id."""
    order = [F.desc("popularity_score"), F.desc("unique_customers"), F.asc("product_id")]
    df = popularity.join(products.select("product_id", *ATTRIBUTES[:-1], F.col("price").cast("double").alias("price")), "product_id", "left")
    for name, groups in (("popularity_rank", []), ("category_rank", ["category"]), ("subcategory_rank", ["category", "subcategory"]), ("brand_rank", ["brand"])):
        df = ranked_within(df, groups, order, name)
    return df


def spread(df: DataFrame, rows: int, *by: str, task_rows: int = 2_000_000, ranges: bool = False) -> DataFrame:
    """``df`` dealt by these columns so that ``rows`` rows, made after the exchange, come to at most about ``task_rows`` a task and none spills.

    With ``ranges``, more rows than a task's are dealt by ranges of the columns, which groups by them are as local to as by hashes. Where near
    identifiers share what the rows carry, equal arrays then lie side by side and are compressed to one, however many the tasks
    are. Ranges hold about equal numbers of rows of ``df``, whose arrays may be twice as long as usual, so there are twice as many.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges and rows > task_rows:
        return df.repartitionByRange(max(-(-2 * rows // task_rows), usual), *by)
    return df.repartition(max(2, -(-rows // task_rows), min(usual, -(-rows // 50_000))), *by)


def supports_of(popularity: DataFrame) -> DataFrame:
    """Numbers of customers by product, as ``product_similarity`` takes them."""
    return popularity.select("product_id", F.col("unique_customers").alias("support"))


def product_similarity(pairs: DataFrame, *, support: DataFrame | None = None, min_customers: int = 2, min_co: int = 2, top_n: int = 50, block: int = 2000, task_rows: int = 2_000_000) -> DataFrame:
    """Cosine and Jaccard similarity of products by common customers, the best of each product, in both directions.

    ``pairs`` has one row a customer and product; ``support``, if it is known, one a product. Products below the support go before the self join,
    unless they hold too few rows to be worth the exchange and ``min_co`` leaves them out of all pairs anyway. A customer's products are cut into
    blocks of about ``block``, and (customer, block, block) is the join's key where there are several, so that a task has at most
    the pairs of two blocks, however many products one customer has. A pair meets once, at its smaller product, and travels as an
    entry of that product's array of larger ones; it becomes a row after the exchange. A product with many
    meetings is dealt into parts by the larger product.
    """
    kept = pairs.select("customer_id", "product_id")
    if support is None:
        support = staged(kept.groupBy("product_id").agg(F.count("*").alias("support")), "support")
    low = F.col("support") < min_customers
    lost = support.agg(F.coalesce(F.sum(F.when(low, F.col("support"))), F.lit(0)).alias("low"), F.coalesce(F.sum("support"), F.lit(0)).alias("rows")).first()
    support = support.where(~low)
    if min_co < min_customers or 10 * lost.low > lost.rows:
        kept = staged(kept.join(support.select("product_id"), "product_id", "left_semi"), "kept")
    sizes = kept.groupBy("customer_id").agg(F.count("*").alias("n"), F.min("product_id").alias("low"), F.max("product_id").alias("high"))
    about = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("meetings"), F.coalesce(F.sum("n"), F.lit(1)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    narrow = about.high is not None and -(2**31) <= about.low and about.high < 2**31
    id_type = dict(pairs.dtypes)["product_id"]
    parts = F.ceil(F.col("support") * (2 * about.meetings / about.rows) / task_rows).cast("int")
    hot = support.select("product_id", parts.alias("parts")).where("parts > 1")
    entry = F.struct(F.col("product_id").cast("int" if narrow else id_type).alias("p"), F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = spread(kept.join(F.broadcast(hot), "product_id", "left"), about.meetings, "customer_id", task_rows=task_rows)  # at most two products a task
    if about.most <= block:
        lists = dealt.groupBy("customer_id").agg(F.array_sort(F.collect_list(entry)).alias("held"))
        met = lists.select("held", F.posexplode("held").alias("i", "a")).select("a", F.expr("slice(held, i + 2, size(held))").alias("larger"))
    else:
        n_blocks = dealt.groupBy("customer_id").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
        placed_in = dealt.join(n_blocks, "customer_id").withColumn("block", F.pmod(F.xxhash64("product_id"), F.col("n_blocks")).cast("int"))
        lists = placed_in.groupBy("customer_id", "n_blocks", "block").agg(F.collect_list(entry).alias("held"))
        left = lists.select("customer_id", F.col("block").alias("low"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("high"), "held")
        right = lists.select("customer_id", F.col("block").alias("high"), F.col("held").alias("others"))
        met = left.join(right, ["customer_id", "high"]).select(F.explode("held").alias("a"), "others").select("a", F.filter("others", lambda x: x["p"] > F.col("a.p")).alias("larger"))
    met = met.where(F.size("larger") > 0).select(F.col("a.p").alias("a"), F.col("a.parts").alias("parts"), F.transform("larger", lambda x: x["p"]).alias("larger"))
    met = met.select("a", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "larger")
    met = met.select("a", "part", F.when(F.col("parts") == 1, F.col("larger")).otherwise(F.filter("larger", lambda x: F.pmod(F.xxhash64(x), F.col("parts")) == F.col("part"))).alias("larger"))
    met = spread(met, about.meetings, "a", "part", task_rows=task_rows, ranges=True).select("a", "part", F.explode("larger").alias("b"))
    met = met.groupBy("a", "part", "b").agg(F.count("*").alias("co")).where(F.col("co") >= min_co).select(F.col("a").cast(id_type).alias("a"), F.col("b").cast(id_type).alias("b"), "co")
    for side in ("a", "b"):  # supports join the pairs that stay, not each meeting
        met = met.join(support.select(F.col("product_id").alias(side), F.col("support").alias(f"n_{side}")), side)
    met = met.withColumns({"similarity_score": score(F.col("co") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b"))), "jaccard_score": score(F.col("co") / (F.col("n_a") + F.col("n_b") - F.col("co")))})
    return top_similar(symmetrize(met), top_n)


def symmetrize(met: DataFrame) -> DataFrame:
    """Pairs a < b in both directions; one pass duplicates each row."""
    sides = F.array(F.struct(F.col("a").alias("source_product_id"), F.col("b").alias("similar_product_id"), F.col("n_a").alias("source_customer_count"), F.col("n_b").alias("similar_customer_count")), F.struct(F.col("b").alias("source_product_id"), F.col("a").alias("similar_product_id"), F.col("n_b").alias("source_customer_count"), F.col("n_a").alias("similar_customer_count")))
    return met.select(F.explode(sides).alias("s"), F.col("co").alias("co_interaction_count"), "similarity_score", "jaccard_score").select("s.source_product_id", "s.similar_product_id", "co_interaction_count", "s.source_customer_count", "s.similar_customer_count", F.least(F.lit(1.0), "similarity_score").alias("similarity_score"), "jaccard_score")


def top_similar(edges: DataFrame, n: int = 50) -> DataFrame:
    best = Window.partitionBy("source_product_id").orderBy(F.desc("similarity_score"), F.desc("co_interaction_count"), "similar_product_id")
    return edges.withColumn("similarity_rank", F.row_number().over(best)).where(F.col("similarity_rank") <= n)


def customer_rows(pairs: DataFrame, similarity: DataFrame, popularity: DataFrame | None = None, customers: DataFrame | None = None, *, task_rows: int = 2_000_000) -> DataFrame:
    """A row a customer and product: what the customer interacted with (``is_personal`` false) and unseen products similar to it, with
    summed contributions (true); with ``customers``, also a row of each without a product (null).

    Contributions, what was seen and customers meet in one exchange by customer, so that grouping by product and what
    follows by customer need no other. A customer has at most as many contributions as products times ``top_n``. They travel as
    one row a customer and product with arrays of what is similar to it, whose scores, if they have nine places, are whole numbers
    of billionths; they become rows after the exchange. ``pairs`` and ``similarity`` have one row a pair. With
    ``popularity``, its score joins the edges (a few for each product) and not the contributions.
    """
    id_type = dict(pairs.dtypes)["product_id"]
    if "source_customer_count" in similarity.columns:
        made = similarity.agg(F.sum("source_customer_count"))
    else:
        made = similarity.groupBy("source_product_id").agg(F.count("*").alias("n")).join(pairs.groupBy(F.col("product_id").alias("source_product_id")).agg(F.count("*").alias("m")), "source_product_id").agg(F.sum(F.col("n") * F.col("m")))
    contributions = made.first()[0] or 0
    about = similarity.agg(F.min("similar_product_id").alias("low"), F.max("similar_product_id").alias("high"), F.min(_is_whole("similarity_score")).alias("whole")).first()
    narrow = about.high is not None and -(2**31) <= about.low and about.high < 2**31
    short = {"s": bool(about.whole)}
    edges = similarity.select("source_product_id", F.col("similar_product_id").alias("p"), _shortened("similarity_score", short["s"]).alias("s"))
    arrays = ["p", "s"]
    if popularity is not None:
        short["q"] = bool(popularity.agg(F.min(_is_whole("popularity_score"))).first()[0])
        edges = edges.join(popularity.select(F.col("product_id").alias("p"), _shortened("popularity_score", short["q"]).alias("q")), "p", "left").withColumn("q", F.coalesce("q", F.lit(0)))
        arrays.append("q")
    edges = edges.withColumn("p", F.col("p").cast("int" if narrow else id_type))
    near = edges.groupBy("source_product_id").agg(F.collect_list(F.struct(*arrays)).alias("near")).select("source_product_id", *(F.col(f"near.{c}").alias(c) for c in arrays))
    own = pairs.select("customer_id", F.col("product_id").alias("source_product_id"), "interaction_score").join(near, "source_product_id", "left")
    if customers is not None:
        own = own.unionByName(customers.select("customer_id"), allowMissingColumns=True)
    all_met = F.concat(F.coalesce(F.col("p").cast(f"array<{id_type}>"), F.array().cast(f"array<{id_type}>")), F.array("source_product_id"))  # the last is the product itself
    rows = spread(own, contributions, "customer_id", task_rows=task_rows, ranges=True).select("customer_id", "source_product_id", "interaction_score", *arrays[1:], F.posexplode(all_met).alias("i", "product_id"))
    rows = rows.withColumns({c: F.get(c, "i") for c in arrays[1:]})
    rows = rows.withColumns({"source_product_id": F.when(F.col("s").isNotNull(), F.col("source_product_id")), "similarity_score": F.col("s") / (BILLION if short["s"] else 1.0)})
    contribution = F.col("interaction_score") * F.col("similarity_score")
    summed = {"raw_personalized_score": score(F.sum(contribution)), "max_similarity": F.max("similarity_score"), "supporting_products": F.count("source_product_id"), "primary_source_product_id": F.max_by("source_product_id", F.when(F.col("source_product_id").isNotNull(), F.struct(score(contribution).alias("c"), (-F.col("source_product_id")).alias("s"))))}
    if popularity is not None:
        summed["popularity_score"] = F.coalesce(F.max("q"), F.lit(0)) / (BILLION if short["q"] else 1.0)
    met = rows.groupBy("customer_id", "product_id").agg(*(v.alias(n) for n, v in summed.items()), F.max(F.col("source_product_id").isNull()).alias("_seen"))
    personal = F.when(F.col("product_id").isNotNull(), ~F.col("_seen"))
    return met.select("customer_id", "product_id", *(F.when(personal, F.col(n)).alias(n) for n in summed), personal.alias("is_personal"))


def item_item_candidates(pairs: DataFrame, similarity: DataFrame, popularity: DataFrame | None = None) -> DataFrame:
    """Unseen products similar to what a customer interacted with, with summed contributions; with their ``popularity_score``
    if ``popularity`` is given."""
    return customer_rows(pairs, similarity, popularity).where("is_personal").drop("is_personal")


def described(df: DataFrame, products: DataFrame) -> DataFrame:
    """With the products' attributes."""
    return df.join(products.select("product_id", *ATTRIBUTES[:-1], F.col("price").cast("double").alias("price")), "product_id", "left")


def ranked(df: DataFrame, by: str, k: int, rank: str = "recommendation_rank") -> DataFrame:
    best = Window.partitionBy("customer_id").orderBy(F.desc(by), "product_id")
    return df.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k)


def item_item_recommend(pairs: DataFrame, similarity: DataFrame, products: DataFrame, *, generated_at: Column | None = None, k: int = 10) -> DataFrame:
    """The k products with the largest sums of contributions, in 15 columns."""
    best = ranked(item_item_candidates(pairs, similarity), "raw_personalized_score", k)
    stamped = described(best, products).withColumns({"recommendation_reason": F.lit("similar_to_customer_history"), "model_name": F.lit("item_item_cosine_v1"), "generated_at": F.current_timestamp() if generated_at is None else generated_at})
    return stamped.select("customer_id", "product_id", *ATTRIBUTES, F.col("raw_personalized_score").alias("recommendation_score"), "recommendation_rank", "max_similarity", "supporting_products", "primary_source_product_id", "recommendation_reason", "model_name", "generated_at")


def cold_start_recommend(customers: DataFrame, pairs: DataFrame, popularity: DataFrame, *, k: int = 10) -> DataFrame:
    """The k most popular products for each customer without history."""
    top = popularity.orderBy(F.desc("popularity_score"), F.desc("unique_customers"), "product_id").limit(k)
    top = top.select("product_id", "popularity_score", F.row_number().over(Window.orderBy(F.desc("popularity_score"), F.desc("unique_customers"), "product_id")).alias("recommendation_rank"))
    new = customers.select("customer_id").join(pairs.select("customer_id").distinct(), "customer_id", "left_anti")
    return new.crossJoin(F.broadcast(top))  # k rows


def normalise_per_customer(candidates: DataFrame) -> DataFrame:
    """Personal scores as shares of the customer's largest one."""
    most = F.max("raw_personalized_score").over(Window.partitionBy("customer_id"))
    return candidates.withColumn("personalized_score", score(F.when(most > 0, F.col("raw_personalized_score") / most).otherwise(F.lit(0.0))))


def recommendation_reason(history: Column, personal: Column, popularity: Column) -> Column:
    mixed = F.when(popularity > 0, "hybrid_personalized").otherwise("personalized_similarity")
    return F.when(~history, "popular_cold_start").when(personal, mixed).otherwise("popular_fallback")


def hybrid_candidates(customers: DataFrame, pairs: DataFrame, personal: DataFrame, popularity: DataFrame, *, candidate_limit: int = 100) -> DataFrame:
    """Each customer's unseen candidates from both sides, with both scores and whether the customer has a history.

    The popular side has a fixed number of products, so each customer meets that many.
    """
    scores = popularity.select("product_id", "popularity_score")
    popular = popularity.orderBy(F.desc("popularity_score"), F.desc("unique_customers"), "product_id").limit(candidate_limit).select("product_id")
    wide = customers.select("customer_id").crossJoin(F.broadcast(popular)).withColumn("is_personal", F.lit(False))
    close = normalise_per_customer(personal).select("customer_id", "product_id", "personalized_score", "raw_personalized_score", "max_similarity", "supporting_products", "primary_source_product_id", F.lit(True).alias("is_personal"))
    merged = wide.unionByName(close, allowMissingColumns=True).groupBy("customer_id", "product_id").agg(*(F.max(c).alias(c) for c in ("personalized_score", "raw_personalized_score", "max_similarity", "supporting_products", "primary_source_product_id", "is_personal")))
    unseen = merged.join(pairs.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_anti")
    history = pairs.select("customer_id").distinct().withColumn("has_history", F.lit(True))
    return unseen.join(history, "customer_id", "left").join(scores, "product_id", "left").withColumns({"has_history": F.coalesce("has_history", F.lit(False)), "popularity_score": F.coalesce("popularity_score", F.lit(0.0)), "personalized_score": F.coalesce("personalized_score", F.lit(0.0))})


def hybrid_score(weights: Weights, *, fallback_scaled: bool) -> Column:
    mixed = F.col("personalized_score") * weights.personal + F.col("popularity_score") * weights.popularity
    return score(mixed if fallback_scaled else F.when(F.col("is_personal"), mixed).otherwise(F.col("popularity_score")))


HYBRID = ("customer_id", "product_id", *ATTRIBUTES, "recommendation_rank", "recommendation_score", "personalized_score", "popularity_score", "hybrid_score", "max_similarity", "supporting_products", "primary_source_product_id", "has_history", "recommendation_reason", "model_name", "model_version", "generated_at")


def hybrid_recommend(
    customers: DataFrame, pairs: DataFrame, personal: DataFrame, popularity: DataFrame, products: DataFrame, *, weights: Weights = Weights(), k: int = 10, candidate_limit: int = 100, fallback_scaled: bool = False,
    model_name: str = "hybrid_item_item_popularity", model_version: str = "v1", generated_at: Column | None = None, attributes: bool = True,
) -> DataFrame:
    """Top k by the weighted score, in 20 columns, or without the products' attributes, whose join exchanges all that is recommended. Without a personal side the popularity counts whole, or by its weight (``fallback_scaled``).

    Personal candidates, what was seen of the popular products, and the customers meet in one exchange by customer, unless
    ``personal`` holds them all already (``customer_rows`` with popularity and customers). There a
    customer keeps the k best personal candidates; the popular products are one array of ``candidate_limit`` entries,
    in order, that each customer filters and cuts to k; the two short arrays are merged.
    """
    if "popularity_score" not in personal.columns:
        personal = personal.join(popularity.select("product_id", "popularity_score"), "product_id", "left").na.fill({"popularity_score": 0.0})
    scaled = weights.popularity if fallback_scaled else 1.0
    popular = popularity.orderBy(F.desc("popularity_score"), F.desc("unique_customers"), "product_id").limit(candidate_limit)
    entry = F.struct((-score(F.col("popularity_score") * scaled)).alias("s"), "product_id", "popularity_score")
    listed = popular.agg(F.array_sort(F.collect_list(entry)).alias("popular"))  # one row of a bounded array
    popular = popular.select("product_id", F.lit(True).alias("is_popular"))

    about = ("raw_personalized_score", "popularity_score", "max_similarity", "supporting_products", "primary_source_product_id")
    rows = personal
    if "is_personal" not in personal.columns:
        close = personal.select("customer_id", "product_id", *about, F.lit(True).alias("is_personal"))
        seen = pairs.select("customer_id", "product_id", F.lit(False).alias("is_personal"))
        rows = customers.select("customer_id").unionByName(close.unionByName(seen, allowMissingColumns=True), allowMissingColumns=True)
    rows = rows.join(F.broadcast(popular), "product_id", "left")
    each = Window.partitionBy("customer_id")
    most = F.max("raw_personalized_score").over(each)
    rows = rows.withColumn("personalized_score", score(F.when(most > 0, F.col("raw_personalized_score") / most).otherwise(F.lit(0.0))))
    rows = rows.withColumn("mixed", score(F.col("personalized_score") * weights.personal + F.col("popularity_score") * weights.popularity))
    rows = rows.withColumn("place", F.row_number().over(each.orderBy(F.coalesce("is_personal", F.lit(False)).desc(), F.desc("mixed"), "product_id")))

    held = F.struct((-F.col("mixed")).alias("s"), "product_id", "popularity_score", "mixed", "personalized_score", *about[2:], F.lit(True).alias("is_personal"))
    taken = F.when(F.col("is_popular"), F.col("product_id"))
    rows = rows.where(~F.coalesce("is_personal", F.lit(False)) | (F.col("place") <= k) | F.col("is_popular"))  # the others change nothing below
    found = rows.groupBy("customer_id").agg(
        F.collect_list(F.when(F.col("is_personal") & (F.col("place") <= k), held)).alias("best"), F.collect_set(taken).alias("taken"), F.max(F.coalesce(~F.col("is_personal"), F.lit(False))).alias("has_history"), F.max(F.col("product_id").isNull()).alias("asked"),
    ).where("asked").crossJoin(F.broadcast(listed))
    nulls = {"personalized_score": F.lit(0.0), "max_similarity": F.lit(None).cast("double"), "supporting_products": F.lit(None).cast("long"), "primary_source_product_id": F.lit(None).cast(dict(pairs.dtypes)["product_id"])}
    fallback = F.transform(F.slice(F.filter("popular", lambda x: ~F.array_contains("taken", x["product_id"])), 1, k), lambda x: F.struct(x["s"].alias("s"), x["product_id"].alias("product_id"), x["popularity_score"].alias("popularity_score"), score(x["popularity_score"] * weights.popularity).alias("mixed"), *(v.alias(n) for n, v in nulls.items()), F.lit(False).alias("is_personal")))
    chosen = found.select("customer_id", "has_history", F.posexplode(F.slice(F.array_sort(F.concat("best", fallback)), 1, k)).alias("i", "r"))
    flat = chosen.select("customer_id", "has_history", (F.col("i") + 1).cast("int").alias("recommendation_rank"), "r.*")
    flat = described(flat, products) if attributes else flat
    flat = flat.withColumns({"recommendation_score": -F.col("s"), "hybrid_score": F.col("mixed"), "recommendation_reason": recommendation_reason(F.col("has_history"), F.col("is_personal"), F.col("popularity_score"))})
    stamped = flat.withColumns({"model_name": F.lit(model_name), "model_version": F.lit(model_version), "generated_at": F.current_timestamp() if generated_at is None else generated_at})
    return stamped.select(*(c for c in HYBRID if attributes or c not in ATTRIBUTES))


def production_recommend(customers: DataFrame, pairs: DataFrame, similarity: DataFrame, popularity: DataFrame, products: DataFrame, *, weights: Weights, run_id: str, generated_at: Column, k: int = 10, model_name: str = "hybrid_item_item_popularity", attributes: bool = True) -> DataFrame:
    """The ranking with the champion's weights for all candidates, stamped with its run."""
    made = hybrid_recommend(customers, pairs, customer_rows(pairs, similarity, popularity, customers), popularity, products, weights=weights, k=k, fallback_scaled=True, model_name=model_name, generated_at=generated_at, attributes=attributes)
    return made.withColumns({"run_id": F.lit(run_id), "personalized_weight": F.lit(weights.personal), "popularity_weight": F.lit(weights.popularity)})


REASONS = ("popular_cold_start", "hybrid_personalized", "personalized_similarity", "popular_fallback")


def run_history_row(recommended: DataFrame, customers: DataFrame, *, run_id: str, seconds: float = 0.0) -> DataFrame:
    """One row about a run: numbers by reason, customers reached and status."""
    counts = [F.count(F.when(F.col("recommendation_reason") == r, 1)).alias(r) for r in REASONS]
    reached = recommended.agg(F.count("*").alias("recommendations"), F.countDistinct("customer_id").alias("customers_reached"), F.countDistinct("product_id").alias("products_recommended"), *counts)
    known = customers.agg(F.countDistinct("customer_id").alias("customers"))
    return reached.crossJoin(known).withColumns({"run_id": F.lit(run_id), "duration_seconds": F.lit(seconds), "status": F.when(F.col("recommendations") > 0, "SUCCESS").otherwise("EMPTY")})
