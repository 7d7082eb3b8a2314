"""Analytics on top of nearest neighbours: votes, payloads, purchases, price filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import store
from .bitmaps import bitmaps, common, sizes, within
from .neighbours import knn_join
from .ranking import cumulative
from .skew import frequent_keys, join_hubs


def _with_items(neighbours: DataFrame, items: DataFrame) -> DataFrame:
    """Neighbour rows joined with what belongs to their items. An item that is near to very
    many queries is found by a sketch and its rows are dealt over many tasks.

    The neighbours are read twice, so they are written first: k rows per query.
    """
    near = store(neighbours, "near")
    return join_hubs(near, items, "item_id", frequent_keys(near, "item_id"), by=["query_id"])


def vote(neighbours: DataFrame, queries: DataFrame, labels: DataFrame, query_id: str = "query_id",
         item_id: str = "item_id", label: str = "label", min_votes: int = 3) -> DataFrame:
    """Count positive neighbours per query; a query without neighbours is negative."""
    marked = _with_items(neighbours.select("query_id", "item_id"), labels.select(F.col(item_id).alias("item_id"), F.col(label)))
    votes = marked.groupBy("query_id").agg(F.count_if(F.col(label)).alias("votes"))
    found = F.coalesce(F.col("votes"), F.lit(0).cast("bigint"))
    return (queries.select(F.col(query_id).alias("query_id")).join(votes, "query_id", "left")
            .select("query_id", found.alias("votes"), (found >= min_votes).alias("predicted")))


def knn_vote(queries: DataFrame, items: DataFrame, label: str = "label", k: int = 5,
             min_votes: int = 3, query_id: str = "query_id", item_id: str = "item_id",
             metric: str = "l2", **options) -> DataFrame:
    """Classify queries by their k nearest items: ``(query_id, votes, predicted)``."""
    near = knn_join(queries, items, k, metric, query_id, item_id, **options)
    return vote(near, queries, items, query_id, item_id, label, min_votes)


def attach_payload(neighbours: DataFrame, items: DataFrame, item_id: str,
                   payload: Sequence[str]) -> DataFrame:
    """Fetch columns of the neighbours late, so the search reads only ids and vectors."""
    thin = items.select(F.col(item_id).alias("item_id"), *payload)
    return _with_items(neighbours, thin)


def knn_payload(queries: DataFrame, items: DataFrame, payload: Sequence[str], k: int = 5,
                query_id: str = "query_id", item_id: str = "item_id", metric: str = "l2",
                **options) -> DataFrame:
    near = knn_join(queries, items, k, metric, query_id, item_id, **options)
    return attach_payload(near, items, item_id, payload)


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str, ids_key: str | None = None) -> DataFrame:
    """Rows whose key is among the ids, each once however often the id occurs.

    Ids are made distinct first, so a frequent one is a single row in the join.
    """
    wanted = ids.select(F.col(ids_key or key).alias("_wanted")).distinct()
    return df.join(wanted, df[key] == F.col("_wanted"), "left_semi")


def fetch_by_ids(neighbours: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Second step of a two-step fetch: every matched row once over all queries."""
    return semi_join_ids(table, neighbours, key, "item_id")


def _bought(neighbours: DataFrame, purchases: DataFrame, per_query: bool) -> DataFrame:
    """Distinct products bought by the matched customers.

    Purchases are made distinct and matched ids counted once before the join,
    so a customer with very many purchases or matches is small when it gets there.
    """
    pairs = purchases.select("customer_id", "product_id")
    if not per_query:
        return semi_join_ids(pairs, neighbours, "customer_id", "item_id").select("product_id").distinct()
    # Read three times; k rows per query are written so that the search runs once.
    matched = store(neighbours.select("query_id", F.col("item_id").alias("customer_id")), "matched")
    pairs = semi_join_ids(pairs, matched, "customer_id").distinct()
    found = join_hubs(matched, pairs, "customer_id", frequent_keys(matched, "customer_id"), by=["query_id"])
    return found.select("query_id", "product_id").distinct()


def knn_purchases(neighbours: DataFrame, purchases: DataFrame, products: DataFrame,
                  reviews: DataFrame, min_rating: int = 4, per_query: bool = False) -> DataFrame:
    """Products bought by the matched customers that some review rates highly.

    Distinct over the whole batch, or within each query with ``per_query``.
    """
    rated = reviews.where(F.col("rating") >= min_rating)
    named = semi_join_ids(products.select("product_id", "name"), rated, "product_id")
    keys = ["query_id"] if per_query else []
    return _bought(neighbours, purchases, per_query).join(named, "product_id").select(
        *keys, "product_id", "name")


def knn_hybrid(neighbours: DataFrame, purchases: DataFrame, products: DataFrame,
               category: str, low: float, high: float) -> DataFrame:
    """Products bought by the matched customers within a category and price range."""
    wanted = products.where((F.col("category") == category) & F.col("price").between(low, high))
    wanted = wanted.select("product_id", "name", "price")
    return _bought(neighbours, purchases, False).join(wanted, "product_id")


def price_range(products: DataFrame, fractions: Sequence[float], category: str = "category",
                price: str = "price") -> DataFrame:
    """Bounds that let about a fraction of a category pass, for every category.

    Low is the cheapest price, high the n-th cheapest with
    ``n = max(1, round(fraction * products))``, halves rounded to even. Prices
    are counted first, so a category is ranked over its distinct prices.
    """
    counts = (products.where(F.col(price).isNotNull()).groupBy(category, price)
              .agg(F.count(F.lit(1)).alias("_n")))
    ranked = cumulative(counts, [category], price, "_n", "_upto", "_total")

    def high(fraction: float) -> Column:
        wanted = F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("_total")))
        return F.min(F.when(F.col("_upto") >= F.least(wanted, F.col("_total")), F.col(price)))

    ranges = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), high(float(f)).alias("high")) for f in fractions])
    return (ranked.groupBy(F.col(category).alias("category"))
            .agg(F.min(price).alias("low"), F.max("_total").alias("in_category"), ranges.alias("_ranges"))
            .select("category", F.inline("_ranges"), "low", "in_category")
            .select("category", "fraction", "low", "high", "in_category"))


def fraction_sweep(neighbours: DataFrame, purchases: DataFrame, products: DataFrame,
                   fractions: Sequence[float]) -> DataFrame:
    """For every category and fraction: products within the price range and how many
    of them the matched customers bought. Equal prices at the upper bound count.
    """
    # A product is in the bitmap of the smallest fraction whose range holds it, and counts for the larger ones.
    # Low is the category minimum, so the range test is an upper bound.
    order = {float(f): n for n, f in enumerate(sorted(fractions))}
    place = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    ranges = price_range(products, fractions).withColumn("band", place[F.col("fraction")])
    highs = ranges.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("band", "high"))).alias("highs"))
    first = F.get(F.filter("highs", lambda r: F.col("price") <= r["high"]), F.lit(0))["band"]
    placed = (products.select("product_id", "category", "price").join(highs, "category")
              .withColumn("band", first).where("band IS NOT NULL"))
    by = ["category", "band"]
    sets = store(bitmaps(placed, "product_id", *by), "bands")
    bought = bitmaps(_bought(neighbours, purchases, False), "product_id")
    counted = sizes(sets, *by, out="eligible").join(sizes(within(sets, bought, *by), *by, out="matched"), by, "left")
    own = ranges.select("category", "fraction", "low", "high", F.col("band").alias("upto"))
    return (own.join(counted, (own["category"] == counted["category"]) & (own["upto"] >= counted["band"]))
            .groupBy(own["category"], "fraction").agg(
                F.max("low").alias("low"), F.max("high").alias("high"), F.sum("eligible").alias("eligible"),
                F.coalesce(F.sum("matched"), F.lit(0)).alias("matched")))


def eligible_products(purchases: DataFrame, reviews: DataFrame, min_rating: int = 4) -> DataFrame:
    """Products that were bought and rated highly."""
    rated = reviews.where(F.col("rating") >= min_rating).select("product_id")
    return purchases.select("product_id").intersect(rated)


def eligible_share(eligible: DataFrame, products: DataFrame) -> DataFrame:
    """Number of eligible products and their share of all products."""
    marked = products.select("product_id").join(
        eligible.withColumn("_hit", F.lit(1)), "product_id", "left")
    return marked.agg(
        F.count("_hit").alias("eligible"), F.count(F.lit(1)).alias("products"),
        (F.count("_hit") / F.count(F.lit(1))).alias("share"))


def eligible_counts(purchases: DataFrame, reviews: DataFrame, products: DataFrame, min_rating: int = 4) -> DataFrame:
    """Number of products that were bought and rated highly, and their share of all products, from bitmaps."""
    rated = reviews.where(F.col("rating") >= min_rating)
    every = bitmaps(products, "product_id")
    both = common(*(bitmaps(side, "product_id") for side in (purchases, rated, products)))
    return sizes(both, out="eligible").join(sizes(every, out="products")).withColumn(
        "share", F.col("eligible") / F.col("products"))
