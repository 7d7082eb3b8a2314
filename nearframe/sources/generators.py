"""Deterministic products and shop data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pick, stable_number
from ..functions.vectors import let
from ..operators.loading import uniform
from .reviews import CATEGORIES

# Word lists, tier shares and value ranges of the generated data.
PRODUCT_ADJECTIVES = ["Premium", "Professional", "Essential", "Advanced", "Classic"]
SHOP_ADJECTIVES = ["Premium", "Professional", "Essential", "Advanced", "Classic",
                   "Compact", "Deluxe", "Ultra", "Budget", "Standard"]
TIERS = [("bronze", 0.50), ("silver", 0.30), ("gold", 0.15), ("platinum", 0.05)]
REVIEWED_SHARE = 0.70
PRODUCTS_PER_CUSTOMER = 5
MIN_PRODUCTS = 50


def generate_products(ids: DataFrame, key: str = "id", text: str | None = None) -> DataFrame:
    """Nested products numbered from 0: ``(ordinal, name, description, price, stock, reviews, categories)``.

    With ``text``, reviews carry that column of the same row.
    """
    i = F.col(key)
    main = pick(CATEGORIES, i)
    body = F.col(text) if text else F.concat(F.lit("Review of item "), i.cast("string"))
    reviews = F.transform(F.sequence(F.lit(0), 1 + (i % 4).cast("int")), lambda j: F.struct(
        (3 + j % 3).cast("int").alias("rating"), body.alias("text")))
    categories = F.transform(F.sequence(F.lit(0), (i % 3).cast("int")), lambda j: pick(CATEGORIES, i + j))
    return ids.select(
        i.alias("ordinal"),
        F.concat(pick(PRODUCT_ADJECTIVES, i), F.lit(" "), main, F.lit(" Item "), i.cast("string")).alias("name"),
        F.concat(F.lit("High-quality "), F.lower(main),
                 F.lit(" product featuring durable construction and modern design.")).alias("description"),
        (F.lit(19.99) + (i % 10) * 10).cast("decimal(10,2)").alias("price"),
        (50 + (i * 7) % 200).cast("int").alias("stock"),
        reviews.alias("reviews"), categories.alias("categories"))


def _between(low: int, high: int, *parts: Column | str) -> Column:
    return (low + stable_number(*parts) % (high - low + 1)).cast("int")


def generate_commerce(customers: DataFrame, key: str = "customer_id", n_customers: int | None = None,
                      seed: int = 42, with_reviews: bool = True) -> dict[str, DataFrame]:
    """Shop data for customers numbered from 1: products, tiers, purchases, reviews.

    Every drawn value is a hash of seed and keys. A purchase list is a walk over
    the catalogue with a step that shares no factor with its length, so a
    customer never draws a product twice.
    """
    s = str(seed)
    n_customers = customers.count() if n_customers is None else n_customers
    n_products = max(MIN_PRODUCTS, n_customers * PRODUCTS_PER_CUSTOMER)
    i = F.col("id")
    products = customers.sparkSession.range(n_products).select(
        (i + 1).alias("product_id"),
        F.concat(pick(SHOP_ADJECTIVES, i), F.lit(" "), pick(CATEGORIES, i), F.lit(" Item "),
                 i.cast("string")).alias("name"),
        pick(CATEGORIES, i).alias("category"),
        F.round(10.0 + uniform(s, "price", i) * 190.0, 2).alias("price"),
        _between(0, 200, s, "stock", i).alias("stock_count"))

    c = F.col(key)
    draw, tier, upto = uniform(s, "tier", c), F, 0.0
    for name, share in TIERS:
        upto = round(upto + share, 10)
        tier = tier.when(draw < upto, F.lit(name))
    tier = tier.otherwise(F.lit(TIERS[0][0]))
    buyers = customers.withColumn("tier", tier)
    good = F.col("tier").isin("gold", "platinum")
    wanted = F.when(good, _between(8, 15, s, "buys", c)).otherwise(_between(2, 6, s, "buys", c))
    start = stable_number(s, "start", c) % n_products
    # The catalogue holds at least 50 products and a list at most 15, so steps of
    # 1, 2 or 3 never come round to the start.
    step = 1 + stable_number(s, "step", c) % 3
    def walk(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), w["wanted"] - 1),
                           lambda j: (w["start"] + j * w["step"]) % n_products + 1)

    chosen = let(F.struct(wanted.alias("wanted"), start.alias("start"), step.alias("step")), walk)
    purchases = (buyers.withColumn("_chosen", chosen)
                 .select(c.alias("customer_id"), "tier", F.posexplode("_chosen").alias("line", "product_id")))
    out = {"products": products, "customers": buyers,
           "purchases": purchases.select("customer_id", "line", "product_id")}
    if with_reviews:
        pair = (F.col("customer_id"), F.col("product_id"))
        rating = F.when(good, _between(3, 5, s, "rating", *pair)).otherwise(_between(1, 5, s, "rating", *pair))
        out["reviews"] = (purchases.where(uniform(s, "reviewed", *pair) < REVIEWED_SHARE)
                          .select("customer_id", "product_id", rating.alias("rating"))
                          .withColumn("text", F.concat(F.lit("Product "), F.col("product_id").cast("string"),
                                                       F.lit(" review: rating "), F.col("rating").cast("string"), F.lit("."))))
    return out
