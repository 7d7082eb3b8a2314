"""One text per entity, assembled from several tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding import embed_column


def top_n_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """First n rows of every key; each task drops the rest before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def join_text(df: DataFrame, key: str, text: str, order: str, sep: str, out: str) -> DataFrame:
    """The texts of a key joined in order; ties of ``order`` go by text."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.where(F.col(text).isNotNull()).groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["t"]), sep).alias(out))


def join_names(df: DataFrame, key: str, name: str, sep: str, out: str) -> DataFrame:
    """The names of a key joined in name order."""
    listed = F.expr(f"listagg(`{name}`, '{sep}') WITHIN GROUP (ORDER BY `{name}`)")
    return df.groupBy(key).agg(listed.alias(out))


def format_price(price: Column) -> Column:
    """Two decimals without padding."""
    return price.cast("decimal(12,2)").cast("string")


def attach_texts(product: DataFrame, reviews: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join both text columns; an entity without any gets the default."""
    return (product.join(reviews, "product_id", "left").join(categories, "product_id", "left")
            .withColumn("reviews", F.coalesce("reviews", F.lit("No reviews")))
            .withColumn("categories", F.coalesce("categories", F.lit("Uncategorized"))))


def build_documents(product: DataFrame, review: DataFrame, category: DataFrame,
                    category_order: str = "name", reviews_per_product: int = 5) -> DataFrame:
    """``(product_id, document)`` from name, description, price, reviews and categories.

    ``category_order`` is ``name`` for stored tables or a column that holds the
    order of input. A null name, description or price makes the text null.
    """
    first = top_n_per_key(review.select("product_id", "review_id", "review_text"),
                          "product_id", "review_id", reviews_per_product)
    reviews = join_text(first, "product_id", "review_text", "review_id", " | ", "reviews")
    if category_order == "name":
        categories = join_names(category, "product_id", "category_name", ", ", "categories")
    else:
        categories = join_text(category, "product_id", "category_name", category_order, ", ", "categories")
    whole = F.concat(
        "name", F.lit(". "), "description", F.lit(". Price: $"), format_price(F.col("price")),
        F.lit(". Reviews: "), "reviews", F.lit(". Categories: "), "categories")
    return attach_texts(product, reviews, categories).select("product_id", whole.alias("document"))


def embed_documents(product: DataFrame, review: DataFrame, category: DataFrame,
                    backend: str = "hash", model: str = "hash-64", **options) -> DataFrame:
    """``(product_id, document, embedding)``; text and vector share a row throughout."""
    return embed_column(build_documents(product, review, category, **options), "document", backend, model)
