"""The input tables in the roles the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_profile
from .registry import Tables


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per vector position, values rounded to six decimals."""
    return (df.select(key, F.posexplode(vector).alias("dim", "x"))
            .select(key, F.col("dim").cast("bigint").alias("dim"),
                    (F.round(F.col("x").cast("double"), 6) + F.lit(0.0)).alias("value")))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def profiles(t: Tables) -> DataFrame:
    """One query vector per person: the mean of all their vectors."""
    return mean_profile(t.embeddings, "label", "embedding").withColumnRenamed("label", "id")


def customers(t: Tables) -> DataFrame:
    vecs = t.embeddings.select("vec_id", "embedding")
    return (t.customer.join(vecs, F.col("c_custkey") == F.col("vec_id"))
            .select(F.col("c_custkey").alias("id"), "embedding", F.col("c_mktsegment").alias("tier")))


def purchases(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("product_id"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("customer_id", "product_id")


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("description"),
        F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"))


def reviews(t: Tables) -> DataFrame:
    """Documents as reviews: seven per product, whole texts."""
    return t.documents.select(
        F.col("doc_id").alias("review_id"), F.floor(F.col("doc_id") / 7).alias("product_id"),
        (1 + F.col("doc_id") % 5).alias("rating"), F.col("text").alias("review_text"))


def categories(t: Tables) -> DataFrame:
    """Brand and type as category names; small products have one or none."""
    names = F.filter(F.array(
        F.struct(F.when(F.col("p_size") > 15, F.col("p_brand")).alias("category_name"), F.lit(0).alias("pos")),
        F.struct(F.when(F.col("p_size") > 30, F.col("p_type")).alias("category_name"), F.lit(1).alias("pos"))),
        lambda c: c["category_name"].isNotNull())
    return t.part.select(F.col("p_partkey").alias("product_id"), F.inline(names))


def nested_products(t: Tables) -> DataFrame:
    """Parts as nested products: their documents as reviews (seven at most) and their categories (two at most)."""
    review = F.struct("review_id", F.col("rating").cast("int").alias("rating"), F.col("review_text").alias("text"))
    told = reviews(t).groupBy(F.col("product_id").alias("ordinal")).agg(F.sort_array(F.collect_list(review)).alias("told"))
    named = categories(t).groupBy(F.col("product_id").alias("ordinal")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "category_name"))).alias("named"))
    stock = t.part.select(F.col("p_partkey").alias("ordinal"), F.col("p_size").alias("stock"))
    wide = (products(t).drop("category").withColumnRenamed("product_id", "ordinal").join(stock, "ordinal")
            .join(told, "ordinal", "left").join(named, "ordinal", "left"))
    return wide.select(
        "ordinal", "name", "description", "price", "stock",
        F.coalesce(F.transform("told", lambda r: F.struct(r["rating"].alias("rating"), r["text"].alias("text"))),
                   F.array().cast("array<struct<rating:int,text:string>>")).alias("reviews"),
        F.coalesce(F.transform("named", lambda c: c["category_name"]), F.array().cast("array<string>")).alias("categories"))


def labelled_documents(t: Tables) -> DataFrame:
    """Labelled review texts: spam is a toxic document."""
    return (t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic"), "doc_id")
            .select(F.col("doc_id").alias("id"), "text", F.col("toxic").alias("spam")))


def messages(t: Tables) -> DataFrame:
    """Conversation turns as arriving texts."""
    return t.conversations.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")


def runs(t: Tables) -> DataFrame:
    """Events as runs: a size, a method and a time per row."""
    return t.events.select((F.col("user_id") % 4).alias("size"), F.col("event_type").alias("method"),
                           F.col("value").alias("time_s"))
