"""Relational loading: keys, nested records, idempotent inserts, vector updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import with_position
from ..functions.text import stable_number


def legit(df: DataFrame, legitimate_only: bool = True) -> DataFrame:
    return df.where("spam = 0") if legitimate_only else df


def labelled(df: DataFrame, text: str = "text", label: str = "spam") -> DataFrame:
    return df.select(F.col(text).alias("text"), F.col(label).cast("boolean").alias(label))


# Rows that a single final merge of a top-n may hold.
TOP_ROWS = 100_000


def sample_n(df: DataFrame, n: int, key: str, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """n rows without replacement, or the first n by key; all rows if there are fewer.

    The order of a shuffled sample is the MD5 of seed and key, so a rerun gives
    the same rows.
    """
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")) if shuffle else F.col(key)
    drawn = df.withColumn("_order", order)
    if n <= TOP_ROWS:
        return drawn.orderBy("_order", key).limit(n).drop("_order")
    return with_position(drawn, "_order", key, name="_pos").where(F.col("_pos") <= n).drop("_order", "_pos")


def split_corpus(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows by key and the rest.

    Only the key at position n is looked up; both sides are filters on the
    source, which reach its file statistics. A null key comes after all others,
    so its rows are in the rest. Keys identify a row.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    if n <= TOP_ROWS:
        last = keys.orderBy(key).limit(n).agg(F.max(key).alias("edge"), F.count(F.lit(1)).alias("n")).first()
        edge = last["edge"] if last["n"] == n else None
    else:
        row = with_position(keys, key, name="_pos").where(F.col("_pos") == n).first()
        edge = row[key] if row else None
    if edge is None:
        return df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    return df.where(F.col(key) <= edge), df.where((F.col(key) > edge) | F.col(key).isNull())


def zip_arrays(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """Parallel arrays to rows ``(pos, one column each)``; short ones are filled with null."""
    zipped = df.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("pos", "_row"))
    return zipped.select(*keep, "pos", *[F.col(f"_row.{c}").alias(c) for c in columns])


def unnest_ordinality(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """Parallel arrays to rows with an ordinal that starts at 1."""
    return zip_arrays(df, columns, *keep).withColumn("ordinal", F.col("pos") + 1).drop("pos")


def assign_keys(df: DataFrame, *order: str, key: str = "id", start: int = 1) -> DataFrame:
    """Consecutive keys in a total order, known before anything is written."""
    return with_position(df, *order, name=key, start=start)


def map_generated_keys(inputs: DataFrame, stored: DataFrame, name: str, key: str) -> DataFrame:
    """Find the keys of inserted rows by name; a repeated name fails the job."""
    ids = stored.groupBy(name).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_n"))
    unique = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("name is not unique: "), F.col(name)))
                    .cast("bigint")).otherwise(F.col(key))
    return inputs.join(ids.withColumn(key, unique).drop("_n"), name)


def flatten_products(nested: DataFrame, key: str = "product_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested products to product, review and category rows with their foreign key."""
    lists = ("reviews", "categories")
    product = nested.select(*[c for c in nested.columns if c not in lists])
    review = nested.select(key, F.posexplode("reviews").alias("pos", "_r")).select(
        key, "pos", F.col("_r.rating").alias("rating"), F.col("_r.text").alias("review_text"))
    category = nested.select(key, F.posexplode("categories").alias("pos", "category_name"))
    return product, review, category


def load_product_family(nested: DataFrame, path: str, backend: str | None = None,
                        model: str = "hash-64", vectors: DataFrame | None = None) -> None:
    """Write product, review and category tables of nested products in one call.

    Keys are assigned before the first write. With a backend, or with given
    ``vectors`` (ordinal, embedding), the product table carries the embedding
    of its document.
    """
    from .documents import embed_documents

    keyed = assign_keys(nested, "ordinal", key="product_id")
    product, review, category = flatten_products(keyed)
    # Orders of input within a product: keys grow with (product, position).
    review = assign_keys(review, "product_id", "pos", key="review_id").drop("pos")
    if backend is not None:
        embedded = embed_documents(product, review, category, backend, model, category_order="pos")
        product = product.join(embedded.select("product_id", "embedding"), "product_id", "left")
    elif vectors is not None:
        product = product.join(vectors.select("ordinal", "embedding"), "ordinal", "left")
    product.drop("ordinal").write.mode("overwrite").parquet(f"{path}/product")
    review.write.mode("overwrite").parquet(f"{path}/review")
    category.drop("pos").write.mode("overwrite").parquet(f"{path}/product_category")


def insert_new(table: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key the table does not hold yet; the least row of each key."""
    others = [c for c in df.columns if c != key]
    rows = df.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")) if others else df.distinct()
    new = rows.join(table.select(key), key, "left_anti")
    return new.select(*[F.col(f"_row.{c}").alias(c) if c != key else F.col(key) for c in df.columns])


def attach_fk(df: DataFrame, dim: DataFrame, name: str, key: str) -> DataFrame:
    """Look up the key of a name and attach it to every row."""
    return df.join(dim.select(name, key), name)


def insert_returning(df: DataFrame, table: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """Rows with the keys that follow the highest key of the table."""
    last = table.agg(F.max(key)).first()[0] or 0
    return assign_keys(df, *order, key=key, start=last + 1)


def store_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows with vectors that were computed elsewhere."""
    return rows.join(vectors.select(key, "embedding"), key)


def reembed(table: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Replace the vectors of matching rows; all other rows stay as they are."""
    new = vectors.select(key, F.col("embedding").alias("_new"))
    return (table.join(new, key, "left")
            .withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new"))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by its parts."""
    return stable_number(*parts) / F.lit(float(2**32))
