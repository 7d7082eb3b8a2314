"""Vector arithmetic as column expressions over ``ARRAY<FLOAT|DOUBLE>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    An expression written inside a ``transform`` lambda is evaluated for every
    element; binding it as a lambda variable first keeps the work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    squares = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: Column) -> Column:
    """Unit-length vector; null when the length is zero."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 when either vector has no length."""
    return let(
        norm(a) * norm(b),
        lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n),
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    def squared_gap(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(F.aggregate(F.zip_with(a, b, squared_gap), F.lit(0.0), lambda s, x: s + x))


def reduce_dims(v: Column, dims: int) -> Column:
    """Keep the leading ``dims`` values and restore unit length."""
    return l2_normalize(F.slice(v, 1, dims))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; null if none is."""
    marked = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)

    def average(kept: Column) -> Column:
        first = F.transform(F.element_at(kept, 1)["v"], lambda x: x.cast("double"))
        total = F.aggregate(
            F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))),
            first,
            lambda acc, t: F.zip_with(acc, t["v"], lambda x, y: x + y.cast("double")),
        )
        return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))

    return let(marked, average)


def mean_profile(df: DataFrame, group: str, vector: str, out: str = "embedding") -> DataFrame:
    """One element-wise mean per group, not brought back to unit length.

    The running sums are combined before the shuffle, so a group that holds
    most of the rows costs one partial result per task.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return (
        df.where(F.col(vector).isNotNull())
        .groupBy(group)
        .agg(mean.alias("_mean"))
        .select(group, vector_to_array("_mean").alias(out))
    )


def profile_or_zero(members: DataFrame, profiles: DataFrame, group: str, dims: int,
                    out: str = "embedding") -> DataFrame:
    """Attach profiles to all members; a member without vectors gets zeros."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return members.join(profiles, group, "left").withColumn(out, F.coalesce(F.col(out), zeros))


def check_width(v: Column, dims: int) -> Column:
    """The vector itself; the job fails if a non-null vector has another width."""
    message = F.concat(F.lit(f"expected {dims} values, found "), F.size(v).cast("string"))
    return F.when(v.isNull() | (F.size(v) == dims), v).otherwise(F.raise_error(message))
