"""Order statistics of keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bands of the value that a key is cut into.
BANDS = 256
# Size of a quantile sketch, and the rank error of its quantiles in 99 of 100 cases.
SKETCH_K = 1024
SKETCH_ERROR = 2.296 / SKETCH_K**0.9021


def cumulative(counts: DataFrame, keys: list[str], value: str, weight: str, out: str, total: str) -> DataFrame:
    """Running sum of ``weight`` in order of ``value`` within the keys, and the sum per key.

    Keys are cut into bands of the value, summed apart and put together through
    band totals, so no key is ordered in one task.
    """
    key = Window.partitionBy(*keys)
    bounds = counts.groupBy(*keys).agg(
        F.percentile_approx(value, F.lit([i / BANDS for i in range(1, BANDS)]), F.lit(10 * BANDS))
        .alias("_bounds"))
    banded = (counts.join(bounds, keys)
              .withColumn("_band", F.size(F.filter("_bounds", lambda b: b < F.col(value))))
              .drop("_bounds"))
    earlier = key.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    before = (banded.groupBy(*keys, "_band").agg(F.sum(weight).alias("_sum"))
              .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
              .withColumn(total, F.sum("_sum").over(key))
              .drop("_sum"))
    inside = Window.partitionBy(*keys, "_band").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (banded.withColumn("_inside", F.sum(weight).over(inside))
            .join(before, [*keys, "_band"])
            .withColumn(out, F.col("_before") + F.col("_inside"))
            .drop("_band", "_before", "_inside"))


def _with_key(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys of which null is one."""
    named = right.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)]
    return left.join(named, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: Sequence[float],
              out: str = "quantiles", others: Sequence[Column] = ()) -> DataFrame:
    """Exact quantiles per key with linear interpolation, as one array per key,
    next to the ``others`` aggregates of the key. Nulls are not counted, what is
    not a number counts as infinite; a key without values has no array.

    Spark's ``percentile`` keeps all distinct values of a key in one buffer. Here
    one pass merges a sketch per key, which bounds each quantile from both sides,
    and a second pass counts the values between the bounds and how many lie below.
    Only the former are ordered. The bounds are three times as wide as the error
    that the sketch keeps to in 99 of 100 cases, and are verified: a quantile
    outside them, with a chance below 1e-12, is an error and never a wrong number.
    """
    v = F.col(value).cast("double")
    v = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
    sketched = df.groupBy(*keys).agg(*others, F.count(value).alias("_n"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("_sketch"))
    # A key that a sketch holds whole has all its values counted; beyond that two places are a small share.
    whole, margin = F.col("_n") <= SKETCH_K, 3 * SKETCH_ERROR + 2 / SKETCH_K

    def at_rank(rank: float, end: float) -> Column:
        bound = F.kll_sketch_get_quantile_double("_sketch", F.lit(min(max(rank, 0.0), 1.0)))
        return F.when(whole, F.lit(end)).otherwise(bound)

    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), at_rank(p - margin, float("-inf")).alias("low"),
                               at_rank(p + margin, float("inf")).alias("high")) for i, p in enumerate(probs)])
    bounds = sketched.where("_n > 0").select(*keys, "_n", bands.alias("_bands"))
    rows = (_with_key(df.select(*keys, v.alias("_v")).where("_v IS NOT NULL"), bounds, keys, "inner")
            .select(*keys, "_n", "_v", F.explode(F.filter("_bands", lambda b: F.col("_v") <= b["high"])).alias("_b")))
    # Values below the bounds are one row per key and task when they leave it.
    inside = F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_x")
    counts = rows.groupBy(*keys, "_n", F.col("_b.i").alias("_i"), F.col("_b.p").alias("_p"), inside).agg(
        F.count(F.lit(1)).alias("_w"))
    running = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_x")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # The value at zero-based position r is the one with _from <= r < _upto. Each
    # quantile needs the positions below and above its exact place.
    ranked = counts.withColumn("_upto", F.sum("_w").over(running)).withColumn("_from", F.col("_upto") - F.col("_w"))
    at = F.col("_p") * (F.col("_n") - 1)
    near = (F.col("_from") <= F.ceil(at)) & (F.col("_upto") > F.floor(at))
    cuts = ranked.where(near & F.col("_x").isNotNull()).groupBy(*keys, "_i").agg(
        F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.max(at - F.floor(at)).alias("_share"),
        ((F.min("_from") <= F.min(F.floor(at))) & (F.max("_upto") > F.max(F.ceil(at)))).alias("_both"))
    exact = F.when(F.col("_both"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
        F.col("_low") + F.col("_share") * (F.col("_high") - F.col("_low"))))
    cuts = cuts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", exact.alias("q")))).alias("_cuts"))
    missed = (F.col("_n") > 0) & (F.col("_cuts").isNull() | (F.size("_cuts") < len(probs)) | F.exists("_cuts", lambda c: c["q"].isNull()))
    found = F.when(missed, F.raise_error(F.lit("a quantile lies outside the bounds of its sketch"))).otherwise(
        F.transform("_cuts", lambda c: c["q"]))
    return _with_key(sketched.drop("_sketch"), cuts, keys, "left").withColumn(out, found).drop("_n", "_cuts")
