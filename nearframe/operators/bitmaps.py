"""Sets of ids as Spark bitmaps: buckets of 32,768 ids with one bit each.

A bucket is built in every task before the shuffle and takes 4 KB however often its
ids occur, so sets are cut and counted without moving their members. Meant for dense
ids, as :func:`nearframe.operators.loading.assign_keys` gives them; ids spread thinly
over a large range take a bucket each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, bucket, bits): the distinct ids of ``key`` within each value of ``by``; null is no id."""
    number = F.col(key).cast("long")
    return (df.where(F.col(key).isNotNull()).groupBy(*by, F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")))


def common(*sets: DataFrame) -> DataFrame:
    """(bucket, bits) of the ids that all sets (bucket, bits) have."""
    every = reduce(DataFrame.unionByName, [s.select("bucket", "bits") for s in sets])
    return (every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(sets)).drop("n"))


def within(sets: DataFrame, other: DataFrame, *by: str) -> DataFrame:
    """``sets`` (by, bucket, bits), each cut down to the ids of ``other`` (bucket, bits)."""
    pairs = sets.join(other.select("bucket", F.col("bits").alias("others")), "bucket")
    return (pairs.select(*by, "bucket", F.explode(F.array("bits", "others")).alias("bits"))
            .groupBy(*by, "bucket").agg(F.bitmap_and_agg("bits").alias("bits")))


def sizes(sets: DataFrame, *by: str, out: str = "n") -> DataFrame:
    """The number of ids within each value of ``by``, or in the whole set."""
    return sets.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(out))


def ids(sets: DataFrame, key: str, *by: str) -> DataFrame:
    """The members again, one row each."""
    byte = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.struct(
        i.alias("i"), F.conv(F.hex(F.substring(F.col("bits"), i + 1, F.lit(1))), 16, 10).cast("int").alias("b")))
    some = sets.select(*by, "bucket", F.explode(F.filter(byte, lambda x: x["b"] > 0)).alias("x"))
    bit = F.explode(F.filter(F.array(*map(F.lit, range(8))), lambda j: F.getbit(F.col("x.b").cast("long"), j) == 1))
    # Bucket 1 starts at id 1; zero and what lies below are in bucket 0 and those before it, counted away from zero.
    numbered = some.select(*by, "bucket", "x", bit.alias("j")).withColumn("at", F.col("x.i") * 8 + F.col("j"))
    up = (F.col("bucket") - 1) * 32768 + F.col("at") + 1
    down = F.col("bucket") * 32768 - F.col("at")
    return numbered.select(*by, F.when(F.col("bucket") > 0, up).otherwise(down).cast("long").alias(key))
