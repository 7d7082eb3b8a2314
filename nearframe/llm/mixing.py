"""Mix sources to target weights by Pareto order sampling, on columns only.

A row of a source is expected ``target / size of the source`` times in the mix,
``max_copies`` at most. Its whole copies are certain. The fraction ``p`` that is
left is an inclusion probability: rows are ranked by random odds over inclusion
odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken in that order until the
source's words are as near its target as whole rows can bring them. ``u`` is a
hash of seed and id, so reruns and lost tasks give the same mix.

The only things computed per source are its size, its target and the rank of the
last row taken. That rank is found without sorting a source in one task: ranks
are cut into as many buckets as a bucket has rows, the bucket sums are added up,
and only the bucket in which the target is reached is sorted.

Defined results
---------------
* A null text has size 0; rows of size 0 belong to the mix but bring no words.
* Sources are ordered by code point, the null source last and like any other.
* Rows that agree in id, source and text share one rank and are taken together.
* A null id is hashed as the empty text. An empty table gives an empty result.
* If every text is empty, all targets are 0 and nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD, free_names, stored


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: str, seed: int) -> Column:
    """A number between 0 and 1, from 52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by weight, cut off at ``max_copies`` sizes.

    What a cut-off leaves is shared again by weight until no source is above its
    limit. The common level of words per weight at which that ends is the largest
    of those that hold when the first k sources, by limit per weight, are full.
    Runs over one row per source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                           % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * max_copies
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sizes.withColumn("weight", weight).withColumn("limit", limit)
            .withColumn("level", (F.sum("source_size").over(every) - full) / open_)
            .withColumn("level", F.max("level").over(every))
            .withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
            .drop("weight", "limit", "level"))


def _expected(weight: Column | None, max_copies: int) -> Column:
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if weight is not None:
        share = share * F.coalesce(weight / F.col("mean_weight"), F.lit(0.0))
    return F.least(share, F.lit(float(max_copies)))


def _rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where there is nothing left to sample."""
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 20,
        text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: str | None = None) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target`` and ``copies``, the times the mix takes a row.

    The new names get an underscore where ``df`` has such columns. ``weight``
    names a column of relative preferences within a source; without it all rows
    of a source have the same expectation.
    """
    narrow = df.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"),
                       F.xxhash64(text).alias("tie"), *([F.col(weight).cast("double").alias("preference")] if weight else []))
    thin = stored(narrow.withColumn("u", uniform("id", seed)), "mix")
    preference = F.col("preference") if weight else None
    sums = [F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")]
    if weight:
        sums.append((F.sum(F.col("preference") * F.col("size")) / F.sum("size")).alias("mean_weight"))
    ends = stored(_ends(thin, source_targets(thin.groupBy("source").agg(*sums), weights, max_copies),
                        preference, max_copies), "mix-ends")
    names = free_names(df, "size", "source_size", "target", "copies", "_end", "_u")
    size, source_size, target, copies, end, u = names
    ends = ends.select(F.struct(*ends.columns).alias(end))
    wide = (df.withColumn(u, uniform(doc_id, seed))
            .join(ends, F.col(source).eqNullSafe(F.col(f"{end}.source")), "left"))
    share = F.when(F.col(f"{end}.source_size") > 0, F.col(f"{end}.target") / F.col(f"{end}.source_size")).otherwise(0.0)
    if weight:
        share = share * F.coalesce(F.col(weight).cast("double") / F.col(f"{end}.mean_weight"), F.lit(0.0))
    expected = F.least(share, F.lit(float(max_copies)))
    own = F.struct(_rank(F.col(u), expected - F.floor(expected)).alias("rank"), F.col(doc_id).alias("id"),
                   F.xxhash64(text).alias("tie"))
    extra = F.coalesce(own["rank"].isNotNull() & (own <= F.col(f"{end}.last")), F.lit(False))
    return wide.select(*[df[c] for c in df.columns], word_count(text).alias(size),
                       F.col(f"{end}.source_size").alias(source_size), F.col(f"{end}.target").alias(target),
                       (F.floor(expected) + extra.cast("long")).alias(copies))


def _ends(thin: DataFrame, targets: DataFrame, preference: Column | None, max_copies: int) -> DataFrame:
    """Add to each source the rank, id and tie of the last row that gets an extra copy."""
    expected = _expected(preference, max_copies)
    buckets = F.ceil(F.sqrt(F.col("rows")))
    rows = (thin.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("whole", F.floor(expected)).withColumn("p", expected - F.floor(expected))
            .withColumn("rank", _rank(F.col("u"), F.col("p")))
            # With equal p the rank follows u; unequal p only make buckets uneven.
            .withColumn("bucket", F.when(F.col("p") > 0, F.floor(F.col("u") * buckets) if preference is None
                                         else F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)).otherwise(-1)))
    per_bucket = (rows.groupBy("source", "bucket", "target")
                  .agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain")))
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sampled = F.when(F.col("bucket") >= 0, F.col("words")).otherwise(0)
    reach = (per_bucket.withColumn("rest", F.col("target") - F.sum("certain").over(of_source))
             .withColumn("start", F.coalesce(F.sum(sampled).over(before), F.lit(0)))
             .withColumn("inside", sampled).where("bucket >= 0"))
    # The bucket in which the words left for the sample run out, or the last one before.
    last = (reach.where("2 * start <= 2 * rest").groupBy("source")
            .agg(F.max(F.struct("bucket", "start", "rest")).alias("at")).select("source", "at.*"))
    inner = (rows.join(last.select(F.col("source").alias("cut"), F.col("bucket").alias("cut_bucket"), "start", "rest"),
                       F.col("source").eqNullSafe(F.col("cut")) & (F.col("bucket") == F.col("cut_bucket"))))
    order = Window.partitionBy("source").orderBy("rank", "id", "tie")
    running = F.col("start") + F.coalesce(
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.struct("rank", "id", "tie")
    taken = (inner.withColumn("running", running)
             .withColumn("fits", 2 * F.col("running") + F.col("size") <= 2 * F.col("rest")))
    # If no row of the bucket fits, everything before the bucket is in: end just below its first row.
    cut = taken.groupBy("source").agg(F.max(F.when(F.col("fits"), own)).alias("inside"), F.min(own).alias("first"))
    below = F.struct((F.col("first.rank") * (1 - 1e-15)).alias("rank"), F.col("first.id").alias("id"),
                     F.col("first.tie").alias("tie"))
    cut = cut.select(F.col("source").alias("end_of"), F.coalesce("inside", below).alias("last"))
    return targets.join(cut, F.col("source").eqNullSafe(F.col("end_of")), "left").drop("end_of", "rows")
