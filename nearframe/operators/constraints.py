"""Table constraints as queries for the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import frequent_keys

# Rows whose keys one task counts; the keys of a primary key are all distinct and stay in its memory.
GROUP_ROWS = 1 << 20


@dataclass(frozen=True)
class Unique:
    """Primary key, composite key or unique column: no key occurs twice."""
    rule: str
    table: str
    columns: Sequence[str]


@dataclass(frozen=True)
class NotNull:
    rule: str
    table: str
    column: str


@dataclass(frozen=True)
class Between:
    rule: str
    table: str
    column: str
    low: float
    high: float


@dataclass(frozen=True)
class ForeignKey:
    rule: str
    table: str
    column: str
    parent: str
    parent_column: str


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per key. A larger table is dealt by key over as many tasks as ``GROUP_ROWS`` asks for, since counts
    taken before the shuffle save nothing on keys that are distinct. Those of frequent keys, found by a sketch, do."""
    keys, n = df.select(*columns), F.count(F.lit(1)).alias("n")
    tasks = -(-df.count() // GROUP_ROWS)
    if tasks <= 1:
        return keys.groupBy(*columns).agg(n)
    hashed = keys.withColumn("_hash", F.xxhash64(*columns))
    hot = frequent_keys(hashed, "_hash").distinct().withColumn("_hot", F.lit(True))
    marked = hashed.join(F.broadcast(hot), "_hash", "left")
    rare = marked.where("_hot IS NULL").select(*columns).repartition(tasks, *columns).groupBy(*columns).agg(n)
    return rare.unionByName(marked.where("_hot").groupBy(*columns).agg(n))


def _violations(tables: dict[str, DataFrame], c) -> DataFrame:
    df = tables[c.table]
    if isinstance(c, Unique):
        key = F.concat_ws("|", *[F.col(x).cast("string") for x in c.columns])
        present = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c.columns])
        bad = _counted(df.where(present), c.columns).where("n > 1").select(key.alias("key"), "n")
    elif isinstance(c, NotNull):
        bad = df.where(F.col(c.column).isNull()).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        bad = bad.select(F.lit(None).cast("string").alias("key"), "n")
    elif isinstance(c, Between):
        bad = (df.where(~F.col(c.column).between(c.low, c.high))
               .groupBy(F.col(c.column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    elif isinstance(c, ForeignKey):
        # Keys are counted before the join, so a frequent key is one row in it.
        used = _counted(df.where(F.col(c.column).isNotNull()).select(F.col(c.column).alias("_key")), ["_key"])
        parent = tables[c.parent].select(F.col(c.parent_column).alias("_key"))
        bad = used.join(parent, "_key", "left_anti").select(F.col("_key").cast("string").alias("key"), "n")
    else:
        raise TypeError(f"unknown rule {c!r}")
    return bad.select(F.lit(c.rule).alias("rule"), "key", "n")


def check_constraints(tables: dict[str, DataFrame], rules: Sequence) -> DataFrame:
    """All violations as ``(rule, key, n)``."""
    return reduce(DataFrame.unionByName, [_violations(tables, r) for r in rules])
