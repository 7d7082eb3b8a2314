"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, MapType

def frequent_keys(df: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """(key) of every value that more than ``share`` of the rows have, and perhaps some rarer ones.

    A frequent-items sketch is merged from the tasks, so no row is moved. It keeps
    ``8 / share`` values apart, twice what its error needs, and no more come out of it.
    """
    if isinstance(df.schema[key].dataType, BinaryType):  # a sketch does not take bytes
        return df.select(key).limit(0)
    keep = max(1, round(8 / share))
    found = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {keep}, {keep})").alias("top"))
    return found.select(F.explode("top").alias("x")).select(F.col("x.item").alias(key))


def join_hubs(left: DataFrame, right: DataFrame, key: str, hubs: DataFrame, how: str = "inner",
              spread: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, rows of the keys in ``hubs`` dealt over ``spread`` tasks.

    ``hubs`` (key) has to be bounded by construction, since it is sent to all
    tasks. A row of ``left`` with such a key takes one of ``spread`` salts by a
    hash of its columns ``by`` (all but maps if not given), and rows of ``right``
    with it are copied to all of them; all other rows are joined plainly, in the
    same shuffle. ``how`` is inner, left or left_semi.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"rows of the right side may be copied, which a {how} join would show")
    spread = spread or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = F.broadcast(hubs.select(F.col(key)).distinct().withColumn("_hub", F.lit(True)))
    by = by or [f.name for f in left.schema if not isinstance(f.dataType, MapType)]
    salt = F.when(F.col("_hub"), F.pmod(F.xxhash64(*by), F.lit(spread))).otherwise(F.lit(0))
    salts = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    one = left.join(few, key, "left").withColumn("_salt", salt.cast("int")).drop("_hub")
    other = right.join(few, key, "left").withColumn("_salt", F.explode(salts)).drop("_hub")
    return one.join(other, [key, "_salt"], how).drop("_salt")
