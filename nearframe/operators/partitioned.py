"""The exact k nearest items for two large sides: a join of Voronoi partitions with distance bounds.

Both sides are assigned to the nearest of some pivots. From what is known per partition
(how far its farthest query lies from the pivot, and how near its k nearest items) a
radius follows for every partition of queries within which all their k nearest items
lie, and from that, for every pair of partitions, how far an item has to lie from its
own pivot to be of use there. An item is copied only to partitions whose bound it meets,
before anything is compared, and all partitions are searched in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import BROADCAST_BYTES, store
from .cells import _gaps, _share, _slices, assign_cells, fit_centroids
from .neighbours import BLOCK_ROWS, block_of, cell_search, keep_top, matrix

# Rows that a partition of items has about, and the most partitions: bounds are kept for every pair of them.
PARTITION_ROWS, MOST_PARTITIONS = 8192, 2048


def _placed(side: DataFrame, key: str, pivots: np.ndarray, metric: str, name: str) -> DataFrame:
    """Rows with their partition, the distance to its pivot and whether the vector has no length."""
    flat = ~F.exists("vector", lambda x: x != 0)
    return store(assign_cells(side.withColumn("flat", flat), "vector", pivots, metric), name)


def bounds(pivots: np.ndarray, far: np.ndarray, near: np.ndarray, k: int, metric: str,
           flat_queries: np.ndarray, flat_items: bool) -> np.ndarray:
    """For items of partition j (rows) and queries of partition i (columns): the least distance of an item
    from its pivot at which it can be among the k nearest of some query.

    ``far[i]`` is the distance of the farthest query from its pivot, negative without queries;
    ``near[j]`` are the k smallest distances of items from theirs, infinite where there are fewer.
    """
    apart = _gaps(pivots, pivots)
    out = np.full(apart.shape, np.inf)
    slack = 1e-6 * (1 + np.linalg.norm(pivots, axis=1).max() + max(far.max(), 0))
    for i in np.flatnonzero(far >= 0):
        upper = np.sort((far[i] + apart[i][:, None] + near).ravel())
        reach = upper[k - 1] if len(upper) >= k else np.inf
        if metric == "cosine" and (flat_items or flat_queries[i]):
            # A vector without length has cosine distance 1 to all, wherever its zeros were placed.
            reach = max(reach, np.sqrt(2.0))
        out[:, i] = apart[i] - far[i] - reach - slack
    return out


def partition_join(q: DataFrame, x: DataFrame, k: int, metric: str = "l2", block_rows: int | None = None,
                   partitions: int | None = None, seed: int = 7) -> DataFrame:
    """(query_id, item_id, dist, rank) from (query_id, vector) and (item_id, vector) without null vectors."""
    return keep_top(_found(q, x, k, metric, block_rows or BLOCK_ROWS, partitions, seed), k)


def copies(x: DataFrame, least: np.ndarray) -> DataFrame:
    """Items (item_id, vector, cell, gap) once for every partition ``to`` of queries that they may be of use in."""
    shared = _share(x.sparkSession, least)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, = shared.value
        for whole in batches:
            for _, batch in _slices(whole, least.shape[1]):
                cell, gap = np.asarray(batch["cell"]), np.asarray(batch["gap"])
                row, to = np.nonzero(gap[:, None] >= least[cell])
                rows = pa.array(row)
                yield pa.RecordBatch.from_pydict({"item_id": batch["item_id"].take(rows), "vector": batch["vector"].take(rows),
                                                  "to": pa.array(to, pa.int32())})

    fields = {f.name: f.dataType for f in x.schema}
    schema = T.StructType().add("item_id", fields["item_id"]).add("vector", fields["vector"]).add("to", T.IntegerType())
    return x.select("item_id", "vector", "cell", "gap").mapInArrow(deal, schema)


def _numbers(x: DataFrame, least: np.ndarray) -> np.ndarray:
    """How many items every partition of queries gets, from two narrow columns."""
    shared = _share(x.sparkSession, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, = shared.value
        total = np.zeros(least.shape[1], np.int64)
        for whole in batches:
            for _, batch in _slices(whole, least.shape[1]):
                total += (np.asarray(batch["gap"])[:, None] >= least[np.asarray(batch["cell"])]).sum(0)
        yield pa.RecordBatch.from_pydict({"to": np.arange(len(total), dtype=np.int32), "n": total})

    found = x.select("cell", "gap").mapInArrow(count, "to int, n bigint").groupBy("to").agg(F.sum("n").alias("n"))
    out = np.zeros(least.shape[1], np.int64)
    for r in found.collect():  # one row per partition
        out[r["to"]] = r["n"]
    return out


def _found(q: DataFrame, x: DataFrame, k: int, metric: str, block_rows: int, partitions: int | None, seed: int) -> DataFrame:
    spark = q.sparkSession
    x = store(x, "join-items")
    rows = x.count()
    first = x.select(F.size("vector").alias("n")).first()
    most = min(MOST_PARTITIONS, max(1, BROADCAST_BYTES // (8 * first["n"])) if first else 1)
    wanted = min(most, partitions or max(1, -(-rows // PARTITION_ROWS)))
    sample = x if rows else store(q.withColumnRenamed("query_id", "item_id"), "join-queries")
    if not rows and sample.isEmpty():
        return q.join(x, F.lit(False)).select("query_id", "item_id", F.lit(0.0).alias("dist"))
    pivots = fit_centroids(sample, "vector", wanted, metric, seed)
    q = _placed(q, "query_id", pivots, metric, "placed-queries")
    x = _placed(x, "item_id", pivots, metric, "placed-items")
    far, crowd, flat = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64), np.zeros(len(pivots), bool)
    for r in q.groupBy("cell").agg(F.max("gap").alias("far"), F.count(F.lit(1)).alias("n"), F.max("flat").alias("flat")).collect():
        far[r["cell"]], crowd[r["cell"]], flat[r["cell"]] = r["far"], r["n"], r["flat"]
    # At most k distances per partition.
    near = np.full((len(pivots), k), np.inf)
    nearest = Window.partitionBy("cell").orderBy("gap")
    for r in (x.select("cell", "gap", F.row_number().over(nearest).alias("at")).where(F.col("at") <= k)).toLocalIterator():
        near[r["cell"], r["at"] - 1] = r["gap"]
    flat_items = bool(x.agg(F.max("flat")).first()[0])
    least = bounds(pivots, far, near, k, metric, flat, flat_items)
    numbers = _numbers(x, least)
    plan = [(int(i), max(1, -(-int(crowd[i]) // block_rows)), max(1, -(-int(numbers[i]) // block_rows)))
            for i in np.flatnonzero(crowd)]
    splits = F.broadcast(spark.createDataFrame(plan, "cell int, q_blocks int, x_blocks int"))  # one row per partition
    # Partitions and crowds of queries beyond a block are cut up, so that no task takes more than a block of each.
    items = (copies(x, least).withColumnRenamed("to", "cell").join(splits, "cell")
             .withColumn("_x", block_of("item_id", F.col("x_blocks")))
             .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))))
    asked = (q.select("query_id", "vector", "cell").join(splits, "cell")
             .withColumn("_q", block_of("query_id", F.col("q_blocks")))
             .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))))
    keys = ["cell", "_q", "_x"]
    return cell_search(asked.select("query_id", "vector", *keys), items.select("item_id", "vector", *keys), keys, k, metric)
