"""Exact nearest neighbours.

Distances are ranked at nine decimals and ties go to the smaller item id, so a
result does not depend on how rows were split or in which order sums were taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import BROADCAST_BYTES, at_most
from ..functions.vectors import check_width, cosine_distance, l2_distance

DECIMALS = 9
# Rows of one side of a cell that meet in one task.
BLOCK_ROWS = 32_768
# Entries of one distance matrix inside a task (32 MB of doubles).
MATRIX_ENTRIES = 4_000_000
METRICS = ("l2", "cosine")


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    return l2_distance(a, b) if metric == "l2" else cosine_distance(a, b)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column without nulls as an (n, width) matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    n = len(column)
    if n and (flat.size % n or (np.diff(np.asarray(column.offsets)) != flat.size // n).any()):
        raise ValueError("vectors of one collection must all have the same width")
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of paired rows, straight from the definition."""
    if metric == "l2":
        gap = q - x
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))
    length = np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x))
    dots = np.einsum("ij,ij->i", q, x)
    return 1.0 - np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)


def _one_of_each(x: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep when equal vectors are thinned to their k smallest ids.

    Equal vectors have equal distances, so no other copy can reach a top k.
    """
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    by_group = np.lexsort((order, group))
    starts = np.concatenate([[True], np.diff(group[by_group]) != 0])
    first = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
    return np.sort(by_group[np.arange(len(starts)) - first < k])


class Block:
    """Items made ready once to be searched for any number of queries."""

    def __init__(self, x: np.ndarray, x_ids: np.ndarray, k: int, metric: str):
        self.k, self.metric, self.width = k, metric, x.shape[1] if len(x) else None
        if not len(x):
            return
        _, id_rank = np.unique(x_ids, return_inverse=True)
        self.kept = _one_of_each(x, id_rank, k)
        self.x, self.id_rank = x[self.kept], id_rank[self.kept]
        self.unit = self.x
        if metric == "cosine":
            length = np.linalg.norm(self.x, axis=1, keepdims=True)
            self.unit = np.divide(self.x, length, out=np.zeros_like(self.x), where=length > 0)
        self.square = np.einsum("ij,ij->i", self.x, self.x)

    def top(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Top k items for every row of ``q``: (query row, item row, distance).

        A matrix product finds all rows that could still be in the top k given its
        rounding error; these few are measured again from the definition and ranked.
        """
        if not len(q) or self.width is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if q.shape[1] != self.width:
            raise ValueError(f"query width {q.shape[1]} does not match item width {self.width}")
        x, k, metric = self.x, self.k, self.metric
        step = max(1, MATRIX_ENTRIES // len(x))
        found = []
        for at in range(0, len(q), step):
            part = q[at:at + step]
            if metric == "cosine":
                length = np.linalg.norm(part, axis=1, keepdims=True)
                unit = np.divide(part, length, out=np.zeros_like(part), where=length > 0)
                rough = 1.0 - unit @ self.unit.T
                slack = np.full(len(part), 4e-9)
            else:
                square = np.einsum("ij,ij->i", part, part)
                rough = np.maximum(square[:, None] + self.square[None, :] - 2.0 * (part @ x.T), 0.0)
                slack = 1e-12 * (square + self.square.max()) + 1e-17
            if len(x) > k:
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
                if metric == "l2":
                    slack = slack + 8e-9 * np.sqrt(kth + slack)
                r, c = np.nonzero(rough <= (kth + slack)[:, None])
            else:
                r, c = np.nonzero(np.ones(rough.shape, dtype=bool))
            dist = np.concatenate([_exact(metric, part[r[i:i + 65536]], x[c[i:i + 65536]])
                                   for i in range(0, len(r), 65536)])
            dist = np.round(dist, DECIMALS) + 0.0
            order = np.lexsort((self.id_rank[c], dist, r))
            r, c, dist = r[order], c[order], dist[order]
            starts = np.searchsorted(r, np.arange(len(part)))
            top = np.arange(len(r)) - starts[r] < k
            found.append((r[top] + at, self.kept[c[top]], dist[top]))
        return tuple(np.concatenate(column) for column in zip(*found))


def block_top_k(q: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int,
                metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k rows of ``x`` for every row of ``q``: (query row, item row, distance)."""
    return Block(x, x_ids, k, metric).top(q)


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def hits(q_ids: np.ndarray, x_ids: np.ndarray, found: tuple, types: tuple) -> dict:
    r, c, dist = found
    return {"query_id": pa.array(q_ids[r], types[0]), "item_id": pa.array(x_ids[c], types[1]),
            "dist": pa.array(dist)}


def id_types(queries: DataFrame, items: DataFrame) -> tuple[tuple, str]:
    """Arrow types of both ids and the schema of a neighbour row."""
    from pyspark.sql.pandas.types import to_arrow_type

    q, x = queries.schema["query_id"].dataType, items.schema["item_id"].dataType
    schema = f"query_id {q.simpleString()}, item_id {x.simpleString()}, dist double"
    return (to_arrow_type(q), to_arrow_type(x)), schema


def keep_top(partial: DataFrame, k: int) -> DataFrame:
    """Merge partial results; each task keeps its k best per query before the shuffle."""
    best = Window.partitionBy("query_id").orderBy("dist", "item_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _bounded(df: DataFrame, width: int | None) -> bool:
    """Whether all vectors fit the broadcast limit as doubles.

    Only rows are counted, so a vector that is computed on the fly is not
    computed for it when its width is known.
    """
    if width is None:
        first = df.where("vector is not null").select(F.size("vector").alias("width")).first()
        if first is None:
            return True
        width = first["width"]
    return at_most(df, BROADCAST_BYTES // (8 * width + 64))


def send_items(items: DataFrame, item_id: str = "item_id", item_vector: str = "embedding", width: int | None = None):
    """Items sent to the tasks once, for many calls of :func:`knn_join` with ``sent``; None if they are too many."""
    x = items.select(F.col(item_id).alias("item_id"), F.col(item_vector).alias("vector"))
    return _sent(x.where("vector is not null")) if _bounded(x, width) else None


def _sent(x: DataFrame):
    table = x.toArrow()
    return x.sparkSession.sparkContext.broadcast((matrix(table["vector"]), ids_of(table["item_id"])))


def _with_broadcast_items(q: DataFrame, x: DataFrame, k: int, metric: str, sent=None) -> DataFrame:
    types, schema = id_types(q, x)
    shared = sent or _sent(x)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids = shared.value
        block = Block(vectors, ids, k, metric)
        for batch in batches:
            found = block.top(matrix(batch["vector"]))
            rank = np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) + 1
            yield pa.RecordBatch.from_pydict(
                hits(ids_of(batch["query_id"]), ids, found, types)
                | {"rank": pa.array(rank, pa.int32())})

    # A query meets all items at once, so its result is final and is not shuffled.
    return q.mapInArrow(search, schema + ", rank int")


def _with_broadcast_queries(q: DataFrame, x: DataFrame, k: int, metric: str) -> DataFrame:
    types, schema = id_types(q, x)
    table = q.toArrow()
    shared = q.sparkSession.sparkContext.broadcast(
        (matrix(table["vector"]), ids_of(table["query_id"])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids = shared.value
        row, item, dist = np.empty(0, np.int64), None, np.empty(0)
        for batch in batches:
            x_ids = ids_of(batch["item_id"])
            r, c, d = block_top_k(vectors, matrix(batch["vector"]), x_ids, k, metric)
            item = x_ids[c] if item is None else np.concatenate([item, x_ids[c]])
            row, dist = np.concatenate([row, r]), np.concatenate([dist, d])
            order = np.lexsort((np.unique(item, return_inverse=True)[1], dist, row))
            row, item, dist = row[order], item[order], dist[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, item, dist = row[top], item[top], dist[top]
        if item is not None:
            found = (row, np.arange(len(row)), dist)
            yield pa.RecordBatch.from_pydict(hits(ids, item, found, types))

    return keep_top(x.mapInArrow(search, schema), k)


def cell_search(q: DataFrame, x: DataFrame, on: list[str], k: int, metric: str) -> DataFrame:
    """Partial top k of the query and item blocks that share the keys ``on``."""
    types, schema = id_types(q, x)

    def search(queries: pa.Table, items: pa.Table) -> pa.Table:
        ids = ids_of(items["item_id"])
        found = block_top_k(matrix(queries["vector"]), matrix(items["vector"]), ids, k, metric)
        return pa.table(hits(ids_of(queries["query_id"]), ids, found, types))

    return q.groupBy(*on).cogroup(x.groupBy(*on)).applyInArrow(search, schema)


def block_of(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def knn_join(queries: DataFrame, items: DataFrame, k: int = 5, metric: str = "l2",
             query_id: str = "query_id", item_id: str = "item_id",
             query_vector: str = "embedding", item_vector: str = "embedding",
             strategy: str = "auto", width: int | None = None,
             block_rows: int | None = None, sent=None) -> DataFrame:
    """The k nearest items of every query: ``(query_id, item_id, dist, rank)``.

    A side that is counted to fit the broadcast limit is sent to the tasks and
    the other is streamed past it where it lies. When neither fits, both are cut
    into partitions with distance bounds. Null vectors take no part. Ids identify a row on
    their side. ``width`` is the vector length where the caller knows it. A
    strategy asked for by name is held to the same limit. Items that have been
    ``sent`` with :func:`send_items` are neither counted nor collected again.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if strategy not in ("auto", "items", "queries", "blocks"):
        raise ValueError("strategy is 'auto', 'items', 'queries' or 'blocks'")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    x = items.select(F.col(item_id).alias("item_id"), F.col(item_vector).alias("vector"))
    if sent is not None:
        strategy = "items"
    elif strategy == "auto":
        strategy = "items" if _bounded(x, width) else "queries" if _bounded(q, width) else "blocks"
    elif strategy != "blocks" and not _bounded(x if strategy == "items" else q, width):
        raise ValueError(f"the {strategy} are too many to send to every task")
    q, x = q.where("vector is not null"), x.where("vector is not null")
    if width is not None:
        # The size check relied on it.
        q, x = (side.withColumn("vector", check_width(F.col("vector"), width)) for side in (q, x))
    if strategy == "items":
        return _with_broadcast_items(q, x, k, metric, sent)
    if strategy == "queries":
        return _with_broadcast_queries(q, x, k, metric)
    from .partitioned import partition_join

    return partition_join(q, x, k, metric, block_rows)


def knn_single(items: DataFrame, vector: list[float], k: int = 5, metric: str = "l2",
               item_id: str = "item_id", item_vector: str = "embedding") -> DataFrame:
    """The k nearest items of one vector; one pass with a top-k per task."""
    target = F.lit([float(v) for v in vector])
    dist = F.round(distance(metric, F.col(item_vector), target), DECIMALS)
    return (items.where(F.col(item_vector).isNotNull())
            .select(F.col(item_id).alias("item_id"), dist.alias("dist"))
            .orderBy("dist", "item_id").limit(k))
