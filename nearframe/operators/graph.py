"""Approximate nearest neighbours through navigable proximity graphs.

Items are dealt to k-means cells of about ``PART_ROWS`` rows, and every cell gets a
hierarchy of proximity graphs of its own, built where its rows meet: each vector is
linked to at most ``m`` of its ``ef_construction`` nearest ones, passing over those
that a linked one already leads to, and links go both ways. The graphs are Parquet
rows with adjacency arrays. A query goes to its nearest cells and there walks best
first, from the sparse layers down, with all queries of a cell taking each step together.

Equal vectors are one node that names all their ids. No cell depends on another, so
building and searching are spread over cells, and a lost task repeats one cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..context import BROADCAST_BYTES, store
from .cells import _unit, assign_cells, fit_centroids, probe
from .neighbours import BLOCK_ROWS, DECIMALS, MATRIX_ENTRIES, METRICS, _exact, block_of, hits, id_types, ids_of, keep_top, matrix

PART_ROWS = 8192
NONE = -1


@dataclass(frozen=True)
class GraphIndex:
    path: str
    metric: str
    centroids: np.ndarray

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/nodes")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices, or of two stacks of matrices."""
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2.0 * (a @ np.swapaxes(b, -1, -2)), 0.0)


def _rank_in(group: np.ndarray) -> np.ndarray:
    """Place of every row in its run of equal values; ``group`` is sorted."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def _chosen(x: np.ndarray, m: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) of every vector to ``m`` of its ``ef`` nearest.

    Taken from near to far, a candidate is passed over while one that is already
    linked is nearer to it than the vector itself. Places left go to the nearest
    of those.
    """
    n = len(x)
    ef, m = min(ef, n - 1), min(m, n - 1)
    step = max(1, min(MATRIX_ENTRIES // n, MATRIX_ENTRIES // (ef * max(ef, x.shape[1]))))
    sources, targets = [], []
    for at in range(0, n, step):
        part = x[at:at + step]
        rows = np.arange(len(part))
        gaps = _squares(part, x)
        gaps[rows, rows + at] = np.inf
        near = np.argpartition(gaps, ef - 1, axis=1)[:, :ef]
        own = np.take_along_axis(gaps, near, 1)
        order = np.lexsort((near, own), axis=1)
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        between = _squares(x[near], x[near])
        linked = np.zeros(near.shape, bool)
        for j in range(ef):
            nearest = np.where(linked[:, :j], between[:, j, :j], np.inf).min(1, initial=np.inf)
            linked[:, j] = (own[:, j] < nearest) & (linked[:, :j].sum(1) < m)
        first = np.argsort(~linked, axis=1, kind="stable")[:, :m]
        sources.append(np.repeat(rows + at, m))
        targets.append(np.take_along_axis(near, first, 1).ravel())
    return np.concatenate(sources), np.concatenate(targets)


def _reached(links: np.ndarray, start: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Mark all nodes that can be walked to from ``start``; returns the new ones."""
    found, front = [], start[~seen[start]]
    while len(front):
        seen[front] = True
        found.append(front)
        after = links[front].ravel()
        front = np.unique(after[after != NONE])
        front = front[~seen[front]]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _connected(x: np.ndarray, links: list[list[int]], entry: int) -> None:
    """Add a link to the nearest node that cannot be walked to from ``entry`` until all can."""
    seen = np.zeros(len(x), bool)
    new = _reached(_padded(links), np.array([entry]), seen)
    nearest, gap = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    while not seen.all():
        left = np.flatnonzero(~seen)
        step = max(1, MATRIX_ENTRIES // len(new))
        for at in range(0, len(left), step):  # only what was reached last can be nearer than before
            part = left[at:at + step]
            gaps = _squares(x[part], x[new])
            best = gaps.min(1)
            closer = best < gap[part]
            gap[part[closer]], nearest[part[closer]] = best[closer], new[gaps.argmin(1)[closer]]
        to = left[gap[left].argmin()]
        links[nearest[to]].append(int(to))
        new = _reached(_padded(links), np.array([to]), seen)


def _padded(links: list[list[int]]) -> np.ndarray:
    size = np.array([len(a) for a in links])
    out = np.full((len(links), max(1, size.max(initial=0))), NONE, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate([np.asarray(a, np.int64) for a in links])
    return out


def _layer(x: np.ndarray, m: int, most: int, ef: int, entry: int) -> list[list[int]]:
    """Adjacency lists of one layer: chosen links first, then links back, nearest first, up to ``most``."""
    if len(x) == 1:
        return [[]]
    a, b = _chosen(x, m, ef)
    gap = _exact("l2", x[a], x[b])
    source, target, back = np.concatenate([a, b]), np.concatenate([b, a]), np.repeat([0, 1], len(a))
    order = np.lexsort((target, np.tile(gap, 2), back, source))
    source, target = source[order], target[order]
    _, once = np.unique(source * len(x) + target, return_index=True)
    once.sort()
    source, target = source[once], target[once]
    kept = _rank_in(source) < most
    links = [list(map(int, t)) for t in np.split(target[kept], np.searchsorted(source[kept], np.arange(1, len(x))))]
    _connected(x, links, entry)
    return links


def layers_of(x: np.ndarray, order: np.ndarray, m: int = 16, ef_construction: int = 100) -> list[tuple[np.ndarray, list[list[int]]]]:
    """The layers of the graph over distinct vectors, from all nodes up: (nodes, links as positions among them).

    ``order`` has a random number per node; a layer keeps about one node in ``m``.
    The node with the smallest number is in all layers, and is where walks start.
    """
    level = np.floor(-np.log((np.argsort(np.argsort(order)) + 0.5) / len(x)) / np.log(m)).astype(int)
    out = []
    for l in range(level.max() + 1):
        nodes = np.flatnonzero(level >= l)
        entry = int(np.flatnonzero(nodes == order.argmin())[0])
        out.append((nodes, _layer(x[nodes], m, m if l else 2 * m, ef_construction, entry)))
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int,
         also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walks of all queries at once: the ``ef`` nearest nodes each has met, and their squared distances.

    ``also`` may name a second start per query (or ``NONE``); ``ef`` is 2 or more then.
    """
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x)), bool)
    seen[rows, start] = True
    node, gap = np.full((len(q), ef), NONE), np.full((len(q), ef), np.inf)
    node[:, 0], gap[:, 0] = start, ((q - x[start]) ** 2).sum(1)
    done = np.ones((len(q), ef), bool)
    done[:, 0] = False
    if also is not None:
        two = np.flatnonzero((also != NONE) & (also != start))
        seen[two, also[two]], done[two, 1] = True, False
        node[two, 1], gap[two, 1] = also[two], ((q[two] - x[also[two]]) ** 2).sum(1)
    while len(live := np.flatnonzero(~done.all(1))):
        pick = np.argmin(np.where(done[live], np.inf, gap[live]), axis=1)
        done[live, pick] = True
        after = links[node[live, pick]]
        fresh = (after != NONE) & ~seen[live[:, None], after]
        seen[live[:, None], np.where(fresh, after, node[live, pick][:, None])] = True
        far = np.where(fresh, ((q[live, None, :] - x[after]) ** 2).sum(2), np.inf)
        all_gap = np.concatenate([gap[live], far], 1)
        best = np.argsort(all_gap, axis=1, kind="stable")[:, :ef]
        gap[live] = np.take_along_axis(all_gap, best, 1)
        node[live] = np.take_along_axis(np.concatenate([node[live], after], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), best, 1) | np.isinf(gap[live])
    return node, gap


def _equal_row(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row of ``x`` that equals each row of ``q``, or ``NONE``; rows of ``x`` are distinct."""
    both = np.concatenate([x, q]) + 0.0
    raw = both.view(np.dtype((np.void, both.dtype.itemsize * both.shape[1]))).ravel()
    group = np.unique(raw, return_inverse=True)[1]
    row = np.full(len(both), NONE)
    row[group[:len(x)]] = np.arange(len(x))
    return row[group[len(x):]]


def _distinct(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and the ids of each in ascending order."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    by_group = np.lexsort((np.unique(ids, return_inverse=True)[1], group))
    return x[first], np.split(ids[by_group], np.searchsorted(group[by_group], np.arange(1, len(first))))


def build_graph(items: DataFrame, path: str, m: int = 16, ef_construction: int = 100, metric: str = "l2",
                item_id: str = "item_id", vector: str = "embedding", part_rows: int = PART_ROWS, seed: int = 7) -> GraphIndex:
    """Write a graph index of all ``items`` with a vector to a new path."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if m < 2 or ef_construction < m:
        raise ValueError("m is 2 or more, and ef_construction not below m")
    spark = items.sparkSession
    table = store(items.select(F.col(item_id).alias("item_id"), F.col(vector).alias("embedding")).where("embedding is not null"),
                  "graph-items")
    rows = table.count()
    if not rows:
        raise ValueError("a graph needs at least one vector")
    width = table.select(F.size("embedding").alias("n")).first()["n"]
    cells = int(min(max(1, BROADCAST_BYTES // (8 * width)), -(-rows // part_rows)))
    centroids = fit_centroids(table, "embedding", cells, metric, seed, rows=rows)
    placed = store(assign_cells(table, "embedding", centroids, metric), "graph-cells")
    # One row per cell; a cell beyond the wanted size is cut into blocks with a graph each.
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(blocks), "cell").withColumn("block", block_of("item_id", F.col("blocks")))
    id_type = to_arrow_type(table.schema["item_id"].dataType)
    schema = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("node", pa.int32()), ("item_ids", pa.list_(id_type)),
                        ("embedding", pa.list_(pa.float64())), ("links", pa.list_(pa.list_(pa.int32())))])

    def link(group: pa.Table) -> pa.Table:
        ids = ids_of(group["item_id"])
        x, owners = _distinct(matrix(group["embedding"]), ids)
        order = np.random.default_rng(seed).permutation(len(x))
        links: list[list] = [[] for _ in range(len(x))]
        for nodes, layer in layers_of(_unit(x, metric), order, m, ef_construction):
            for node, to in zip(nodes, layer):
                links[node].append(nodes[to])
        same = {c: pa.array(np.full(len(x), group[c][0].as_py()), pa.int32()) for c in ("cell", "block")}
        return pa.table(same | {"node": np.arange(len(x), dtype=np.int32), "item_ids": owners, "embedding": list(x),
                                "links": links}, schema=schema)

    id_name = table.schema["item_id"].dataType.simpleString()
    made = placed.select("cell", "block", "item_id", "embedding").groupBy("cell", "block").applyInArrow(
        link, f"cell int, block int, node int, item_ids array<{id_name}>, embedding array<double>, links array<array<int>>")
    made.write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/nodes")
    spark.createDataFrame([(i, [float(v) for v in c], metric) for i, c in enumerate(centroids)],
                          "cell int, center array<double>, metric string").coalesce(1).write.parquet(f"{path}/centroids")
    return GraphIndex(path, metric, centroids)


def open_graph(spark: SparkSession, path: str) -> GraphIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return GraphIndex(path, rows[0]["metric"], np.array([r["center"] for r in rows]))


def walk(nodes: pa.Table, q: np.ndarray, k: int, ef: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, node, distance) of up to ``k`` nearest nodes of one graph for every query.

    Few links may lead to a node, so that walks pass it by. A query that is itself a
    vector of the graph starts there too, and so always finds it.
    """
    nodes = nodes.sort_by("node")
    x = matrix(nodes["embedding"])
    unit, asked = _unit(x, metric), _unit(q, metric)
    layers = nodes["links"].to_pylist()
    levels = np.array([len(a) for a in layers])
    top = int(levels.argmax())
    own, wide = _equal_row(x, q), max(ef, k, 2)
    found = []
    step = max(1, MATRIX_ENTRIES // max(len(x), 64 * x.shape[1]))
    for at in range(0, len(q), step):
        part = asked[at:at + step]
        start = np.full(len(part), top)
        for level in range(int(levels.max()) - 1, -1, -1):
            links = _padded([a[level] if level < len(a) else [] for a in layers])
            node, _ = beam(unit, links, part, start, *((wide, own[at:at + step]) if level == 0 else (1,)))
            start = node[:, 0]
        r, c = np.nonzero(node != NONE)
        found.append((r + at, node[r, c]))
    r, c = (np.concatenate(side) for side in zip(*found))
    dist = np.round(_exact(metric, q[r], x[c]), DECIMALS) + 0.0
    order = np.lexsort((dist, r))
    kept = order[_rank_in(r[order]) < k]
    return r[kept], c[kept], dist[kept]


def graph_search(index: GraphIndex, queries: DataFrame, k: int = 5, ef: int = 100, nprobe: int = 4,
                 query_id: str = "query_id", query_vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """About the k nearest items: ``(query_id, item_id, dist, rank)``.

    Every query walks the graphs of its ``nprobe`` nearest cells with a beam of
    ``ef``. A crowd of queries in one cell is cut into blocks, which walk copies
    of its graph.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")).where("vector is not null")
    nodes = index.nodes(spark)
    probes = store(probe(q, index.centroids, index.metric, nprobe), "probes")
    crowd = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("crowd"))
    blocks = nodes.groupBy("cell").agg((F.max("block") + 1).alias("blocks")).join(crowd, "cell")
    blocks = F.broadcast(store(blocks, "plan"))  # one row per cell
    x = (nodes.join(blocks, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("crowd") - 1)))
         .select("cell", "block", "part", "node", "item_ids", "embedding", "links"))
    p = (probes.join(blocks, "cell").withColumn("part", block_of("query_id", F.col("crowd")))
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
         .select("cell", "block", "part", "query_id", "vector"))
    metric = index.metric
    types, schema = id_types(q, nodes.select(F.get("item_ids", F.lit(0)).alias("item_id")))

    def search(asked: pa.Table, graph: pa.Table) -> pa.Table:
        if not len(asked) or not len(graph):
            return pa.table(hits(np.empty(0), np.empty(0), (np.empty(0, int),) * 2 + (np.empty(0),), types))
        r, c, dist = walk(graph, matrix(asked["vector"]), k, ef, metric)
        owners = graph.sort_by("node")["item_ids"].to_pylist()
        # Equal vectors are equally far, so no more than k of their ids can be among the nearest.
        mine = [owners[i][:k] for i in c]
        size = np.array([len(a) for a in mine], int)
        flat = np.array([i for a in mine for i in a], object)
        return pa.table(hits(ids_of(asked["query_id"]), flat, (np.repeat(r, size), np.arange(len(flat)), np.repeat(dist, size)), types))

    keys = ["cell", "block", "part"]
    return keep_top(p.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(search, schema), k)
