"""Approximate and exact nearest neighbours through a tree of k-means cells.

A flat index sends all centroids to the tasks, which bounds their number. Here only
coarse centroids are sent. Each coarse cell has fine centroids of its own, in a table
that is joined by coarse cell, so there are as many fine cells as coarse cells times
what one task can hold. An item is assigned to its nearest coarse cell and, within it,
to the nearest fine one; both know how far their farthest item lies. A query visits the
nearest fine cells of its nearest coarse ones; an exact search then visits every coarse
and in it every fine cell that the triangle inequality cannot rule out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import BROADCAST_BYTES, cut_lineage, store
from ..functions.text import stable_number
from .cells import TRAIN_PER_CELL, _gaps, _probe, _renamed, _unit, assign_cells, CellIndex, fit_centroids
from .neighbours import BLOCK_ROWS, MATRIX_ENTRIES, block_of, cell_search, keep_top, matrix


@dataclass(frozen=True)
class TreeIndex:
    path: str
    metric: str
    coarse: np.ndarray

    def items(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/items")

    def fine(self, spark: SparkSession) -> DataFrame:
        """(coarse, cell, center, rows, radius) of every fine cell that holds items."""
        return spark.read.parquet(f"{self.path}/fine")


def _means(x: np.ndarray, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means of the rows of one task; cells that run empty are dropped."""
    x = np.unique(x, axis=0)
    centers = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([_gaps(part, centers).argmin(1) for part in _pieces(x, len(centers))])
        used, own = np.unique(own, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, own, x)
        centers = sums / np.bincount(own)[:, None]
    return centers


def _pieces(x: np.ndarray, width: int) -> list[np.ndarray]:
    step = max(1, MATRIX_ENTRIES // max(width, 1))
    return [x[at:at + step] for at in range(0, len(x), step)]


def _key_schema(df: DataFrame, **columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, df.schema[t].dataType if t in df.columns else T._parse_datatype_string(t))
                         for n, t in columns.items()])


def build_tree(items: DataFrame, path: str, coarse_cells: int | None = None, fine_cells: int | None = None, metric: str = "l2",
               item_id: str = "item_id", vector: str = "embedding", seed: int = 7, block_rows: int = BLOCK_ROWS) -> TreeIndex:
    """Fit both levels and write the index of ``items`` to a new path.

    ``fine_cells`` is their number in a coarse cell. By default both are the cube
    root of the rows, so coarse cells, fine cells in one, and rows in those are about as many.
    """
    spark = items.sparkSession
    table = store(_renamed(items, item_id, vector).where("embedding IS NOT NULL"), "tree-items")
    rows = table.count()
    if not rows:
        raise ValueError("a tree needs at least one vector")
    width = table.select(F.size("embedding").alias("n")).first()["n"]
    cube = max(1, round(rows ** (1 / 3)))
    coarse_cells = min(coarse_cells or cube, max(1, BROADCAST_BYTES // (8 * width)))
    fine_cells = min(fine_cells or cube, max(1, BROADCAST_BYTES // (8 * width)))
    coarse = fit_centroids(table, "embedding", coarse_cells, metric, seed, rows=rows)
    placed = store(assign_cells(table, "embedding", coarse, metric)
                   .withColumnRenamed("cell", "coarse").withColumnRenamed("gap", "coarse_gap"), "tree-coarse")
    # One row per coarse cell. Its sample for k-means is bounded as that of a flat index.
    sizes = placed.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
    share = F.broadcast(sizes.select("coarse", (F.lit(2.0**32 * fine_cells * TRAIN_PER_CELL) / F.col("n")).alias("share"),
                                     F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))

    def fit(group: pa.Table) -> pa.Table:
        centers = _means(_unit(matrix(group["embedding"]), metric), fine_cells, seed)
        return pa.table({"coarse": np.full(len(centers), group["coarse"][0].as_py(), np.int32),
                         "cell": np.arange(len(centers), dtype=np.int32), "center": list(centers)})

    fine = store(placed.join(share, "coarse").where(stable_number(str(seed), F.col("item_id")) < F.col("share"))
                 .select("coarse", "embedding").groupBy("coarse").applyInArrow(fit, "coarse int, cell int, center array<double>"),
                 "tree-fine")
    # A coarse cell beyond a block is cut up, and its fine centroids go along with every part.
    blocks = share.select("coarse", "blocks")
    cut = placed.join(blocks, "coarse").withColumn("part", block_of("item_id", F.col("blocks"))).drop("blocks")
    centers = fine.join(blocks, "coarse").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def assign(group: pa.Table, centers: pa.Table) -> pa.Table:
        if not len(group):
            return group.append_column("cell", pa.array([], pa.int32())).append_column("gap", pa.array([], pa.float64()))
        middle, names = matrix(centers["center"]), np.asarray(centers["cell"])
        cell, gap = [], []
        for part in _pieces(_unit(matrix(group["embedding"]), metric), len(middle)):
            gaps = _gaps(part, middle)
            cell.append(names[gaps.argmin(1)])
            gap.append(gaps.min(1))
        return (group.append_column("cell", pa.array(np.concatenate(cell), pa.int32()))
                .append_column("gap", pa.array(np.concatenate(gap))))

    keys = ["coarse", "part"]
    schema = T.StructType([*cut.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    done = cut.groupBy(*keys).cogroup(centers.groupBy(*keys)).applyInArrow(assign, schema).drop("part")
    done.write.mode("errorifexists").partitionBy("coarse").parquet(f"{path}/items")
    stats = spark.read.parquet(f"{path}/items").groupBy("coarse", "cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("gap").alias("radius"), F.max("coarse_gap").alias("coarse_radius"))
    fine.join(stats, ["coarse", "cell"]).write.parquet(f"{path}/fine")
    spark.createDataFrame([(i, [float(v) for v in c], metric) for i, c in enumerate(coarse)],
                          "coarse int, center array<double>, metric string").coalesce(1).write.parquet(f"{path}/coarse")
    return TreeIndex(path, metric, coarse)


def open_tree(spark: SparkSession, path: str) -> TreeIndex:
    rows = spark.read.parquet(f"{path}/coarse").orderBy("coarse").collect()
    return TreeIndex(path, rows[0]["metric"], np.array([r["center"] for r in rows]))


def _fine_probes(index: TreeIndex, spark: SparkSession, visits: DataFrame, block_rows: int) -> DataFrame:
    """(query_id, vector, bound, coarse, cell, gap) of the fine cells in the coarse cells that queries visit.

    With a bound only cells that may hold an item within it come out. Crowds of
    queries in one coarse cell are cut into blocks.
    """
    visits = store(visits, "visits")
    crowd = F.broadcast(visits.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    q = visits.join(crowd, "coarse").withColumn("part", block_of("query_id", F.col("blocks"))).drop("blocks")
    x = (index.fine(spark).join(crowd, "coarse").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
         .select("coarse", "part", "cell", "center", "radius"))
    metric = index.metric

    def near(asked: pa.Table, cells: pa.Table) -> pa.Table:
        out = {"query_id": asked["query_id"], "vector": asked["vector"], "bound": asked["bound"], "coarse": asked["coarse"]}
        r, c, gap = np.empty(0, int), np.empty(0, int), np.empty(0)
        if len(asked) and len(cells):
            centers, radius = matrix(cells["center"]), np.asarray(cells["radius"])
            v, bound = _unit(matrix(asked["vector"]), metric), asked["bound"].to_numpy()
            slack = 1e-6 * (1 + np.linalg.norm(v, axis=1) + np.linalg.norm(centers, axis=1).max())
            found, at = [], 0
            for part in _pieces(v, len(centers)):
                gaps, rows = _gaps(part, centers), slice(at, at + len(part))
                i, j = np.nonzero(gaps - radius <= (bound[rows] + slack[rows])[:, None])
                found.append((i + at, j, gaps[i, j]))
                at += len(part)
            r, c, gap = (np.concatenate(side) for side in zip(*found))
        rows = pa.array(r)
        return pa.table({n: a.take(rows) for n, a in out.items()} | {
            "cell": pa.array(np.asarray(cells["cell"])[c] if len(c) else np.empty(0, np.int32), pa.int32()), "gap": pa.array(gap)})

    schema = _key_schema(visits, query_id="query_id", vector="vector", bound="double", coarse="int", cell="int", gap="double")
    keys = ["coarse", "part"]
    return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(near, schema)


def _search_fine(index: TreeIndex, spark: SparkSession, probes: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Search the probed fine cells; large cells and crowds are cut into blocks before the shuffle."""
    keys = ["coarse", "cell"]
    probes = store(probes.select("query_id", "vector", *keys), "probes")
    crowd = probes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("q_blocks"))
    plan = store(crowd.join(index.fine(spark).select(*keys, F.ceil(F.col("rows") / block_rows).cast("int").alias("x_blocks")), keys),
                 "tree-plan")
    x = (index.items(spark).select(*keys, "item_id", F.col("embedding").alias("vector")).join(plan, keys)
         .withColumn("_x", block_of("item_id", F.col("x_blocks")))
         .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))))
    q = (probes.join(plan, keys).withColumn("_q", block_of("query_id", F.col("q_blocks")))
         .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))))
    on = [*keys, "_q", "_x"]
    return cell_search(q.select("query_id", "vector", *on), x.select("item_id", "vector", *on), on, k, index.metric)


def tree_search(index: TreeIndex, queries: DataFrame, k: int = 5, coarse_probes: int = 4, fine_probes: int = 8,
                exact: bool = False, query_id: str = "query_id", query_vector: str = "embedding",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest items through the tree: ``(query_id, item_id, dist, rank)``; with ``exact`` those of a full search."""
    spark = queries.sparkSession
    q = store(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
              .where("vector IS NOT NULL"), "queries")
    # One row per coarse cell that holds items.
    cells = [{"cell": r["coarse"], "radius": r["radius"]} for r in
             index.fine(spark).groupBy("coarse").agg(F.max("coarse_radius").alias("radius")).collect()]
    flat = CellIndex(index.path, index.metric, index.coarse)
    forever = F.lit(float("inf"))
    visits = _probe(q, flat, cells, coarse_probes).withColumnRenamed("cell", "coarse").withColumn("bound", forever)
    nearest = Window.partitionBy("query_id").orderBy("gap", "coarse", "cell")
    first = (_fine_probes(index, spark, visits, block_rows).withColumn("place", F.row_number().over(nearest))
             .where(F.col("place") <= fine_probes).drop("place"))
    first = store(first, "first-probes") if exact else first
    near = keep_top(_search_fine(index, spark, first, k, block_rows), k)
    if not exact:
        return near
    near = cut_lineage(near.drop("rank"))
    kth = near.groupBy("query_id").agg(F.max("dist").alias("kth"), F.count(F.lit(1)).alias("n"))
    reach = F.sqrt(2 * F.col("kth")) if index.metric == "cosine" else F.col("kth")
    bounded = (q.join(kth, "query_id", "left")
               .select("query_id", "vector", F.when(F.col("n") >= k, reach).otherwise(forever).alias("bound"), F.lit(0).alias("seen")))
    bounded = store(bounded, "bounds")
    visits = (_probe(bounded, flat, cells, None).withColumnRenamed("cell", "coarse")
              .join(bounded.select("query_id", "bound"), "query_id"))
    more = (_fine_probes(index, spark, visits, block_rows)
            .join(first.select("query_id", "coarse", "cell"), ["query_id", "coarse", "cell"], "left_anti"))
    return keep_top(near.unionByName(_search_fine(index, spark, more, k, block_rows)), k)
