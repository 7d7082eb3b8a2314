"""Approximate nearest neighbours through an index table of k-means cells.

The index is a Parquet table of items partitioned by batch and cell, next to small
tables of centroids and of rows and radius per batch and cell. Centroids stay frozen
while rows are added, so adding a batch only assigns and appends it and looks at no
row that is already there.

A batch counts once its rows and radii are written, which happens last; until then
readers pass over its items. An upsert also writes which (item, batch) pairs it
replaces; readers leave those out, whatever cell they lie in.

Upkeep (:func:`maintain`) works the same way. Small batches are written again as one,
which replaces their rows, and are deleted after that. A cell that has grown too large
is split: two centroids are added, its own takes no more rows, and its rows, with
those of neighbouring cells that lie nearer to a new centroid, are written as a batch
that replaces them. The centroid of a cell never changes, so at every moment each item
lies within the radius of its cell and an exact search stays exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import BROADCAST_BYTES, cut_lineage, store
from ..functions.text import stable_number
from .neighbours import BLOCK_ROWS, MATRIX_ENTRIES, block_of, cell_search, keep_top, matrix

# Batches an index may have before the smaller ones are put together, and how many it keeps apart then.
MOST_BATCHES, KEPT_BATCHES = 8, 4
# A cell is split beyond this many times the rows that cells had when the index was trained.
SPLIT_GROWTH = 4
# Cells around a split one whose rows may move to the new cells.
NEIGHBOUR_CELLS = 8
# Bound of the k-means sample: rows per centroid. All rows then take part in a full update of the centroids.
TRAIN_PER_CELL = 256
STATS = "cell int, rows bigint, radius double"
BATCH = "b-"  # in front of batch names, so that none is read as a number


@dataclass(frozen=True)
class CellIndex:
    path: str
    metric: str
    centroids: np.ndarray
    retired: tuple[int, ...] = ()

    @property
    def active(self) -> np.ndarray:
        """Cells that take rows."""
        return np.setdiff1d(np.arange(len(self.centroids)), self.retired)

    def batches(self, spark: SparkSession) -> list[str]:
        """Names of the batches that are complete; one short string per load."""
        stats = spark.read.parquet(f"{self.path}/stats").select("batch").distinct()
        return sorted(r["batch"] for r in stats.collect())

    def live(self, spark: SparkSession, without: str | None = None) -> DataFrame:
        """Items of complete batches that no complete batch has replaced, with their batch.

        ``without`` leaves out one batch and what it has replaced.
        """
        known = [b for b in self.batches(spark) if b != without]
        replaced = (spark.read.parquet(f"{self.path}/replaced").where(F.col("batch").isin(known))
                    .select("item_id", F.col("old").alias("batch")))
        items = spark.read.parquet(f"{self.path}/items").where(F.col("batch").isin(known))
        return items.join(replaced, ["item_id", "batch"], "left_anti").select(*items.columns)

    def items(self, spark: SparkSession) -> DataFrame:
        return self.live(spark).drop("batch")

    def cells(self, spark: SparkSession) -> DataFrame:
        """Rows and radius of every cell that holds items; replaced items still count."""
        cells = spark.read.parquet(f"{self.path}/stats").where("cell IS NOT NULL").groupBy("cell").agg(
            F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
        if not self.retired:
            return cells
        # A split cell is passed over unless a writer that did not know of the split has added to it.
        split = F.col("cell").isin([int(c) for c in self.retired])
        used = self.live(spark).where(split).select("cell").distinct()
        return cells.where(~split).unionByName(cells.join(used, "cell", "left_semi"))

    def needs_training(self, spark: SparkSession) -> bool:
        """Whether the rows have doubled since the centroids were fitted."""
        trained = spark.read.parquet(f"{self.path}/centroids").agg(F.max("trained_on")).first()[0]
        return (self.cells(spark).agg(F.sum("rows")).first()[0] or 0) >= 2 * trained


def _unit(v: np.ndarray, metric: str) -> np.ndarray:
    """Cosine search runs as L2 search on unit vectors."""
    if metric != "cosine":
        return v
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def _gaps(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", v, v)[:, None] + np.einsum("ij,ij->i", centroids, centroids)
    return np.sqrt(np.maximum(square - 2.0 * (v @ centroids.T), 0.0))


def _share(spark: SparkSession, centroids: np.ndarray, *more):
    """Send centroids to the tasks, within the broadcast limit."""
    if centroids.nbytes > BROADCAST_BYTES:
        raise ValueError("too many centroids to send to every task; build fewer cells")
    return spark.sparkContext.broadcast((centroids, *more))


def _slices(batch, width: int):
    """Pieces of a batch whose distances to ``width`` centroids fit one matrix."""
    step = max(1, MATRIX_ENTRIES // max(width, 1))
    for at in range(0, len(batch), step):
        yield at, batch.slice(at, step)


def fit_centroids(items: DataFrame, vector: str, cells: int, metric: str = "l2", seed: int = 7,
                  key: str = "item_id", rows: int | None = None) -> np.ndarray:
    """k-means centroids.

    k-means runs on a hash-chosen sample of at most about ``TRAIN_PER_CELL`` rows
    per centroid. If that is not all of them, every row is then assigned to its
    cell once and the centroids become the means of their cells.
    """
    from ..functions.vectors import l2_normalize

    rows = items.count() if rows is None else rows
    every = items.where(F.col(vector).isNotNull())
    if metric == "cosine":
        every = every.withColumn(vector, l2_normalize(F.col(vector))).where(F.col(vector).isNotNull())
    if cells == 1:
        mean = every.agg(Summarizer.mean(array_to_vector(vector)).alias("center")).first()["center"]
        return mean.toArray()[None, :]
    train, wanted = every, cells * TRAIN_PER_CELL
    if rows > wanted:
        share = int(2**32 * wanted / rows)
        train = every.where(stable_number(str(seed), F.col(key)) < share)
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(train.select(array_to_vector(vector).alias("features")))
    centroids = np.array(model.clusterCenters())
    if rows > wanted:
        means = (assign_cells(every.select(vector), vector, centroids, metric).groupBy("cell")
                 .agg(Summarizer.mean(array_to_vector(vector)).alias("center")))
        for r in means.toLocalIterator():  # one row per cell
            centroids[r["cell"]] = r["center"].toArray()
    return centroids


def assign_cells(items: DataFrame, vector: str, centroids: np.ndarray, metric: str = "l2",
                 cells: np.ndarray | None = None) -> DataFrame:
    """Add the nearest centroid (of those named by ``cells``) as ``cell`` and the distance to it as ``gap``."""
    cells = np.arange(len(centroids)) if cells is None else cells
    shared = _share(items.sparkSession, centroids[cells], cells.astype(np.int32))

    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centers, names = shared.value
        for batch in batches:
            cell, gap = np.empty(len(batch), np.int32), np.empty(len(batch))
            for at, part in _slices(batch, len(centers)):
                gaps = _gaps(_unit(matrix(part), metric), centers)
                rows = slice(at, at + len(part))
                cell[rows], gap[rows] = names[gaps.argmin(axis=1)], gaps.min(axis=1)
            yield pa.StructArray.from_arrays([pa.array(cell), pa.array(gap)], ["cell", "gap"])

    place = F.arrow_udf(nearest, "cell int, gap double").asNondeterministic()
    placed = items.where(F.col(vector).isNotNull()).withColumn("_place", place(F.col(vector)))
    return placed.select(*items.columns, "_place.cell", "_place.gap")


def _write_batch(placed: DataFrame, path: str, batch: str, replaced: DataFrame | None = None) -> None:
    """Write one batch; writing it again replaces it. Its statistics come last and make it count."""
    spark = placed.sparkSession
    # A batch that is written again is withdrawn first, so no old radius meets new items.
    spark.createDataFrame([], STATS).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/batch={BATCH}{batch}")
    if replaced is not None:
        replaced.write.mode("overwrite").parquet(f"{path}/replaced/batch={BATCH}{batch}")
    # Rows of one cell go to several files when the cell is large: AQE splits
    # the rebalanced partitions by size.
    items = f"{path}/items/batch={BATCH}{batch}"
    placed.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(items)
    # Reads two narrow columns of this batch only.
    stats = spark.read.schema("gap double, cell int").parquet(items).groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("gap").alias("radius"))
    # A row without a cell says that the batch is complete, also if it only takes rows away.
    complete = spark.createDataFrame([(None, 0, None)], STATS)
    stats.unionByName(complete).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/batch={BATCH}{batch}")


def _renamed(items: DataFrame, item_id: str, vector: str) -> DataFrame:
    return items.withColumnRenamed(item_id, "item_id").withColumnRenamed(vector, "embedding")


def train_index(items: DataFrame, path: str, cells: int | None = None, metric: str = "l2", item_id: str = "item_id",
                vector: str = "embedding", seed: int = 7, stored: bool = False) -> CellIndex:
    """Fit centroids on ``items``, which are written first unless they are ``stored``, and write an index
    without items to a new path.

    By default there are as many cells as a cell has rows, unless their
    centroids would not fit the broadcast limit.
    """
    spark = items.sparkSession
    table = _renamed(items, item_id, vector).where("embedding is not null").select("item_id", "embedding")
    table = table if stored else store(table, "train")
    rows = table.count()
    width = table.select(F.size("embedding").alias("n")).first()["n"] if rows else 1
    cells = cells or int(min(BROADCAST_BYTES // (8 * width), max(1, rows ** 0.5)))
    centroids = fit_centroids(table, "embedding", cells, metric, seed, rows=rows)
    spark.createDataFrame(
        [(i, [float(v) for v in c], metric, rows) for i, c in enumerate(centroids)],
        "cell int, center array<double>, metric string, trained_on bigint",
    ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")
    nothing = table.select("item_id", F.lit("").alias("old")).limit(0)
    nothing.write.parquet(f"{path}/replaced/batch={BATCH}")
    spark.createDataFrame([], STATS).coalesce(1).write.parquet(f"{path}/stats/batch={BATCH}")
    spark.createDataFrame([], "cell int").coalesce(1).write.parquet(f"{path}/retired")
    return CellIndex(path, metric, centroids)


def build_index(items: DataFrame, path: str, cells: int | None = None, metric: str = "l2",
                item_id: str = "item_id", vector: str = "embedding", seed: int = 7) -> CellIndex:
    """Fit centroids, assign all items and write the index tables to a new path."""
    table = store(_renamed(items, item_id, vector).where("embedding is not null"), "items")
    index = train_index(table, path, cells, metric, seed=seed, stored=True)
    _write_batch(assign_cells(table, "embedding", index.centroids, metric), path, "first")
    return index


def open_index(spark: SparkSession, path: str) -> CellIndex:
    retired = tuple(r["cell"] for r in spark.read.parquet(f"{path}/retired").distinct().orderBy("cell").collect())
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return CellIndex(path, rows[0]["metric"], np.array([r["center"] for r in rows]), retired)


def append_to_index(index: CellIndex, rows: DataFrame, item_id: str = "item_id",
                    vector: str = "embedding", batch: str | None = None) -> None:
    """Add rows with new ids to an index, each to the cell of its nearest centroid.

    A batch with a name can be repeated without adding its rows twice.
    """
    placed = assign_cells(_renamed(rows, item_id, vector), "embedding", index.centroids, index.metric, index.active)
    _write_batch(placed, index.path, batch or uuid.uuid4().hex)


def upsert_index(index: CellIndex, rows: DataFrame, batch: str, item_id: str = "item_id",
                 vector: str = "embedding") -> None:
    """Add rows or replace those with the same ids. Repeating a batch changes nothing.

    Ids identify a row within ``rows``. Of the index only ids and batches are read.
    """
    spark = rows.sparkSession
    table = store(_renamed(rows, item_id, vector).where("embedding is not null"), "upsert")
    if index.batches(spark):
        replaced = (index.live(spark, without=f"{BATCH}{batch}").select("item_id", F.col("batch").alias("old"))
                    .join(table.select("item_id"), "item_id", "left_semi"))
    else:
        replaced = table.select("item_id", F.lit("").alias("old")).limit(0)
    replaced = store(replaced, "replaced")
    placed = assign_cells(table, "embedding", index.centroids, index.metric, index.active)
    _write_batch(placed, index.path, batch, replaced)


def merge_batches(index: CellIndex, spark: SparkSession, most: int = MOST_BATCHES, kept: int = KEPT_BATCHES) -> int:
    """Write the smaller batches as one if there are more than ``most``; returns how many went.

    All but the ``kept`` largest are put together, so a row is written again about as
    often as the index doubles. Nobody else may write or merge meanwhile, and readers
    that are at work on the old batches have to start again.
    """
    sizes = spark.read.parquet(f"{index.path}/stats").groupBy("batch").agg(F.sum("rows").alias("rows")).collect()
    if len(sizes) <= most:
        return 0
    small = sorted((r["rows"], r["batch"]) for r in sizes)[:len(sizes) - kept]
    names = [name for _, name in small]
    known = [r["batch"] for r in sizes if r["batch"] not in names]
    rows = store(index.live(spark).where(F.col("batch").isin(names)), "merged")
    # What the small batches had replaced in those that stay is replaced still.
    older = (spark.read.parquet(f"{index.path}/replaced")
             .where(F.col("batch").isin(names) & F.col("old").isin(known)).select("item_id", "old"))
    replaced = store(rows.select("item_id", F.col("batch").alias("old")).unionByName(older), "replaced")
    _write_batch(rows.drop("batch"), index.path, f"merged-{uuid.uuid4().hex}", replaced)
    for name in names:
        # The statistics go first: without them the rest does not count.
        for table in ("stats", "items", "replaced"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/{table}/batch={name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(names)


def _halves(x: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Two centers of some rows, from the row farthest from the mean and the one farthest from that."""
    first = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    centers = np.stack([first, x[((x - first) ** 2).sum(1).argmax()]])
    for _ in range(rounds):
        side = _gaps(x, centers).argmin(1)
        if side.min() == side.max():
            break
        centers = np.stack([x[side == 0].mean(0), x[side == 1].mean(0)])
    return centers


def split_cells(index: CellIndex, spark: SparkSession, most_rows: int, seed: int = 7) -> CellIndex:
    """Split every cell of more than ``most_rows`` live rows in two, unless its rows are copies of one vector.

    The two centers come from a sample of the cell, bounded as that of k-means.
    """
    live = index.live(spark)
    full = {r["cell"]: r["n"] for r in live.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > most_rows).collect()}
    if not full:
        return index
    metric = index.metric
    share = F.create_map(*[F.lit(v) for c, n in full.items() for v in (int(c), int(2**32 * min(1, 2 * TRAIN_PER_CELL / n)))])
    sample = (live.where(F.col("cell").isin(list(full))).select("cell", "item_id", "embedding")
              .where(stable_number(str(seed), F.col("item_id")) < share[F.col("cell")]))

    def halve(rows: pa.Table) -> pa.Table:
        centers = _halves(_unit(matrix(rows["embedding"]), metric))
        return pa.table({"cell": rows["cell"].slice(0, 1).combine_chunks(), "centers": [centers.tolist()]})

    made = {r["cell"]: np.array(r["centers"]) for r in
            sample.groupBy("cell").applyInArrow(halve, "cell int, centers array<array<double>>").collect()}
    made = {c: pair for c, pair in made.items() if np.linalg.norm(pair[0] - pair[1]) > 0}
    if not made:
        return index
    start = len(index.centroids)
    centroids = np.concatenate([index.centroids, *made.values()])
    after = CellIndex(index.path, metric, centroids, tuple(sorted({*index.retired, *map(int, made)})))
    around = {c for old in made for c in index.active[_gaps(index.centroids[[old]], index.centroids[index.active])[0]
                                                      .argsort()[:NEIGHBOUR_CELLS + 1]]}
    spark.createDataFrame([(start + i, [float(v) for v in centroids[start + i]], metric, 0) for i in range(2 * len(made))],
                          "cell int, center array<double>, metric string, trained_on bigint"
                          ).coalesce(1).write.mode("append").parquet(f"{index.path}/centroids")
    spark.createDataFrame([(int(c),) for c in made], "cell int").coalesce(1).write.mode("append").parquet(f"{index.path}/retired")
    old = live.where(F.col("cell").isin([int(c) for c in around | set(made)])).withColumnRenamed("cell", "_cell").drop("gap")
    moved = store(assign_cells(old, "embedding", centroids, metric, after.active).where("cell <> _cell").drop("_cell"), "moved")
    replaced = moved.select("item_id", F.col("batch").alias("old"))
    _write_batch(moved.drop("batch"), index.path, f"split-{uuid.uuid4().hex}", replaced)
    return after


def maintain(index: CellIndex, spark: SparkSession, most_batches: int = MOST_BATCHES, most_rows: int | None = None) -> CellIndex:
    """Merge small batches and split large cells until neither is left to do; to be called between writes.

    By default a cell is split beyond ``SPLIT_GROWTH`` times the rows that cells had when the
    index was trained, so the number of cells grows with the items.
    """
    if most_rows is None:
        trained = spark.read.parquet(f"{index.path}/centroids").where("trained_on > 0").agg(
            F.max("trained_on").alias("rows"), F.count(F.lit(1)).alias("cells")).first()
        most_rows = max(1, SPLIT_GROWTH * -(-(trained["rows"] or 1) // max(trained["cells"], 1)))
    while True:
        merge_batches(index, spark, most_batches, min(KEPT_BATCHES, most_batches))
        after = split_cells(index, spark, most_rows)
        if after is index:
            return index
        index = after


def ingest(items: DataFrame, path: str, index: str = "deferred", cells: int | None = None,
           metric: str = "l2", item_id: str = "item_id", vector: str = "embedding",
           trained: CellIndex | None = None, batch: str | None = None) -> CellIndex | None:
    """Load items under one of three disciplines.

    ``immediate`` adds to the index ``trained``, replacing rows with the same
    ids, so a load that is repeated does not double them; ``deferred`` loads
    everything and then indexes it once; ``none`` writes a plain table.
    """
    if index == "immediate":
        if trained is None:
            raise ValueError("immediate ingest needs a trained index")
        upsert_index(trained, items, batch or uuid.uuid4().hex, item_id, vector)
        return trained
    if index == "deferred":
        return build_index(items, path, cells, metric, item_id, vector)
    if index == "none":
        _renamed(items, item_id, vector).write.mode("overwrite").parquet(f"{path}/items")
        return None
    raise ValueError("index is 'immediate', 'deferred' or 'none'")


def _probe(queries: DataFrame, index: CellIndex, cells: list, nprobe: int | None) -> DataFrame:
    """Cells to visit per query: the ``nprobe`` nearest, or, with a ``bound``
    column and no ``nprobe``, every cell not yet visited that may hold an item
    within the bound."""
    known = np.array([c["cell"] for c in cells])
    radius = np.array([c["radius"] for c in cells])
    shared = _share(queries.sparkSession, index.centroids[known], known, radius)
    metric = index.metric

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, known, radius = shared.value
        longest = np.linalg.norm(centers, axis=1).max()
        for whole in batches:
            for _, batch in _slices(whole, len(known)):
                v = _unit(matrix(batch["vector"]), metric)
                gaps = _gaps(v, centers)
                near = np.argsort(gaps, axis=1, kind="stable")
                wanted = np.zeros(gaps.shape, dtype=bool)
                if nprobe is not None:
                    np.put_along_axis(wanted, near[:, :nprobe], True, axis=1)
                else:
                    bound = batch["bound"].to_numpy(zero_copy_only=False)[:, None]
                    seen = np.asarray(batch["seen"])[0]
                    np.put_along_axis(wanted, near[:, seen:], True, axis=1)
                    # Room for the rounding of the distances to centroids.
                    slack = 1e-6 * (1 + np.linalg.norm(v, axis=1)[:, None] + longest)
                    wanted &= gaps - radius <= bound + slack
                r, c = np.nonzero(wanted)
                rows = pa.array(r)
                yield pa.RecordBatch.from_pydict({"query_id": batch["query_id"].take(rows),
                                                  "vector": batch["vector"].take(rows),
                                                  "cell": pa.array(known[c], pa.int32())})

    fields = {f.name: f.dataType for f in queries.schema}
    schema = (T.StructType().add("query_id", fields["query_id"])
              .add("vector", fields["vector"]).add("cell", T.IntegerType()))
    return queries.mapInArrow(visit, schema)


def probe(queries: DataFrame, centroids: np.ndarray, metric: str, nprobe: int) -> DataFrame:
    """(query_id, vector, cell) of the ``nprobe`` nearest cells of every query."""
    cells = [{"cell": i, "radius": 0.0} for i in range(len(centroids))]
    return _probe(queries, CellIndex("", metric, centroids), cells, nprobe)


def _search(probes: DataFrame, index: CellIndex, cells: list, k: int, block_rows: int) -> DataFrame:
    """Search the probed cells; cells and query crowds beyond a block are cut up."""
    spark = probes.sparkSession
    # Read twice: to count the crowds and to search.
    probes = store(probes, "probes")
    # One row per cell, so the collected counts are bounded by the cell count.
    crowd = {r["cell"]: r["n"] for r in
             probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    plan = [(c["cell"], -(-crowd[c["cell"]] // block_rows), -(-c["rows"] // block_rows))
            for c in cells if c["cell"] in crowd]
    splits = F.broadcast(spark.createDataFrame(plan, "cell int, q_blocks int, x_blocks int"))
    items = index.items(spark)
    if len(plan) < len(cells):
        items = items.where(F.col("cell").isin([p[0] for p in plan]))
    x = items.select("cell", "item_id", F.col("embedding").alias("vector")).join(splits, "cell")
    x = (x.withColumn("_x", block_of("item_id", F.col("x_blocks")))
         .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))))
    q = probes.join(splits, "cell")
    q = (q.withColumn("_q", block_of("query_id", F.col("q_blocks")))
         .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))))
    keys = ["cell", "_q", "_x"]
    return cell_search(q.select("query_id", "vector", *keys), x.select("item_id", "vector", *keys),
                       keys, k, index.metric)


def ann_search(index: CellIndex, queries: DataFrame, k: int = 5, nprobe: int = 8,
               exact: bool = False, query_id: str = "query_id", query_vector: str = "embedding",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest items through the index: ``(query_id, item_id, dist, rank)``.

    Each query visits its ``nprobe`` nearest cells. With ``exact`` it then also
    visits every cell that, by the triangle inequality, may hold an item nearer
    than the k-th found so far; the result equals a full search.
    """
    spark = queries.sparkSession
    cells = index.cells(spark).collect()
    if not cells:
        raise ValueError("the index holds no items")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    q = q.where("vector is not null")
    if exact and nprobe < len(cells):
        q = store(q, "queries")
    first = _search(_probe(q, index, cells, nprobe), index, cells, k, block_rows)
    if not exact or nprobe >= len(cells):
        return keep_top(first, k)
    # At most k rows per query, used for the bound and again in the final merge.
    near = cut_lineage(keep_top(first, k).drop("rank"))
    kth = near.groupBy("query_id").agg(F.max("dist").alias("kth"), F.count(F.lit(1)).alias("n"))
    # Cosine distance d of unit vectors is an L2 distance of sqrt(2 d).
    reach = F.sqrt(2 * F.col("kth")) if index.metric == "cosine" else F.col("kth")
    bound = F.when(F.col("n") >= k, reach).otherwise(F.lit(float("inf")))
    rest = (q.join(kth, "query_id", "left")
            .select("query_id", "vector", F.coalesce(bound, F.lit(float("inf"))).alias("bound"),
                    F.lit(nprobe).alias("seen")))
    more = _search(_probe(rest, index, cells, None), index, cells, k, block_rows)
    return keep_top(reduce(DataFrame.unionByName, [near, more]), k)
