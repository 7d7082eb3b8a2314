"""Session helpers: shared scratch space, bounded size checks, row numbers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest relation that may be sent to every task.
BROADCAST_BYTES = 64 * 1024 * 1024


# Stands in for ``spark.checkpoint.dir`` in a one-machine session that has none; removed at exit.
_local_root: str | None = None


# Folders that were put to the test, by application: their full path, or none if they are not shared.
_tried: dict[tuple[str, str], str | None] = {}


def _if_shared(spark: SparkSession, root: str) -> str | None:
    """Full path of ``root`` if the driver and other tasks find there what tasks write, else none.

    One small job for each session and folder. A path without a scheme is one of the default file system.
    """
    key = spark.sparkContext.applicationId, root
    if key not in _tried:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/nearframe/trial-{uuid.uuid4().hex}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        full, tasks = files.makeQualified(path).toString(), 2 * spark.sparkContext.defaultParallelism
        try:
            spark.range(0, tasks, 1, tasks).write.parquet(full)
            found = spark.read.schema("id long").parquet(full).count()
        finally:
            files.delete(path, True)
        _tried[key] = full.rsplit("/nearframe/", 1)[0] if found == tasks else None
    return _tried[key]


def _tried_root(spark: SparkSession, root: str | None) -> str:
    """The first shared one of the folders that the session names: the one its checkpoints go to,
    ``spark.checkpoint.dir`` and the warehouse."""
    of_context = spark.sparkContext.getCheckpointDir()  # has a folder of its own below the one that was set
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    refused = None
    for folder in (of_context and of_context.rsplit("/", 1)[0], root, warehouse and f"{warehouse.rstrip('/')}/_scratch"):
        try:
            if folder and (full := _if_shared(spark, folder)):
                return full
        except Exception as error:  # not writable, or read by tasks that do not see it
            refused = error
    raise RuntimeError("no folder that the session names is shared") from refused


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster.

    A URI (``hdfs://``, ``s3a://``, ``file://`` for a mounted share) is taken at its
    word. A plain path on a cluster is most often a local disk, but may be a mounted
    share or one of the default file system, and a folder may also be set by
    ``setCheckpointDir`` only: such a folder is put to the test before it is used.
    Executors of ``local-cluster`` run on the driver's machine, where a plain path is
    shared; without the setting they may have temporary folders of their own.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    kind = spark.sparkContext.master.split("[")[0]
    if kind != "local" and not (root and (kind == "local-cluster" or "://" in root)):
        try:
            return _tried_root(spark, root)
        except Exception as error:
            raise RuntimeError("set spark.checkpoint.dir to a URI of a folder shared by all executors") from error
    if root:
        return root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="nearframe-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


# Scratch paths that this driver has handed out.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path below the shared folder."""
    _scratch.append(f"{shared_root(spark).rstrip('/')}/nearframe/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables of this driver; to be called once their results have been written or read."""
    gone = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so a lost executor does not recompute it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; stops reading beyond that."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    What is computed in ``df`` (a vector, say) is computed once, however often
    the result is used, and a lost executor costs a read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, *order: str, name: str = "pos", start: int = 1) -> DataFrame:
    """Number all rows 1..n in a total order without a single-task window.

    ``order`` has to identify a row, so that equal leading values still spread
    over the range partitions. The sorted rows are checkpointed with their
    place in their partition; only one offset per partition is added after.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", 33)
    row = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_rows"))
    # One row per shuffle partition, so this running sum is small by construction.
    offsets, offset = [0] * placed.rdd.getNumPartitions(), start
    for r in sizes.orderBy("_part").toLocalIterator():
        offsets[r["_part"]] = offset
        offset += r["_rows"]
    base = F.get(F.lit(offsets), part)
    return placed.withColumn(name, (base + row).cast("bigint")).drop("_place")
