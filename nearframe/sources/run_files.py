"""Wide run files and the telemetry log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import METRICS


def metrics_wide(long: DataFrame, methods: Sequence[str], metrics: Sequence[str] | None = None,
                 with_stats: bool = False) -> DataFrame:
    """One row per size with columns ``{method}_{metric}``.

    ``long`` is ``(size, method, metric, value)`` or, with statistics, a summary
    with ``mean, std, median, q1, q3``. Metrics nobody reports get no columns.
    """
    if metrics is None:
        reported = {r["metric"] for r in long.where(F.col("metric").isin(*METRICS)).select("metric").distinct().collect()}
        metrics = [m for m in METRICS if m in reported]
    parts = ([("", "mean"), ("_std", "std"), ("_median", "median"), ("_q1", "q1"), ("_q3", "q3")]
             if with_stats else [("", "value")])
    cells = [F.max(F.when((F.col("method") == m) & (F.col("metric") == x), F.col(c))).alias(f"{m}_{x}{suffix}")
             for m in methods for x in metrics for suffix, c in parts]
    return long.groupBy("size").agg(*cells)


def write_metrics_wide(long: DataFrame, path: str, methods: Sequence[str],
                       metrics: Sequence[str] | None = None, with_stats: bool = False) -> None:
    """Write the wide form as CSV with a header, ordered by size."""
    wide = metrics_wide(long, methods, metrics, with_stats)
    wide.orderBy("size").write.mode("overwrite").csv(path, header=True)


def read_runs(spark: SparkSession, folder: str, runs: bool = True) -> DataFrame:
    """All run files below a folder as one table.

    ``runs`` takes the files of single runs (``benchmark_*_run*.csv``), otherwise
    the joined files without them. Either may be a file or a folder that Spark
    wrote under that name. Copies below ``correct_output`` are left out. Files
    are read by the names in their own headers: columns may come in any order,
    and one that a file does not have is null for its rows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", r"/(benchmark_[^/]*\.csv)(/part-[^/]*)?$", 1)
    is_run = name.contains("_run")
    wanted = found.where((name != "") & (is_run if runs else ~is_run) & ~F.col("path").contains("/correct_output/"))
    # Names of files, not rows: one short line per run.
    paths = [r["path"] for r in wanted.orderBy("path").toLocalIterator()]
    if not paths:
        raise FileNotFoundError(f"no run files below {folder}")
    # One header line per file, read in one job.
    lines = (spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0)
             .select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
             .groupBy("path").agg(F.min_by("value", "line").alias("header")))
    by_header: dict[str, list[str]] = {}
    for r in lines.orderBy("path").toLocalIterator():
        by_header.setdefault(r["header"], []).append(r["path"])
    parts = []
    for header, files in by_header.items():
        schema = ", ".join(f"`{c}` {'int' if c == 'size' else 'double'}" for c in header.split(","))
        parts.append(spark.read.csv(files, schema=schema, header=True, enforceSchema=False))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``(line_no, epoch_us, label, n)``; broken lines are dropped.

    ``line_no`` orders lines by file name and place in the file, however the
    files are split over tasks, so the last line of a label can be told.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return parse_telemetry(spark.read.text(path).withColumn("line_no", place))


def parse_telemetry(lines: DataFrame, line: str = "value") -> DataFrame:
    fields = F.split(F.trim(line), "\t")
    stamp = F.get(fields, 0).try_cast("bigint")
    return (lines.where((F.size(fields) == 3) & stamp.isNotNull())
            .select("line_no", stamp.alias("epoch_us"), F.get(fields, 1).alias("label"),
                    F.get(fields, 2).alias("n")))
