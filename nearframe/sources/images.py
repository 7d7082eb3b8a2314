"""Image folders: one folder per person or label, files read as binary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..context import with_position
from ..functions.text import parent_label

# File endings taken as images, in their order within a folder.
PNG_FIRST = ("png", "jpg", "jpeg")
JPG_FIRST = ("jpg", "jpeg", "png")
MIN_FILES = 80


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder: ``(path, length, modificationTime, content)``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def _ending(path: Column, order: tuple[str, ...]) -> Column:
    place = F.lit(None).cast("int")
    for i, e in enumerate(order):
        place = F.when(path.endswith("." + e), F.lit(i)).otherwise(place)
    return place


def pick_images(files: DataFrame, n_dirs: int, per_dir: int, offset: int = 0, min_files: int = MIN_FILES,
                order: tuple[str, ...] = PNG_FIRST, count_all: bool = True) -> DataFrame:
    """``(dir_no, label, n, path)``: files ``[offset, offset + per_dir)`` of ``n_dirs`` folders.

    Folders with at least ``min_files`` files are taken by name and used again
    from the first when there are too few. ``count_all`` counts every file of a
    folder towards the minimum, otherwise images only.
    """
    files = files.select("path", parent_label(F.col("path")).alias("label"))
    files = files.withColumn("_ending", _ending(F.col("path"), order))
    counted = files if count_all else files.where("_ending is not null")
    dirs = counted.groupBy("label").agg(F.count(F.lit(1)).alias("_files")).where(F.col("_files") >= min_files)
    placed = with_position(dirs.select("label"), "label", name="_pos", start=0)
    found = placed.count()
    if not found:
        raise ValueError(f"no folder has {min_files} files")
    # Folder slot s shows folder s modulo the number of folders.
    rounds = F.sequence(F.lit(0), F.lit((n_dirs - 1) // found))
    slots = (placed.withColumn("_round", F.explode(rounds))
             .withColumn("dir_no", (F.col("_pos") + F.col("_round") * found).cast("int"))
             .where(F.col("dir_no") < n_dirs).select("label", "dir_no"))
    by_name = Window.partitionBy("label").orderBy("_ending", "path")
    listed = (files.where("_ending is not null").withColumn("n", F.row_number().over(by_name))
              .where((F.col("n") > offset) & (F.col("n") <= offset + per_dir)))
    return slots.join(listed, "label").select("dir_no", "label", "n", "path")


def scan_images(spark: SparkSession, folder: str, n_dirs: int, per_dir: int, **options) -> DataFrame:
    """``pick_images`` over a folder; lists files without reading their bytes."""
    return pick_images(read_files(spark, folder).select("path"), n_dirs, per_dir, **options)


def join_blobs(df: DataFrame, path_col: str, files: DataFrame, out: str = "content") -> DataFrame:
    """Attach file bytes ``(path, content)`` to rows by path."""
    blobs = files.select(F.col("path").alias("_path"), F.col("content").alias(out))
    return df.join(blobs, df[path_col] == F.col("_path")).drop("_path")


def attach_blobs(df: DataFrame, path_col: str, folder: str, out: str = "content") -> DataFrame:
    return join_blobs(df, path_col, read_files(df.sparkSession, folder), out)


def recycle_images(files: DataFrame, limit: int, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """``limit`` image rows ``(pos, path)`` in hash order, used again when there are too few."""
    images = files.select("path").where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("path")).cast("binary")) if shuffle else F.col("path")
    placed = with_position(images.withColumn("_order", order), "_order", "path", name="_pos", start=0)
    found = placed.count()
    if not found:
        raise ValueError("no images found")
    rounds = F.sequence(F.lit(0), F.lit((limit - 1) // found))
    return (placed.withColumn("_round", F.explode(rounds))
            .select((F.col("_pos") + F.col("_round") * found).alias("pos"), "path")
            .where(F.col("pos") < limit))


def image_corpus(spark: SparkSession, folder: str, limit: int, **options) -> DataFrame:
    return recycle_images(read_files(spark, folder), limit, **options)
