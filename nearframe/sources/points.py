"""Point collections: tables of ``(id, embedding, payload)``.

A collection is a folder of numbered parts: ``base`` holds all points, each
later ``upsert`` only the points it brings. A reader puts them together, so an
upsert never rewrites the points it does not touch and no plan overwrites what
it reads. Parts without Spark's success marker are not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _parts(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = to_path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(folder)]
    return sorted((int(name.split("-")[1]), name) for p, name in names
                  if name.startswith(("base-", "upsert-")) and files.exists(to_path(p, "_SUCCESS")))


def _next(spark: SparkSession, path: str) -> int:
    parts = _parts(spark, path)
    return parts[-1][0] + 1 if parts else 0


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` of every id."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)


def merge_points(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per id: the new one where there is one, else the old one."""
    kept = old.join(new.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def create_points(path: str, df: DataFrame) -> None:
    """Create or replace a collection."""
    df.write.mode("overwrite").parquet(f"{path}/base-{_next(df.sparkSession, path)}")


def upsert_points(spark: SparkSession, path: str, df: DataFrame, key: str, order: str | None = None) -> None:
    """Insert points; a point whose id exists replaces the stored one.

    Within ``df`` the row with the highest ``order`` wins; without an order its
    ids have to be unique.
    """
    new = latest(df, key, order) if order is not None else df
    new.write.mode("overwrite").parquet(f"{path}/upsert-{_next(spark, path)}")


def read_points(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The points of a collection after all upserts."""
    parts = _parts(spark, path)
    if not parts:
        raise FileNotFoundError(f"no collection at {path}")
    bases = [p for p in parts if p[1].startswith("base-")]
    base = bases[-1] if bases else None
    later = [p for p in parts if base is None or p[0] > base[0]]
    stored = spark.read.parquet(f"{path}/{base[1]}") if base else None
    if not later:
        return stored
    # One scan of all changes, however many upserts there were; the folder's number tells which is newer.
    changes = (spark.read.option("mergeSchema", True).parquet(*[f"{path}/{name}" for _, name in later])
               .withColumn("_part", F.regexp_extract("_metadata.file_path", r"/upsert-(\d+)/[^/]*$", 1).cast("bigint")))
    new = latest(changes, key, "_part")
    return merge_points(stored, new, key) if stored is not None else new


def compact_points(spark: SparkSession, path: str, key: str) -> None:
    """Write the points as a new base, so that reading needs no merge."""
    create_points(path, read_points(spark, path, key))


def add_points(path: str, df: DataFrame) -> None:
    """Append points as they are, for collections whose ids are always new."""
    df.write.mode("append").parquet(path)


def as_documents(df: DataFrame, key: str, vector: str, text: str, metadata: list[str]) -> DataFrame:
    """Rows in the form of a string-id collection."""
    entries = [x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]
    return df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("embedding"),
                     F.col(text).alias("document"), F.create_map(*entries).alias("metadata"))
