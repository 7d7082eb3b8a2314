"""A training-data pipeline over ``documents`` in stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but
the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearframe.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from nearframe.llm.tables import free_names, remainder, stored, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels outside the held-out fold.

    Null and empty texts have the score of the share of label 1. Null labels, and labels of null or unknown ids,
    teach nothing; without labels of both classes all documents have one score. Equal texts stay or go together.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, model, threshold=0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: that with the largest doc_id.

    Texts are compared with A-Z in lower case; null counts as empty. A null id is below every other; of rows
    with equal ids and texts one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id.

    Texts without words are near to nothing and stay. Shingles have five words, a shorter text is one shingle.
    """
    return near_dedup.drop_near_copies(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Items that are null or have no words are in no document; neither is anything in a text without words.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix with how often it takes them, ``copies``.

    A null source is a source of its own, the last; documents without words have size 0. Ranks are a hash of
    the id, so reruns agree; rows that agree in id, source and text are taken together. A table that already has ``copies`` gets ``copies_``.
    """
    copies, = free_names(docs, "copies")
    return mixing.mix(docs).where(F.col(copies) > 0)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
]

# The classifier is not expressible in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
