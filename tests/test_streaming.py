
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearframe.operators import neighbours
from nearframe.operators.cells import train_index
from nearframe.operators.embedding import embed_column
from nearframe.operators.retrieval import knn_vote
from nearframe.sources.points import read_points
from nearframe.streaming import jobs


@pytest.fixture
def texts(spark, tmp_path):
    """Texts arriving as three files, one file per batch."""
    path = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", F.concat(F.lit("word"), F.col("id") % 4, F.lit(" text")).alias("text")) \
            .coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id bigint, text string").option("maxFilesPerTrigger", 1).parquet(path)
    return spark.read.parquet(path), stream


def as_set(df, *columns):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("indexed", [False, True])
def test_embed_append_equals_batch_and_survives_a_replay(spark, texts, tmp_path, indexed):
    table, stream = texts
    out = str(tmp_path / "out")
    index = None
    if indexed:
        index = train_index(embed_column(table, "text"), out, cells=3, item_id="id")
    want = as_set(embed_column(table, "text"), "id", "embedding")
    for checkpoint in ("c1", "c2"):  # a lost checkpoint repeats every batch
        jobs.stream_embed_append(stream, out, str(tmp_path / checkpoint), index=index, item_id="id").awaitTermination()
        stored = index.items(spark).withColumnRenamed("item_id", "id") if indexed else spark.read.parquet(out)
        assert stored.count() == 30 and as_set(stored, "id", "embedding") == want
    if indexed:
        assert index.cells(spark).agg(F.sum("rows")).first()[0] == 30


def test_vote_equals_batch(spark, texts, tmp_path, monkeypatch):
    table, stream = texts
    corpus = embed_column(spark.createDataFrame(
        [(i, f"word{i % 4} text", i % 4 < 2) for i in range(40)], "id int, text string, spam boolean"), "text")
    want = as_set(knn_vote(embed_column(table, "text"), corpus, "spam", query_id="id", item_id="id"),
                  "query_id", "votes", "predicted")
    sent = []
    real = neighbours._sent
    monkeypatch.setattr(neighbours, "_sent", lambda x: sent.append(1) or real(x))
    jobs.stream_knn_vote(embed_column(stream, "text"), corpus, str(tmp_path / "v"), str(tmp_path / "c"), "spam",
                         query_id="id", item_id="id").awaitTermination()
    assert sent == [1]  # for three batches
    assert as_set(spark.read.parquet(str(tmp_path / "v")), "query_id", "votes", "predicted") == want
    assert len({p for _, p in as_set(spark.read.parquet(str(tmp_path / "v")), "query_id", "predicted")}) == 2


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [[("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 3.0)],
               [("2024-01-02 12:00:00", "a", 5.0)],
               # Rows are judged by the watermark of the batch before.
               [("2024-01-02 13:00:00", "a", 5.0)],
               [("2024-01-01 03:00:00", "a", 100.0), ("2024-01-04 00:00:00", "b", 7.0)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "ts string, label string, value double")
        df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts timestamp_ntz, label string, value double").option(
        "maxFilesPerTrigger", 1).parquet(path)
    jobs.stream_telemetry(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    out = [(str(r["start"]), r["label"], r["n"], r["mean"], r["std"]) for r in
           spark.read.parquet(str(tmp_path / "o")).orderBy("start").collect()]
    assert out == [("2024-01-01 00:00:00", "a", 2, 2.0, 1.0), ("2024-01-02 00:00:00", "a", 2, 5.0, 0.0)]


def test_upsert_keeps_the_last_row_of_each_id(spark, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "points")
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 8)), n, float(n)) for n in range(60)]
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i:i + 20], "id int, line int, x double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id int, line int, x double").option("maxFilesPerTrigger", 1).parquet(path)
    for checkpoint in ("c1", "c2"):
        jobs.stream_upsert(stream, target, str(tmp_path / checkpoint), "id", "line").awaitTermination()
        assert as_set(read_points(spark, target, "id"), "id", "x") == {(k, float(max(n for i, n, _ in rows if i == k))) for k, *_ in rows}
