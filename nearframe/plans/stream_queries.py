"""Streams that read a table as arriving files and must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import scratch_path
from ..operators.cells import train_index
from ..operators.embedding import embed_column
from ..sources.telemetry_tail import tail_telemetry
from ..streaming import jobs
from ..streaming.calls import stream_call_gaps
from . import sql as S
from . import views
from .registry import query
from .run_queries import LAST, SPEC, STAMPED, stamped
from .text_queries import EMBEDDED
from .vector_queries import VOTE


def arriving(t, name):
    """A table as a stream of its files."""
    return (t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(t._folder))


def finished(stream):
    stream.awaitTermination()
    return stream


def docs(t):
    return arriving(t, "documents").select(F.col("doc_id").alias("id"), "text")


@query("stream_embed_append", EMBEDDED)
def _(t):
    path, checkpoint = scratch_path(t.spark, "stream"), scratch_path(t.spark, "progress")
    finished(jobs.stream_embed_append(docs(t), path, checkpoint))
    return views.long_form(t.spark.read.parquet(path), "id", "embedding")


@query("stream_embed_index", EMBEDDED)
def _(t):
    """The stream feeds an index whose centroids were fitted on other texts."""
    index = train_index(embed_column(t.benchmark, "text"), scratch_path(t.spark, "index"), item_id="item_id")
    finished(jobs.stream_embed_append(docs(t), index.path, scratch_path(t.spark, "progress"), index=index, item_id="id"))
    return views.long_form(index.items(t.spark).withColumnRenamed("item_id", "id"), "id", "embedding")


@query("stream_knn_vote", VOTE)
def _(t):
    # The collection is stored with its vectors, so a batch only embeds its own rows.
    stored = scratch_path(t.spark, "corpus")
    corpus = embed_column(views.labelled_documents(t), "text").withColumn("spam", F.col("spam").cast("boolean"))
    corpus.drop("text").write.parquet(stored)
    path, checkpoint = scratch_path(t.spark, "votes"), scratch_path(t.spark, "progress")
    turns = arriving(t, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    turns = embed_column(turns, "text").drop("text")
    finished(jobs.stream_knn_vote(turns, t.spark.read.parquet(stored), path, checkpoint, "spam",
                                  query_id="id", item_id="id", width=64))
    return t.spark.read.parquet(path).drop("batch")


@query("stream_telemetry", """
    SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
    FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def _(t):
    path, checkpoint = scratch_path(t.spark, "windows"), scratch_path(t.spark, "progress")
    finished(jobs.stream_telemetry(arriving(t, "events"), path, checkpoint, label="event_type"))
    out = t.spark.read.parquet(path)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n",
                      F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("stream_telemetry_gaps", S.with_(STAMPED, LAST, """
    wide AS (SELECT user_id, max(CASE WHEN label = 'signup' THEN epoch_us END) AS s, max(CASE WHEN label = 'purchase' THEN epoch_us END) AS p,
                    max(CASE WHEN label = 'view' THEN epoch_us END) AS v, max(CASE WHEN label = 'error' THEN epoch_us END) AS e FROM last GROUP BY 1)""", """
    over AS (SELECT user_id FROM stamped GROUP BY 1
             HAVING max(epoch_us) // 1000 + 86400000 <= (SELECT max(epoch_us) // 1000 - 3600000 FROM stamped))""") + """
    SELECT user_id, p - s AS to_purchase_us, e - v AS to_error_us, CAST(NULL AS BIGINT) AS to_none_us FROM wide JOIN over USING (user_id)""")
def _(t):
    """Log files are tailed; a call is over a day after its last line."""
    log = scratch_path(t.spark, "log")
    lines = stamped(t).repartitionByRange("line_no").sortWithinPartitions("line_no")
    lines.select(F.concat_ws("\t", F.col("epoch_us").cast("string"), "label", F.col("user_id").cast("string"))).write.text(log)
    path, checkpoint = scratch_path(t.spark, "gaps"), scratch_path(t.spark, "progress")
    # Names of the files, and the place within one, give the order of the lines.
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    arrived = tail_telemetry(t.spark, log).withColumn("line_no", F.shiftleft(part, 40) + F.col("line_no"))
    calls = arrived.withColumn("user_id", F.col("n").cast("bigint"))
    stream = stream_call_gaps(calls, SPEC, "user_id", path, checkpoint, once=False, late="1 hour", idle="1 day")
    # A run for what is there now would end before the watermark closes calls: sources in Python get one batch then.
    stream.processAllAvailable()
    stream.stop()
    return t.spark.read.parquet(path).withColumnRenamed("call", "user_id")


@query("stream_upsert", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(t):
    from ..sources.points import read_points

    path, checkpoint = scratch_path(t.spark, "points"), scratch_path(t.spark, "progress")
    rows = arriving(t, "events").select("user_id", "event_id", "value", F.col("event_id").alias("line"))
    finished(jobs.stream_upsert(rows, path, checkpoint, "user_id", "line"))
    return read_points(t.spark, path, "user_id")
