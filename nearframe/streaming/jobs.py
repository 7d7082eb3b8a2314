"""Streams: embed and append, classify on arrival, telemetry windows, upsert.

Every job names its checkpoint folder, and every sink tolerates a repeated
batch: a batch writes to its own folder or merges by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..context import store
from ..operators.cells import CellIndex, append_to_index
from ..operators.embedding import embed_column
from ..operators.neighbours import send_items
from ..operators.retrieval import knn_vote
from ..sources.points import upsert_points


def _start(stream: DataFrame, run, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_embed_append(stream: DataFrame, path: str, checkpoint: str, text: str = "text",
                        backend: str = "hash", model: str = "hash-64", index: CellIndex | None = None,
                        item_id: str = "item_id", once: bool = True, name: str = "stream") -> StreamingQuery:
    """Embed arriving rows and append them to a table, or to an index if one is given.

    A batch replaces what an earlier try of the same batch wrote. Streams that
    share a target need names of their own.
    """
    def run(batch: DataFrame, number: int) -> None:
        rows = embed_column(batch, text, backend, model)
        if index is not None:
            append_to_index(index, rows, item_id, batch=f"{name}-{number}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/batch={name}-{number}")

    return _start(stream, run, checkpoint, once)


def stream_knn_vote(stream: DataFrame, items: DataFrame, path: str, checkpoint: str, label: str = "label",
                    k: int = 5, min_votes: int = 3, query_id: str = "query_id", item_id: str = "item_id",
                    once: bool = True, name: str = "stream", **options) -> StreamingQuery:
    """Classify arriving vectors against a static collection, which is stored once for all batches, and
    counted, collected and sent to the tasks once if it is within the limit for that."""
    items = store(items, "collection")
    options["sent"] = send_items(items, item_id, width=options.get("width"))

    def run(batch: DataFrame, number: int) -> None:
        votes = knn_vote(batch, items, label, k, min_votes, query_id, item_id, **options)
        votes.write.mode("overwrite").parquet(f"{path}/batch={name}-{number}")

    return _start(stream, run, checkpoint, once)


def telemetry_windows(df: DataFrame, stamp: str = "ts", label: str = "label", value: str = "value",
                      window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Statistics per window and label; rows later than the watermark are dropped."""
    timed = df.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    return timed.groupBy(F.window(stamp, window), label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    ).select(F.col("window.start").alias("start"), label, "n", "mean", "std")


def stream_telemetry(stream: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Append closed windows to a Parquet table."""
    writer = (telemetry_windows(stream, **options).writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str | None = None,
                  once: bool = True) -> StreamingQuery:
    """Upsert arriving points by id. Applying a batch twice gives the same collection."""
    def run(batch: DataFrame, _number: int) -> None:
        upsert_points(batch.sparkSession, path, batch, key, order)

    return _start(stream, run, checkpoint, once)
