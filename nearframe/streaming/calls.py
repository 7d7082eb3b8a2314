"""Intervals between the checkpoints of a call, kept over micro-batches.

The lines of a call may arrive in any batches. Its state holds, per label, the stamp of
the last line, which wins. An event-time timer, set anew by every line, closes the call
when the watermark has passed its latest stamp by an idle time; then its intervals are
emitted once and its state is dropped. A repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CallGaps(StatefulProcessor):
    """Last stamp per label of a call, and the differences that ``spec`` names when it closes."""

    def __init__(self, spec: dict[str, tuple[str, str]], idle_ms: int):
        self.spec, self.idle_ms = spec, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        label = T.StructType([T.StructField("label", T.StringType())])
        last = T.StructType([T.StructField("line", T.LongType()), T.StructField("stamp", T.LongType())])
        self.last = handle.getMapState("last", label, last)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest: dict[str, tuple[int, int]] = {}
        newest = None
        for row in rows:
            newest = row.epoch_us if newest is None else max(newest, row.epoch_us)
            if row.label not in latest or row.line_no > latest[row.label][0]:
                latest[row.label] = row.line_no, row.epoch_us
        for label, (line, stamp) in latest.items():
            if not self.last.containsKey((label,)) or self.last.getValue((label,))[0] < line:
                self.last.updateValue((label,), (line, stamp))
        due = newest // 1000 + self.idle_ms
        for timer in list(self.handle.listTimers()):
            due = max(due, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = {label[0]: value[1] for label, value in self.last.iterator()}
        self.last.clear()
        gaps = {out: at[b] - at[a] if a in at and b in at else None for out, (a, b) in self.spec.items()}
        yield Row(call=key[0], **gaps)

    def close(self) -> None:
        pass


def call_gaps(lines: DataFrame, spec: dict[str, tuple[str, str]], call: str, late: str = "1 hour", idle: str = "1 hour") -> DataFrame:
    """(call, one interval per name in ``spec``) of a stream of (call, label, epoch_us, line_no), once a call is over.

    An interval is null if one of its checkpoints is missing. Lines behind the
    watermark, which follows the newest stamp by ``late``, are dropped. The
    session has to keep state in RocksDB, see :func:`stream_call_gaps`.
    """
    idle_ms = lines.sparkSession.sql(f"SELECT CAST(INTERVAL {idle} AS INTERVAL DAY TO SECOND) i").first()["i"].total_seconds() * 1000
    timed = (lines.where(F.col(call).isNotNull() & F.col("label").isNotNull())
             .select(F.col(call).alias("call"), "label", "epoch_us", F.col("line_no").cast("bigint").alias("line_no"),
                     F.timestamp_micros("epoch_us").alias("at")).withWatermark("at", late))
    out = T.StructType([timed.schema["call"], *(T.StructField(n, T.LongType()) for n in spec)])
    return timed.groupBy("call").transformWithState(CallGaps(spec, int(idle_ms)), out, "Append", "EventTime")


def stream_call_gaps(lines: DataFrame, spec: dict[str, tuple[str, str]], call: str, path: str, checkpoint: str,
                     once: bool = True, **options) -> StreamingQuery:
    """Append the intervals of calls that are over to a Parquet table."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    writer = (call_gaps(lines, spec, call, **options).writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()
