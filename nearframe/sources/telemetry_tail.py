"""Growing telemetry logs as a stream: every whole line once, from where the last batch ended.

An offset names, for every file, the byte behind its last whole line, so a line that is
still being written waits for the next batch. Spark keeps the offsets in the query's
checkpoint; a restart reads on from there. Ranges of a large file are read by several
tasks, each taking the lines that start in its own range. Files may grow and be added.
One that is shorter than what has been read of it is an error, since its lines are gone.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .run_files import parse_telemetry

SCHEMA = "file string, line_no bigint, value string"
# Bytes of a file that one task reads, and of a line end that is looked for at a time.
RANGE_BYTES, STEP = 32 << 20, 1 << 16
ROWS_OUT = 10_000


@dataclass
class Lines(InputPartition):
    file: str
    start: int
    stop: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def whole_lines(source, begin: int, size: int) -> int:
    """The byte behind the last line end between ``begin`` and ``size``, or ``begin``."""
    at = size
    while at > begin:
        low = max(begin, at - STEP)
        source.seek(low)
        found = source.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return begin


def lines_in(source, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of every line that starts in ``start``..``stop``; all of them end."""
    if start:
        source.seek(start - 1)
        first = source.readline()  # the end of a line that started before, or just its line end
        start += len(first) - 1
    source.seek(start)
    while start < stop:
        line = source.readline()
        yield start, line.rstrip(b"\n")
        start += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _open(self.path)
        found = {}
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.type == pafs.FileType.File and not info.base_name.startswith((".", "_")):
                with fs.open_input_file(info.path) as source:
                    found[info.base_name] = whole_lines(source, 0, info.size)
        return dict(sorted(found.items()))

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for file, stop in end.items():
            done = start.get(file, 0)
            if stop < done:
                raise ValueError(f"{file} has become shorter than the {done} bytes that were read of it")
            out += [Lines(file, at, min(at + self.range_bytes, stop)) for at in range(done, stop, self.range_bytes)]
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        places, values = [], []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([partition.file] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())],
                names=["file", "line_no", "value"])
            places.clear()
            values.clear()
            return made

        with io.BufferedReader(fs.open_input_file(f"{root}/{partition.file}")) as source:
            for place, line in lines_in(source, partition.start, partition.stop):
                places.append(place)
                values.append(line.decode("utf-8", "replace"))
                if len(places) == ROWS_OUT:
                    yield batch()
        if places:
            yield batch()

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch; the checkpoint has its offsets."""


class TelemetryTail(DataSource):
    """``spark.readStream.format("telemetry_tail")`` with options path and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail_telemetry(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (file, line_no, epoch_us, label, n); ``line_no`` is the place of the line in its file."""
    spark.dataSource.register(TelemetryTail)
    lines = spark.readStream.format("telemetry_tail").option("rangeBytes", range_bytes).load(path)
    # Parsing drops broken lines; file and place go along as the line's number.
    parsed = parse_telemetry(lines.withColumn("line_no", F.struct("file", "line_no")))
    return parsed.select("line_no.file", "line_no.line_no", "epoch_us", "label", "n")
