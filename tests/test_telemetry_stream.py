import io

import pytest
from pyspark.sql import functions as F

from nearframe.operators.runs import telemetry_gaps
from nearframe.sources import telemetry_tail as tail
from nearframe.streaming.calls import stream_call_gaps

SPEC = {"work": ("start", "end"), "wait": ("start", "first"), "none": ("start", "absent")}


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_ranges_share_no_line(monkeypatch, cut):
    monkeypatch.setattr(tail, "STEP", 3)
    for text in (b"", b"\n", b"ab\n\ncde\nf\n", b"x\ny\nunfinished", b"unfinished"):
        end = tail.whole_lines(io.BytesIO(text), 0, len(text))
        assert end == text.rfind(b"\n") + 1
        got = [line for at in range(0, end, cut) for line in tail.lines_in(io.BytesIO(text), at, min(at + cut, end))]
        want, at = [], 0
        for line in text[:end].splitlines(keepends=True):
            want.append((at, line.rstrip(b"\n")))
            at += len(line)
        assert got == want


def read_on(spark, folder, out, checkpoint, **options):
    query = tail.tail_telemetry(spark, str(folder), **options).writeStream.format("parquet").option("path", str(out)).option(
        "checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.file, r.line_no, r.epoch_us, r.label, r.n) for r in spark.read.parquet(str(out)).collect())


def test_restarts_read_every_whole_line_once(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.log").write_text("1\tx\t5\n2\ty\t6\nbroken\n3\tx")
    (folder / "_hidden").write_text("9\tx\t9\n")
    got = read_on(spark, folder, tmp_path / "o", tmp_path / "c", range_bytes=4)
    assert got == [("a.log", 0, 1, "x", "5"), ("a.log", 6, 2, "y", "6")]
    with (folder / "a.log").open("a") as log:
        log.write("\t7\n4\té\t8\n")
    (folder / "b.log").write_text("5\tz\t9\n")
    more = read_on(spark, folder, tmp_path / "o", tmp_path / "c")
    assert more == [*got, ("a.log", 19, 3, "x", "7"), ("a.log", 25, 4, "é", "8"), ("b.log", 0, 5, "z", "9")]
    assert read_on(spark, folder, tmp_path / "o", tmp_path / "c") == more
    (folder / "a.log").write_text("1\tx\t5\n")
    with pytest.raises(Exception, match="shorter"):
        read_on(spark, folder, tmp_path / "o", tmp_path / "c")


def test_gaps_over_batches_equal_those_of_a_batch(spark, tmp_path):
    """The lines of every call are spread over files that arrive in turn; a later line of a label wins."""
    second = 1_000_000
    lines = []
    for call in range(12):
        base = call * 10 * second
        for i, (label, at) in enumerate([("start", 0), ("first", 2), ("start", 3), ("end", 9)]):
            if (call + i) % 5:
                lines.append((call, label, base + at * second, call * 10 + i))
    lines.append((99, "start", 10_000 * second, 5000))  # moves the watermark; stays open itself
    path = tmp_path / "in"
    for part in (0, 1, 2):
        mine = [r for n, r in enumerate(lines) if n % 3 == part and r[0] != 99]
        spark.createDataFrame(mine, "k bigint, label string, epoch_us bigint, line_no bigint").coalesce(1).write.mode("append").parquet(str(path))
    spark.createDataFrame(lines[-1:], "k bigint, label string, epoch_us bigint, line_no bigint").coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema("k bigint, label string, epoch_us bigint, line_no bigint").option("maxFilesPerTrigger", 1).parquet(str(path))
    query = stream_call_gaps(stream, SPEC, "k", str(tmp_path / "o"), str(tmp_path / "c"), late="1 hour", idle="10 minutes")
    query.awaitTermination()
    got = {r.call: (r.work, r.wait, r.none) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    table = spark.createDataFrame(lines, "k bigint, label string, epoch_us bigint, line_no bigint").where("k <> 99")
    want = {r.k: (r.work, r.wait, r.none) for r in telemetry_gaps(table, ["k"], SPEC).collect()}
    assert got == want and any(v[0] is None for v in got.values()) and any(v[0] is not None for v in got.values())
