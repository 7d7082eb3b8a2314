import gzip
import hashlib
import io
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from nearframe.llm import warc

LONG = "<p>" + "same words again " * 20 + "</p>"
PAGES = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (3, "http://a/2", LONG), (None, "http://n", LONG),
    (11, "http://s", "short"), (12, "http://s", "short"), (13, "http://e", None), (14, "http://e", ""),
    (15, "http://x\r\nEvil: 1", "é" * 70), (16, "u", "é" * 70), (17, "u", "x" * 100), (18, "u", "x" * 99), (19, "u", "x" * 100),
    (20, "u", "WARC/1.1\r\n\r\n\x1f\x8b big " * 30_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows],
                                 "page_id long, url string, html string, payload string, record_type int")


def test_archive_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.archive_pages(frame(spark, PAGES).repartition(3), path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.archived_pages(spark, path).collect()), key=repr)
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        first = min(i for i, _, h in PAGES if (h or "").encode() == data and i is not None)
        revisit = len(data) >= 100 and page_id != first
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                     first if revisit else None))
    assert got == sorted(want, key=repr)


def test_filters_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.archive_pages(frame(spark, PAGES), path)
    revisits = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert "revisit" not in revisits._jdf.queryExecution().executedPlan().toString()  # left to the reader
    assert revisits.count() == 5 and {r.record_type for r in revisits.collect()} == {"revisit"}
    one = warc.read_warc(spark, path, headers={"X-Page-Id": ["17", "20"]}).collect()
    assert sorted(len(r.payload) for r in one) == [100, len(PAGES[-1][2].encode())]
    bare = warc.read_warc(spark, path, ["response"], payload=False).collect()
    assert bare and all(r.payload is None for r in bare)
    assert warc.read_warc(spark, path).where("target_uri = 'http://s'").count() == 2


def test_empty_table_and_uncommitted_files(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.archive_pages(frame(spark, PAGES).limit(0), path)
    assert warc.archived_pages(spark, path).count() == 0
    warc.archive_pages(frame(spark, PAGES[:2]), path)
    (tmp_path / "none" / "part-left.warc.gz").write_bytes(warc.gzip_member(warc.record("response", {}, b"lost")))
    assert warc.archived_pages(spark, path).count() == 2


def records():
    return [("response", {"WARC-Record-ID": f"<{i}>", "X-N": str(i)}, bytes([i]) * (i * 37)) for i in range(60)]


def test_ranges_meet_every_record_once():
    data = b"".join(warc.gzip_member(warc.record(*r)) for r in records())
    for step in (1, 50, 333, 10**6):
        if step == 1:
            spans = [(i, i + 97) for i in range(0, len(data), 97)]
        else:
            spans = [(i, i + step) for i in range(0, len(data), step)]
        got = [h["X-N"] for a, b in spans for h, _ in warc.read_members(io.BytesIO(data), a, b, warc.Wanted(), False)]
        assert got == [str(i) for i in range(60)]
    assert gzip.decompress(data).count(b"WARC/1.1") == 60


def test_archives_of_other_writers():
    plain = b"".join(warc.record(*r) for r in records())
    members = b"".join(gzip.compress(warc.record(*r)) for r in records())
    for source, gz in ((plain, False), (members, True), (gzip.compress(plain), True)):
        got = list(warc.read_stream(io.BytesIO(source), warc.Wanted({"response"}, {"X-N": {"7", "59"}}), True, gz))
        assert [(h["X-N"], p) for h, p in got] == [("7", bytes([7]) * 259), ("59", bytes([59]) * 2183)]


def members(data):
    return list(warc.read_members(io.BytesIO(data), 0, len(data), warc.Wanted(), True))


def test_broken_members_raise():
    noise = random.Random(1).randbytes(100_000)
    whole = warc.gzip_member(warc.record("response", {"A": "b"}, noise))
    assert members(whole * 2) == [({"WARC-Type": "response", "A": "b", "Content-Length": "100000"}, noise)] * 2
    for cut in (len(whole) - 1, len(whole) // 2, 40):
        with pytest.raises(ValueError):
            members(whole[:cut])
    endless = warc.gzip_member(b"WARC/1.1\r\nA: b\r\n" + noise.replace(b"\r\n\r\n", b""))
    with pytest.raises(ValueError, match="does not end"):
        members(endless)
    with pytest.raises(ValueError, match="does not end"):
        members(endless[:5000])
    short = warc.record("response", {}, b"abc").replace(b"Content-Length: 3", b"Content-Length: 300")
    with pytest.raises(ValueError, match="of 300 bytes"):
        members(warc.gzip_member(short))


def test_a_broken_file_fails_the_query(spark, tmp_path):
    path = tmp_path / "warc"
    warc.archive_pages(frame(spark, PAGES).coalesce(1), f"file://{path}")
    name, = path.glob("*.warc.gz")
    name.write_bytes(name.read_bytes()[:-20])
    with pytest.raises(Exception, match="bytes of its block"):
        warc.read_warc(spark, f"file://{path}").count()


def test_a_new_thread_finds_the_format(spark, tmp_path):
    """Spark looks a registered format up in the session of the calling thread."""
    path, pages = f"file://{tmp_path}/warc", frame(spark, PAGES)

    def run():
        warc.archive_pages(pages, path)
        return warc.archived_pages(spark, path).count()

    assert ThreadPoolExecutor(1).submit(run).result() == len(PAGES)
