import pytest
from pyspark.sql import functions as F

from nearframe.sources import images as I
from nearframe.sources import points as P
from nearframe.sources import reviews as R
from nearframe.sources import run_files as U


def test_review_file_with_quotes_pipes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('"ID"|"spam"|"text"\n"1"|"0"|"plain"\n"2"|"1"|"a ""quoted"" | pipe\nand line"\n')
    assert [tuple(r) for r in R.read_reviews(spark, str(path)).orderBy("id").collect()] == [
        (1, 0, "plain"), (2, 1, 'a "quoted" | pipe\nand line')]
    assert R.reviews_or_synthetic(spark, str(path)).count() == 2


def test_generated_reviews_stand_in_for_a_missing_file(spark, tmp_path):
    out = R.reviews_or_synthetic(spark, str(tmp_path / "none.csv"), 500)
    rows = out.collect()
    assert len(rows) == 500 and {r["spam"] for r in rows} == {0} and len({r["text"] for r in rows}) > 100
    assert not any("{" in r["text"] for r in rows)
    assert rows == R.synthetic_reviews(spark.range(500).repartition(3)).orderBy("id").collect()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("faces")
    for person, n in (("anna", 80), ("bert", 79), ("cleo", 85)):
        (root / person).mkdir()
        for i in range(n):
            ending = "png" if i % 2 else "jpg"
            (root / person / f"{i:03d}.{ending}").write_bytes(f"{person}{i}".encode())
    return root


def test_only_full_folders_are_scanned_png_first(spark, folder):
    out = I.scan_images(spark, str(folder), 2, 3, offset=1).orderBy("dir_no", "n").collect()
    assert [(r["dir_no"], r["label"], r["path"].split("/")[-1]) for r in out] == [
        (0, "anna", "003.png"), (0, "anna", "005.png"), (0, "anna", "007.png"),
        (1, "cleo", "003.png"), (1, "cleo", "005.png"), (1, "cleo", "007.png")]
    first = I.scan_images(spark, str(folder), 1, 1, order=I.JPG_FIRST, count_all=False).first()
    assert first["path"].endswith("anna/000.jpg")


def test_folders_are_used_again_and_offset_may_pass_the_end(spark, folder):
    out = I.scan_images(spark, str(folder), 5, 100, offset=78)
    assert {r["dir_no"]: (r["label"], r["n"]) for r in out.groupBy("dir_no", "label").agg(F.count("path").alias("n")).collect()} == {
        0: ("anna", 2), 1: ("cleo", 7), 2: ("anna", 2), 3: ("cleo", 7), 4: ("anna", 2)}
    assert I.scan_images(spark, str(folder), 2, 5, offset=500).count() == 0
    with pytest.raises(ValueError):
        I.scan_images(spark, str(folder), 2, 5, min_files=999)


def test_blobs_and_corpus(spark, folder):
    picked = I.scan_images(spark, str(folder), 1, 2)
    blobs = I.attach_blobs(picked, "path", str(folder)).collect()
    assert sorted(bytes(r["content"]).decode() for r in blobs) == ["anna1", "anna3"]
    out = I.image_corpus(spark, str(folder), 300).orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(300)) and len({r["path"] for r in out}) == 244
    assert out[0]["path"] == out[244]["path"]
    assert I.image_corpus(spark, str(folder), 10, shuffle=False).orderBy("pos").first()["path"].endswith("anna/000.jpg")


def stored(spark, path):
    return {r["id"]: r["x"] for r in P.read_points(spark, path, "id").collect()}


def test_upsert_replaces_inserts_and_repeats_safely(spark, tmp_path):
    path = str(tmp_path / "c")
    schema = "id int, x string"
    with pytest.raises(FileNotFoundError):
        P.read_points(spark, path, "id")
    P.create_points(path, spark.createDataFrame([(1, "a"), (2, "b")], schema))
    new = spark.createDataFrame([(2, "B", 1), (3, "old", 1), (3, "new", 2)], schema + ", n int")
    for _ in range(2):
        P.upsert_points(spark, path, new, "id", "n")
        assert stored(spark, path) == {1: "a", 2: "B", 3: "new"}
    P.upsert_points(spark, path, spark.createDataFrame([(1, "A")], schema), "id")
    P.compact_points(spark, path, "id")
    assert stored(spark, path) == {1: "A", 2: "B", 3: "new"}
    P.create_points(path, spark.createDataFrame([(9, "z")], schema))
    assert stored(spark, path) == {9: "z"}


def test_upsert_into_an_empty_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    P.upsert_points(spark, path, spark.createDataFrame([(1, "a")], "id int, x string"), "id")
    P.upsert_points(spark, path, spark.createDataFrame([(1, "b")], "id int, x string"), "id")
    assert stored(spark, path) == {1: "b"}


def test_documents_are_appended(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0], "t", True)], "id int, v array<float>, t string, spam boolean")
    for _ in range(2):
        P.add_points(str(tmp_path / "d"), P.as_documents(df, "id", "v", "t", ["spam"]))
    out = spark.read.parquet(str(tmp_path / "d")).collect()
    assert len(out) == 2 and out[0]["id"] == "1" and out[0]["metadata"] == {"spam": "true"}


def test_many_upserts_are_one_scan(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "id int, x string"
    P.create_points(path, spark.createDataFrame([(1, "a"), (2, "b")], schema))

    def scans():
        plan = P.read_points(spark, path, "id")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [")

    seen = set()
    for i in range(12):
        P.upsert_points(spark, path, spark.createDataFrame([(i % 3, f"v{i}")], schema), "id")
        seen.add(scans())
    assert len(seen) == 1
    assert {r["id"]: r["x"] for r in P.read_points(spark, path, "id").collect()} == {0: "v9", 1: "v10", 2: "v11"}


def test_run_files_are_joined(spark, tmp_path):
    (tmp_path / "correct_output").mkdir()
    (tmp_path / "benchmark_1_run1.csv").write_text("size,a_time_s,b_time_s\n32,1.0,2.0\n")
    (tmp_path / "benchmark_1_run2.csv").write_text("size,a_time_s,b_time_s\n32,3.0,\n64,5.0,6.0\n")
    (tmp_path / "benchmark_1.csv").write_text("size,a_time_s\n1,1.0\n")
    (tmp_path / "correct_output" / "benchmark_9_run1.csv").write_text("size,a_time_s\n7,7.0\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    out = U.read_runs(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == [(32, 1.0, 2.0), (32, 3.0, None), (64, 5.0, 6.0)]
    assert [tuple(r) for r in U.read_runs(spark, str(tmp_path), runs=False).collect()] == [(1, 1.0)]
    with pytest.raises(FileNotFoundError):
        U.read_runs(spark, str(tmp_path / "correct_output"))


def test_run_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "benchmark_1_run1.csv").write_text("size,a_time_s,b_time_s\n32,1.0,2.0\n")
    (tmp_path / "benchmark_1_run2.csv").write_text("size,b_time_s,a_time_s\n64,4.0,3.0\n")
    (tmp_path / "benchmark_1_run3.csv").write_text("size,b_time_s,c_time_s\n128,5.0,6.0\n")
    out = U.read_runs(spark, str(tmp_path))
    assert out.columns == ["size", "a_time_s", "b_time_s", "c_time_s"]
    assert sorted(map(tuple, out.collect())) == [(32, 1.0, 2.0, None), (64, 3.0, 4.0, None), (128, None, 5.0, 6.0)]


def test_wide_file_has_columns_for_reported_metrics_only(spark, tmp_path):
    long = spark.createDataFrame([(1, "a", "time_s", 2.0), (1, "b", "time_s", 3.0), (2, "a", "qd_cpu", 4.0)],
                                 "size int, method string, metric string, value double")
    U.write_metrics_wide(long, str(tmp_path / "w"), ["a", "b"])
    out = spark.read.csv(str(tmp_path / "w"), header=True)
    assert out.columns == ["size", "a_time_s", "a_qd_cpu", "b_time_s", "b_qd_cpu"]
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "2.0", None, "3.0", None), ("2", None, "4.0", None, None)]


def test_telemetry_drops_broken_lines_and_keeps_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("10\tstart\t1\n20\tend\t1\nx\tstart\t1\n30\tstart\t1\n40\tend\n\n")
    (tmp_path / "b.log").write_text("5\tend\t2\n")
    log = U.read_telemetry(spark, str(tmp_path))
    assert log.count() == 4
    last = {r["label"]: r["e"] for r in log.groupBy("label").agg(F.max_by("epoch_us", "line_no").alias("e")).collect()}
    assert last == {"start": 30, "end": 5}
