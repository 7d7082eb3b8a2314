import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearframe.operators import runs as M
from nearframe.operators.ranking import cumulative, quantiles


def long(spark, rows):
    return spark.createDataFrame(rows, "size int, method string, metric string, value double")


@pytest.mark.parametrize("values", [[], [7.0], [1.0, 2.0, 9.0], [1.0, 2.0, 4.0, 10.0], [5.0] * 6 + [1.0]])
def test_quartile_rule_changes_at_four_values(spark, values):
    df = long(spark, [(1, "m", "t", v) for v in values] + [(1, "m", "t", None)])
    out = M.summarize_runs(df).first()
    if len(values) >= 4:
        q1, _, q3 = statistics.quantiles(values, n=4, method="inclusive")
    else:
        q1 = q3 = statistics.median(values) if values else 0.0
    assert out["n"] == len(values)
    assert (out["q1"], out["q3"], out["iqr"]) == pytest.approx((q1, q3, q3 - q1))
    assert out["median"] == (statistics.median(values) if values else 0.0)
    assert out["std"] == pytest.approx(statistics.stdev(values) if len(values) > 1 else 0.0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 40)), min_size=1, max_size=200))
def test_counted_quantiles_equal_buffered_ones(spark, pairs):
    df = spark.createDataFrame([(k, float(v)) for k, v in pairs], "k int, v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    a = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", probs).alias("q")).collect()}
    b = {r["k"]: r["q"] for r in quantiles(df, ["k"], "v", probs, "q").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_quantiles_of_keys_beyond_a_sketch(spark):
    """Keys with far more values than a sketch keeps, ties, infinities and values that are no numbers."""
    df = spark.range(60_000).selectExpr(
        "id % 3 k", "CASE id % 3 WHEN 0 THEN CAST(xxhash64(id) AS DOUBLE) WHEN 1 THEN CAST(id % 7 AS DOUBLE) "
        "ELSE CASE WHEN id % 90 = 2 THEN double('NaN') WHEN id % 90 = 5 THEN NULL ELSE sqrt(id) END END v")
    probs = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r["k"]: r["q"] for r in quantiles(df, ["k"], "v", probs, "q").collect()}
    plain = df.withColumn("v", F.expr("CASE WHEN isnan(v) THEN double('inf') ELSE v END"))
    for k in (0, 1, 2):
        values = sorted(r["v"] for r in plain.where(F.col("k") == k).where("v IS NOT NULL").collect())
        for p, q in zip(probs, got[k]):
            at = p * (len(values) - 1)
            low, high = values[int(at)], values[min(len(values) - 1, int(at) + (at % 1 > 0))]
            assert q == (low if low == high else pytest.approx(low + at % 1 * (high - low), rel=1e-12))


def test_null_is_a_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0), (2, None)], "k int, v double")
    assert {r.k: r.q for r in quantiles(df, ["k"], "v", (0.5,), "q").collect()} == {None: [2.0], 1: [5.0], 2: None}


def test_a_sketch_that_misses_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("nearframe.operators.ranking.SKETCH_ERROR", -0.1)
    df = spark.range(5000).selectExpr("1 k", "CAST(id AS DOUBLE) v")
    with pytest.raises(Exception, match="outside the bounds"):
        quantiles(df, ["k"], "v", (0.5,)).collect()


def test_throughput_of_no_time_is_zero(spark):
    df = spark.createDataFrame([(10, 2.0), (10, 0.0)], "size int, t double")
    assert [r[0] for r in df.select(M.throughput(F.col("size"), F.col("t"))).collect()] == [5.0, 0.0]


def test_throughput_quartiles_change_places(spark):
    times = spark.createDataFrame([(100, "m", t) for t in (1.0, 2.0, 4.0, 5.0)], "size int, method string, time_s double")
    out = M.summarize_throughput(times).first()
    q1, _, q3 = statistics.quantiles([1.0, 2.0, 4.0, 5.0], n=4, method="inclusive")
    assert (out["throughput_q1"], out["throughput_q3"]) == pytest.approx((100 / q3, 100 / q1))
    assert out["throughput_std"] == pytest.approx(100 / 3 * statistics.stdev([1, 2, 4, 5]) / 3)
    assert out["throughput_iqr"] == pytest.approx(100 / 3 * (q3 - q1) / 3)


def test_methods_with_a_common_start_are_kept_apart(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)],
                                 "size int, pg_time_s double, pg_py_cpu double, pg_direct_time_s double, pg_direct_py_cpu double")
    out = M.unpivot_metrics(wide).collect()
    assert sorted((r["method"], r["method_no"], r["metric"], r["value"]) for r in out) == [
        ("pg", 0, "py_cpu", 2.0), ("pg", 0, "time_s", 1.0),
        ("pg_direct", 1, "py_cpu", 4.0), ("pg_direct", 1, "time_s", 3.0)]


@pytest.fixture(scope="module")
def agg(spark):
    rows = [(32, "a", 10.0), (32, "a", 14.0), (32, "b", 12.01), (32, "b", 12.03), (64, "b", 5.0), (64, "c", 20.0)]
    df = long(spark, [(s, m, "throughput", v) for s, m, v in rows])
    order = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(1), F.lit("c"), F.lit(2))
    return M.aggregate_by_size(df).withColumn("method_no", order[F.col("method")])


def test_table_cells_and_missing_methods(agg):
    out = {r["size"]: r.asDict() for r in M.format_table(agg, ["a", "b", "c"]).collect()}
    assert out[32] == {"size": 32, "a": "12.0 (2.0)", "b": "12.0 (0.0)", "c": "-"}
    assert out[64] == {"size": 64, "a": "-", "b": "5.0 (0.0)", "c": "20.0 (0.0)"}


def test_first_method_wins_a_tie_of_shown_values(agg):
    assert {r["size"]: r["method"] for r in M.best_per_size(agg).collect()} == {32: "a", 64: "c"}
    assert {r["size"]: r["method"] for r in M.best_per_size(agg, highest=False).collect()} == {32: "a", 64: "b"}


def test_speedup_and_normalised(agg):
    out = {(r["size"], r["method"]): (r["speedup"], r["flag"]) for r in M.speedup(agg, "b").collect()}
    assert out[(64, "c")] == (4.0, True)
    assert out[(32, "a")][0] == pytest.approx(12 / 12.02) and out[(32, "a")][1] is False
    out = {(r["size"], r["method"]): r["speedup"] for r in M.speedup(agg, "a").collect()}
    assert out[(64, "b")] is None
    out = {(r["size"], r["method"]): r["ratio_std"] for r in M.normalized_throughput(agg, "b").collect()}
    assert out[(32, "a")] == pytest.approx(2 / 12.02)


def test_baseline_choice():
    assert M.pick_baseline(["x", "b", "a"], ["a", "b"]) == "a"
    assert M.pick_baseline(["x", "ort_1", "ort_2"], ["a"], "ort_") == "ort_1"
    assert M.pick_baseline(["x"], ["a"]) is None


def test_method_names(spark):
    df = spark.createDataFrame([("plain",), ("pg_big_f0.05",), ("pg_direct_x",), ("odd_f",)], "method string")
    labels = spark.createDataFrame([("pg_big", "Big")], "base string, label string")
    out = {r["method"]: (r["base"], r["fraction"], r["prefix"], r["rest"], r["label"])
           for r in M.split_method(df, ["pg", "pg_direct"], labels).collect()}
    assert out == {"plain": ("plain", None, None, None, "plain"), "pg_big_f0.05": ("pg_big", 0.05, "pg", "big", "Big"),
                   "pg_direct_x": ("pg_direct_x", None, "pg_direct", "x", "pg_direct_x"),
                   "odd_f": ("odd_f", None, None, None, "odd_f")}


def test_gaps_use_last_lines_and_miss_as_null(spark):
    df = spark.createDataFrame([(1, 0, 10, "a"), (1, 1, 15, "a"), (1, 2, 40, "b"), (2, 3, 5, "a"), (3, 4, 5, "z")],
                               "call int, line_no int, epoch_us bigint, label string")
    out = {r["call"]: r["ab"] for r in M.telemetry_gaps(df, ["call"], {"ab": ("a", "b")}).collect()}
    assert out == {1: 25, 2: None, 3: None}


def test_overhead_share(spark):
    df = spark.createDataFrame([(1, 100.0, 80.0), (1, 200.0, 160.0), (2, 0.0, None)], "size int, wall double, core double")
    out = {r["size"]: r for r in M.overhead_summary(df, ["core"], "wall", "core").collect()}
    assert (out[1]["overhead_pct"], out[1]["overhead_std_pct"]) == pytest.approx((20.0, 100 * 40 / 150))
    assert out[2]["overhead_pct"] is None and out[2]["core_mean"] == 0.0


def test_counters_and_memory(spark):
    df = spark.createDataFrame([("c", 1, 10, 100, 2), ("c", 2, 15, 110, 2), ("c", 3, 12, 120, 2), ("d", 1, 50, 500, 4)],
                               "k string, at int, cpu int, system int, cpus int")
    out = {(r["k"], r["at"]): r["cpu_percent"] for r in M.cpu_percent(df, "k", "at").collect()}
    assert out == {("c", 1): 0.0, ("c", 2): 100.0, ("c", 3): 0.0, ("d", 1): 0.0}
    mem = spark.createDataFrame([("r", 1, 1048576), ("r", 2, 5242880), ("r", 3, 3145728)], "run string, at int, bytes bigint")
    out = M.memory_delta(mem, "run", "at").first()
    assert (out["baseline_mib"], out["peak_mib"], out["delta_mib"]) == (1.0, 3.0, 2.0)


def test_ratios_and_caps(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 30.0), ("b", 1, 5.0)], "method string, size int, throughput double")
    out = M.average_and_ratio(df, [("a", "b"), ("a", "c")]).collect()
    assert [(r["numerator_mean"], r["ratio"]) for r in out] == [(20.0, 4.0), (20.0, None)]
    capped = M.apply_size_cap(df.select("size", "method"), df, {"a": 1}).collect()
    assert {(r["method"], r["size"]): r["throughput"] for r in capped} == {("a", 1): 10.0, ("a", 2): None, ("b", 1): 5.0}


# Published throughputs of ten runs at size 1024, to two decimals,
# and the published table cells and speed-ups made from them.
PUBLISHED = {
    "gpu_base": [289.80, 297.70, 299.68, 291.83, 293.19, 292.65, 297.31, 293.60, 297.70, 292.87],
    "cpu_base": [53.42, 52.33, 53.67, 52.79, 53.55, 53.51, 53.44, 52.73, 54.03, 52.11],
    "gpu_large": [87.69, 88.85, 88.55, 88.44, 88.33, 88.53, 88.53, 88.18, 88.75, 88.01],
    "cpu_large": [7.11, 7.20, 7.19, 7.19, 7.18, 7.20, 7.21, 7.16, 7.17, 7.15],
}


def test_published_table_is_reproduced(spark):
    df = long(spark, [(1024, m, "throughput", v) for m, values in PUBLISHED.items() for v in values])
    agg = M.aggregate_by_size(df).cache()
    row = M.format_table(agg, list(PUBLISHED)).first().asDict()
    assert row == {"size": 1024, "gpu_base": "294.6 (3.0)", "cpu_base": "53.2 (0.6)",
                   "gpu_large": "88.4 (0.3)", "cpu_large": "7.2 (0.0)"}
    fast = {r["method"]: (round(r["speedup"], 1), r["flag"]) for r in M.speedup(agg, "cpu_base").collect()}
    assert fast == {"gpu_base": (5.5, True), "gpu_large": (1.7, False), "cpu_large": (0.1, False)}


def test_running_sums_in_bands_equal_plain_ones(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("k"),
                                  (F.col("id") * 7919 % 3001).alias("v"), (F.col("id") % 4).alias("w"))
    whole = Window.partitionBy("k")
    a = df.withColumn("s", F.sum("w").over(whole.orderBy("v"))).withColumn("t", F.sum("w").over(whole)).collect()
    b = cumulative(df, ["k"], "v", "w", "s", "t").collect()
    assert {(r["k"], r["v"]): (r["s"], r["t"]) for r in a} == {(r["k"], r["v"]): (r["s"], r["t"]) for r in b} and len(a) == len(b) == 3000
