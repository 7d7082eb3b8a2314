"""Statistics over runs and telemetry, with events as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import scratch_path
from ..operators import runs as M
from ..sources import run_files
from . import sql as S
from . import views
from .registry import query

METHODS = ["click", "error", "purchase", "signup", "view"]
NUMBERS = {m: i for i, m in enumerate(METHODS)}

RUNS = "run AS (SELECT user_id % 4 AS size, event_type AS method, value AS time_s FROM events)"
LONG = """
    long AS (SELECT user_id % 4 AS size, event_type AS method, 'time_s' AS metric, value AS value FROM events
             UNION ALL SELECT user_id % 4, event_type, 'sys_mem', CAST(length(props) + event_id % 97 AS DOUBLE) FROM events)"""
STATS = """
    stat AS (SELECT size, method, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, stddev_pop(value) AS pop,
                    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
             FROM long GROUP BY 1, 2, 3)"""
AGG = "agg AS (SELECT size, method, mean, pop AS std FROM stat WHERE metric = 'time_s')"


def long_runs(t):
    metrics = F.array(
        F.struct(F.lit("time_s").alias("metric"), F.col("value").alias("value")),
        F.struct(F.lit("sys_mem").alias("metric"), (F.length("props") + F.col("event_id") % 97).cast("double").alias("value")))
    return t.events.select((F.col("user_id") % 4).alias("size"), F.col("event_type").alias("method"), F.inline(metrics))


def means(t):
    """Mean and population deviation of the times per size and method."""
    return (M.aggregate_by_size(long_runs(t).where("metric = 'time_s'"))
            .select("size", "method", "mean", "std"))


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("throughput", """
    SELECT event_id, round(CASE WHEN value > 100 THEN (1 + user_id % 4) / (value - 100) ELSE 0 END, 6) AS throughput FROM events""")
def _(t):
    # Short runs count as no time at all.
    time_s = F.greatest(F.col("value") - 100, F.lit(0.0))
    rate = M.throughput(1 + F.col("user_id") % 4, time_s)
    return t.events.select("event_id", F.round(rate, 6).alias("throughput"))


@query("sample_stddev", """
    SELECT user_id, event_type, round(COALESCE(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1, 2""")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.round(M.sample_stddev("value"), 6).alias("std"))


@query("iqr_quartiles", """
    WITH q AS (SELECT o_custkey, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS median,
               quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
    SELECT o_custkey, n, round(median, 4) AS median, round(CASE WHEN n < 4 THEN median ELSE a END, 4) AS q1,
           round(CASE WHEN n < 4 THEN median ELSE b END, 4) AS q3, round(CASE WHEN n < 4 THEN 0 ELSE b - a END, 4) AS iqr FROM q""")
def _(t):
    return rounded(M.quartiles(t.orders, ["o_custkey"], "o_totalprice"), "median", "q1", "q3", "iqr", digits=4)


@query("run_summary", S.with_(LONG, STATS) + """
    SELECT size, method, metric, n, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median,
           round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr FROM stat""")
def _(t):
    return rounded(M.summarize_runs(long_runs(t)), "mean", "std", "median", "q1", "q3", "iqr")


@query("throughput_summary", S.with_(LONG, STATS) + """
    SELECT size, method, n, round(size / mean, 6) AS throughput, round(size / mean * std / mean, 6) AS throughput_std,
           round(size / median, 6) AS throughput_median, round(size / median * (q3 - q1) / median, 6) AS throughput_iqr,
           round(size / q3, 6) AS throughput_q1, round(size / q1, 6) AS throughput_q3 FROM stat WHERE metric = 'time_s'""")
def _(t):
    names = ["throughput" + s for s in ("", "_std", "_median", "_iqr", "_q1", "_q3")]
    return rounded(M.summarize_throughput(views.runs(t)), *names)


def user_runs(t):
    """Users as sizes: a time and a memory figure per event."""
    return t.events.select(
        F.col("user_id").alias("size"), F.col("event_type").alias("method"), F.inline(F.array(
            F.struct(F.lit("time_s").alias("metric"), F.col("value").alias("value")),
            F.struct(F.lit("sys_mem").alias("metric"), F.length("props").cast("double").alias("value")))))


def wide_runs(t):
    """One wide row per user: the longest time and the largest memory figure of every method."""
    return run_files.metrics_wide(user_runs(t), METHODS, ["time_s", "sys_mem"])


LONGEST = """
    longest AS (SELECT user_id AS size, event_type AS method, 'time_s' AS metric, max(value) AS value FROM events GROUP BY 1, 2
                UNION ALL SELECT user_id, event_type, 'sys_mem', CAST(max(length(props)) AS DOUBLE) FROM events GROUP BY 1, 2)"""


@query("unpivot_metrics", S.with_(LONGEST) + f"""
    SELECT size, method, CAST(list_position({METHODS}, method) - 1 AS INTEGER) AS method_no, metric, value FROM longest""")
def _(t):
    return M.unpivot_metrics(wide_runs(t))


def _wide_sql(source, parts):
    cells = [f"max(CASE WHEN method = '{m}' AND metric = '{x}' THEN round({c}, 6) END) AS {m}_{x}{s}"
             for m in METHODS for x in ("time_s", "sys_mem") for s, c in parts]
    return f"SELECT CAST(size AS INTEGER) AS size, {', '.join(cells)} FROM {source} GROUP BY size"


@query("write_metrics_wide", S.with_(LONG, STATS) + _wide_sql(
    "stat", [("", "mean"), ("_std", "std"), ("_median", "median"), ("_q1", "q1"), ("_q3", "q3")]))
def _(t):
    path = scratch_path(t.spark, "wide")
    run_files.write_metrics_wide(M.summarize_runs(long_runs(t)), path, METHODS, with_stats=True)
    names = [f"{m}_{x}{s}" for m in METHODS for x in ("time_s", "sys_mem") for s in ("", "_std", "_median", "_q1", "_q3")]
    schema = "size int, " + ", ".join(f"`{n}` double" for n in names)
    return rounded(t.spark.read.csv(path, header=True, schema=schema, enforceSchema=False), *names)


@query("concat_runs", S.with_(LONGEST) + _wide_sql("longest", [("", "value")]))
def _(t):
    # One run file per group of users, read back as one table.
    path = scratch_path(t.spark, "runs")
    for n in range(4):
        part = user_runs(t).where(F.col("size") % 4 == n)
        run_files.write_metrics_wide(part, f"{path}/benchmark_{n}_run.csv", METHODS, ["time_s", "sys_mem"])
    return run_files.read_runs(t.spark, path)


@query("aggregate_by_size", S.with_(LONG, STATS) + """
    SELECT size, method, metric, n, round(mean, 6) AS mean, round(pop, 6) AS std, round(median, 6) AS median,
           round(q1, 6) AS q1, round(q3, 6) AS q3 FROM stat""")
def _(t):
    return rounded(M.aggregate_by_size(long_runs(t)), "mean", "std", "median", "q1", "q3")


@query("format_mean_std", S.with_(LONG, STATS, AGG) + "SELECT size, " + ", ".join(
    f"COALESCE(max(CASE WHEN method = '{m}' AND NOT (method = 'view' AND size = 3) THEN printf('%.1f (%.1f)', mean, std) END), '-') AS {m}"
    for m in METHODS) + " FROM agg GROUP BY size")
def _(t):
    return M.format_table(means(t).where("not (method = 'view' and size = 3)"), METHODS)


def numbered(df):
    return df.withColumn("method_no", F.array_position(F.lit(METHODS), F.col("method")))


@query("best_per_size", S.with_(LONG, STATS, AGG) + f"""
    SELECT size, method, best FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY best DESC, list_position({METHODS}, method)) AS rn
    FROM (SELECT size, method, round(mean, 1) AS best FROM agg)) WHERE rn = 1""")
def _(t):
    return M.best_per_size(numbered(means(t)))


BASE = "base AS (SELECT size, mean AS baseline FROM agg WHERE method = 'error')"


@query("speedup_vs_baseline", S.with_(LONG, STATS, AGG, BASE) + """
    SELECT size, method, round(speedup, 6) AS speedup, speedup = max(speedup) OVER (PARTITION BY size) AND speedup > 1.01 AS flag
    FROM (SELECT agg.size, method, mean / baseline AS speedup FROM agg JOIN base ON agg.size = base.size WHERE method <> 'error')""")
def _(t):
    baseline = M.pick_baseline(METHODS, ["missing", "error", "click"])
    return rounded(M.speedup(means(t), baseline), "speedup")


@query("normalized_throughput", S.with_(LONG, STATS, AGG, BASE) + """
    SELECT agg.size, method, round(mean / baseline, 6) AS ratio, round(std / baseline, 6) AS ratio_std
    FROM agg JOIN base ON agg.size = base.size""")
def _(t):
    return rounded(M.normalized_throughput(means(t), "error"), "ratio", "ratio_std")


@query("split_method_name", """
    WITH m AS (SELECT event_id, event_type || '_' || CASE WHEN user_id % 3 = 0 THEN 'model_a' ELSE 'b' END ||
                      CASE WHEN user_id % 2 = 0 THEN '_f0.' || (event_id % 90 + 10) ELSE '' END AS method FROM events),
    s AS (SELECT event_id, method, CASE WHEN regexp_matches(method, '_f[0-9.]+$') THEN regexp_replace(method, '_f[0-9.]+$', '') ELSE method END AS base,
                 TRY_CAST(NULLIF(regexp_extract(method, '_f([0-9.]+)$', 1), '') AS DOUBLE) AS fraction FROM m)
    SELECT event_id, method, base, fraction, string_split(base, '_')[1] AS prefix, substr(base, length(string_split(base, '_')[1]) + 2) AS rest,
           CASE base WHEN 'click_b' THEN 'Click (B)' WHEN 'view_model_a' THEN 'View (A)' ELSE base END AS label FROM s""")
def _(t):
    name = F.concat("event_type", F.lit("_"), F.when(F.col("user_id") % 3 == 0, "model_a").otherwise("b"),
                    F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("_f0."), F.col("event_id") % 90 + 10)).otherwise(""))
    labels = t.spark.createDataFrame([("click_b", "Click (B)"), ("view_model_a", "View (A)")], "base string, label string")
    return M.split_method(t.events.select("event_id", name.alias("method")), METHODS, labels)


STAMPED = "stamped AS (SELECT user_id, event_type AS label, epoch_us(ts) AS epoch_us, event_id AS line_no FROM events)"
LAST = """
    last AS (SELECT user_id, label, arg_max(epoch_us, line_no) AS epoch_us FROM stamped GROUP BY 1, 2)"""


def stamped(t):
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("user_id", F.col("event_type").alias("label"), stamp.alias("epoch_us"), F.col("event_id").alias("line_no"))


@query("read_telemetry", S.with_(STAMPED) + """
    SELECT label, arg_max(epoch_us, line_no) AS epoch_us, arg_max(user_id, line_no) AS n FROM stamped WHERE line_no % 7 <> 0 GROUP BY label""")
def _(t):
    # Every seventh line is broken and has to be dropped.
    stamp = F.when(F.col("line_no") % 7 == 0, F.lit("x")).otherwise(F.col("epoch_us").cast("string"))
    path = scratch_path(t.spark, "log")
    # Ranges of lines, so that the order of the file names is the order of the lines.
    (stamped(t).repartitionByRange("line_no").sortWithinPartitions("line_no")
     .select(F.concat_ws("\t", stamp, "label", F.col("user_id").cast("string"))).write.text(path))
    log = run_files.read_telemetry(t.spark, path)
    return log.groupBy("label").agg(F.max_by("epoch_us", "line_no").alias("epoch_us"),
                                    F.max_by("n", "line_no").cast("bigint").alias("n"))


SPEC = {"to_purchase_us": ("signup", "purchase"), "to_error_us": ("view", "error"), "to_none_us": ("view", "absent")}


@query("telemetry_gaps", S.with_(STAMPED, LAST, """
    wide AS (SELECT user_id, max(CASE WHEN label = 'signup' THEN epoch_us END) AS s, max(CASE WHEN label = 'purchase' THEN epoch_us END) AS p,
                    max(CASE WHEN label = 'view' THEN epoch_us END) AS v, max(CASE WHEN label = 'error' THEN epoch_us END) AS e FROM last GROUP BY 1)""") +
       "SELECT user_id, p - s AS to_purchase_us, e - v AS to_error_us, CAST(NULL AS BIGINT) AS to_none_us FROM wide")
def telemetry_gaps(t):
    return M.telemetry_gaps(stamped(t), ["user_id"], SPEC)


@query("overhead_summary", S.with_(STAMPED, LAST, """
    wide AS (SELECT user_id % 2 AS size, max(CASE WHEN label = 'purchase' THEN epoch_us END) - min(epoch_us) AS wall,
                    max(CASE WHEN label = 'purchase' THEN epoch_us END) - max(CASE WHEN label = 'signup' THEN epoch_us END) AS core
             FROM last GROUP BY user_id)""", """
    s AS (SELECT size, avg(wall) AS wm, stddev_pop(wall) AS ws, avg(core) AS cm, stddev_pop(core) AS cs FROM wide GROUP BY 1)""") + """
    SELECT size, round(cm / 1e6, 3) AS core_mean, round(cs / 1e6, 3) AS core_std, round(wm / 1e6, 3) AS wall_mean, round(ws / 1e6, 3) AS wall_std,
           round(100 * (wm - cm) / wm, 6) AS overhead_pct, round(100 * cs / wm, 6) AS overhead_std_pct FROM s""")
def _(t):
    last = M.latest_per_label(stamped(t), ["user_id"], "label", "epoch_us", "line_no")
    at = {n: F.max(F.when(F.col("label") == n, F.col("epoch_us"))) for n in ("purchase", "signup")}
    calls = last.groupBy("user_id").agg((at["purchase"] - F.min("epoch_us")).alias("wall"),
                                        (at["purchase"] - at["signup"]).alias("core"))
    out = M.overhead_summary(calls.withColumn("size", F.col("user_id") % 2), ["core"], "wall", "core")
    seconds = {c: F.round(F.col(c) / 1e6, 3) for c in ("core_mean", "core_std", "wall_mean", "wall_std")}
    return rounded(out.withColumns(seconds), "overhead_pct", "overhead_std_pct")


@query("counter_cpu_percent", """
    WITH c AS (SELECT user_id, event_id, value - lag(value) OVER w AS used, event_id - lag(event_id) OVER w AS passed
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, round(CASE WHEN used > 0 AND passed > 0 THEN used / passed * 4 * 100.0 ELSE 0 END, 6) AS cpu_percent FROM c""")
def _(t):
    counters = t.events.select("user_id", "event_id", F.col("value").alias("cpu"),
                               F.col("event_id").alias("system"), F.lit(4).alias("cpus"))
    out = M.cpu_percent(counters, "user_id", "event_id")
    return out.select("user_id", "event_id", F.round("cpu_percent", 6).alias("cpu_percent"))


@query("memory_delta", """
    SELECT user_id, round(arg_min(value, event_id) * 1e6 / 1048576, 6) AS baseline_mib, round(arg_max(value, event_id) * 1e6 / 1048576, 6) AS peak_mib,
           round(arg_max(value, event_id) * 1e6 / 1048576 - arg_min(value, event_id) * 1e6 / 1048576, 6) AS delta_mib FROM events GROUP BY 1""")
def _(t):
    readings = t.events.select("user_id", "event_id", (F.col("value") * 1e6).alias("bytes"))
    return rounded(M.memory_delta(readings, "user_id", "event_id"), "baseline_mib", "peak_mib", "delta_mib")


@query("average_and_ratio", """
    WITH m AS (SELECT event_type AS method, avg(1 / (1 + value)) AS mean FROM events GROUP BY 1)
    SELECT a.method AS numerator, b.method AS denominator, round(a.mean, 6) AS numerator_mean, round(b.mean, 6) AS denominator_mean,
           round(a.mean / b.mean, 6) AS ratio FROM m a, m b
    WHERE (a.method, b.method) IN (('click', 'view'), ('error', 'view'), ('signup', 'purchase'))""")
def _(t):
    rates = t.events.select(F.col("event_type").alias("method"), (1 / (1 + F.col("value"))).alias("throughput"))
    out = M.average_and_ratio(rates, [("click", "view"), ("error", "view"), ("signup", "purchase")])
    return rounded(out, "numerator_mean", "denominator_mean", "ratio")


@query("cap_by_size", S.with_(LONG, STATS, AGG) + """
    SELECT size, method, CASE WHEN method = 'error' AND size > 1 THEN '-' ELSE printf('%.1f', mean) END AS shown FROM agg""")
def _(t):
    found = means(t)
    grid = found.select("size").distinct().withColumn("method", F.explode(F.lit(METHODS)))
    out = M.apply_size_cap(grid, found, {"error": 1})
    return out.select("size", "method", F.coalesce(M.one_decimal(F.col("mean")), F.lit("-")).alias("shown"))
