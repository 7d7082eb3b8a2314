"""Statistics that compare runs: long rows ``(size, method, metric, value)`` in, tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import with_position
from .ranking import quantiles

# The metric suffixes of a wide run file.
METRICS = ("throughput", "time_s", "py_cpu", "py_mem_delta", "py_mem_peak", "pg_cpu", "pg_mem_delta",
           "pg_mem_peak", "qd_cpu", "qd_mem_delta", "qd_mem_peak", "sys_cpu", "sys_mem")
STATISTICS = ("std", "median", "q1", "q3")
GROUP = ["size", "method", "metric"]


def throughput(size: Column, time_s: Column) -> Column:
    """Rows per second; 0 when no time passed."""
    return F.when(time_s > 0, size / time_s).otherwise(F.lit(0.0))


def sample_stddev(value: str) -> Column:
    """Sample standard deviation as an aggregate; 0 for fewer than two values."""
    return F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0))


def quartiles(df: DataFrame, keys: list[str], value: str = "value", others: Sequence[Column] = ()) -> DataFrame:
    """``(n, median, q1, q3, iqr)`` per key with inclusive quartiles, after the ``others`` aggregates.

    With fewer than four values both quartiles are the median and the range is 0;
    without any, all are 0.
    """
    cuts = quantiles(df, keys, value, (0.25, 0.5, 0.75), "_q", [F.count(value).alias("n"), *others])
    kept = [c for c in cuts.columns if c not in (*keys, "n", "_q")]
    few = F.col("n") < 4
    mid = F.coalesce(F.col("_q")[1], F.lit(0.0))
    q1 = F.when(few, mid).otherwise(F.col("_q")[0])
    q3 = F.when(few, mid).otherwise(F.col("_q")[2])
    return cuts.select(*keys, *kept, "n", mid.alias("median"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))


def summarize_runs(long: DataFrame, keys: Sequence[str] = GROUP, value: str = "value") -> DataFrame:
    """Mean, sample deviation, median, quartiles and their range per key."""
    moments = [F.avg(value).alias("mean"), sample_stddev(value).alias("std")]
    return quartiles(long, list(keys), value, moments).select(
        *keys, "n", "mean", "std", "median", "q1", "q3", "iqr")


def summarize_throughput(times: DataFrame, size: str = "size", method: str = "method",
                         time_s: str = "time_s") -> DataFrame:
    """Throughput statistics from times: deviations by relative error, and the
    quartiles change places because a long time is a low throughput."""
    t = summarize_runs(times, [size, method], time_s)

    def rate(by: str) -> Column:
        return F.when(F.col(by) > 0, F.col(size) / F.col(by)).otherwise(F.lit(0.0))

    return t.select(
        size, method, "n", rate("mean").alias("throughput"),
        F.when(F.col("mean") > 0, rate("mean") * F.col("std") / F.col("mean")).otherwise(0.0)
        .alias("throughput_std"),
        rate("median").alias("throughput_median"),
        F.when(F.col("median") > 0, rate("median") * F.col("iqr") / F.col("median")).otherwise(0.0)
        .alias("throughput_iqr"),
        rate("q3").alias("throughput_q1"), rate("q1").alias("throughput_q3"))


def methods_of(columns: Sequence[str]) -> list[str]:
    """Methods of a wide table, in column order, found by their time column."""
    return list(dict.fromkeys(c[: -len("_time_s")] for c in columns if c.endswith("_time_s")))


def unpivot_metrics(wide: DataFrame, metrics: Sequence[str] = METRICS, size: str = "size") -> DataFrame:
    """Wide run columns ``{method}_{metric}`` to ``(size, method, method_no, metric, value)``.

    Names are built from method and known metric, so a method whose name starts
    with another's is not mixed up with it. Missing values are left out.
    """
    entries = []
    for no, method in enumerate(methods_of(wide.columns)):
        for metric in metrics:
            if f"{method}_{metric}" in wide.columns:
                entries.append(F.struct(
                    F.lit(method).alias("method"), F.lit(no).alias("method_no"),
                    F.lit(metric).alias("metric"),
                    F.col(f"`{method}_{metric}`").cast("double").alias("value")))
    return wide.select(size, F.inline(F.array(*entries))).where("value is not null")


def aggregate_by_size(long: DataFrame, keys: Sequence[str] = GROUP, value: str = "value") -> DataFrame:
    """Mean, population deviation, median and quartiles per size, method and metric."""
    moments = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")]
    return quantiles(long, list(keys), value, (0.25, 0.5, 0.75), "_q", moments).where("n > 0").select(
        *keys, "n", "mean", "std", F.col("_q")[1].alias("median"),
        F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"))


def one_decimal(value: Column) -> Column:
    """One decimal as text; null stays null."""
    return F.when(value.isNotNull(), F.format_string("%.1f", value))


def format_table(agg: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``"mean (std)"`` per size, one column per method, ``-`` where a method has no runs."""
    cell = F.concat(one_decimal(F.col("mean")), F.lit(" ("), one_decimal(F.col("std")), F.lit(")"))
    return (agg.select("size", "method", cell.alias("cell"))
            .groupBy("size").pivot("method", list(methods)).agg(F.first("cell")).fillna("-"))


def best_per_size(agg: DataFrame, highest: bool = True, order: str = "method_no") -> DataFrame:
    """Best method of every size, compared after rounding to one decimal; the first wins a tie."""
    shown = F.round("mean", 1)
    place = Window.partitionBy("size").orderBy(shown.desc() if highest else shown.asc(), order)
    return (agg.withColumn("_place", F.row_number().over(place)).where("_place = 1")
            .select("size", "method", shown.alias("best")))


def pick_baseline(methods: Sequence[str], candidates: Sequence[str], fallback_prefix: str | None = None) -> str | None:
    """First candidate that was run, else the first method with the fallback prefix."""
    named = next((c for c in candidates if c in methods), None)
    if named is None and fallback_prefix is not None:
        named = next((m for m in methods if m.startswith(fallback_prefix)), None)
    return named


def with_baseline(agg: DataFrame, baseline: str) -> DataFrame:
    """Attach the baseline mean of the same size; null where it was not run."""
    base = agg.where(F.col("method") == baseline).select("size", F.col("mean").alias("baseline_mean"))
    return agg.join(base, "size", "left")


def speedup(agg: DataFrame, baseline: str) -> DataFrame:
    """Mean over baseline mean per size; the best of a size is flagged if above 1.01."""
    ratio = F.when(F.col("baseline_mean") > 0, F.col("mean") / F.col("baseline_mean"))
    rated = with_baseline(agg, baseline).where(F.col("method") != baseline).withColumn("speedup", ratio)
    top = F.max("speedup").over(Window.partitionBy("size"))
    return rated.withColumn("_top", top).select(
        "size", "method", "speedup",
        F.coalesce((F.col("speedup") == F.col("_top")) & (F.col("speedup") > 1.01), F.lit(False)).alias("flag"))


def normalized_throughput(agg: DataFrame, baseline: str) -> DataFrame:
    """Mean and deviation divided by the baseline mean of the size."""
    return with_baseline(agg, baseline).where((F.col("baseline_mean") > 0) & (F.col("mean") != 0)).select(
        "size", "method", (F.col("mean") / F.col("baseline_mean")).alias("ratio"),
        (F.col("std") / F.col("baseline_mean")).alias("ratio_std"))


def split_method(df: DataFrame, prefixes: Sequence[str] = (), labels: DataFrame | None = None,
                 method: str = "method") -> DataFrame:
    """Split a method name into base, fraction (``_f0.05``), prefix and rest, with a label.

    ``labels`` is ``(base, label)``; a base without a label shows its own name.
    """
    name = F.col(method)
    suffix = r"^(.*)_f([0-9.]+)$"
    swept = name.rlike(suffix)
    base = F.when(swept, F.regexp_extract(name, suffix, 1)).otherwise(name)
    fraction = F.when(swept, F.regexp_extract(name, suffix, 2).try_cast("double"))
    head, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        match = base.startswith(p + "_")
        head = F.when(match, F.lit(p)).otherwise(head)
        rest = F.when(match, F.substring(base, F.lit(len(p) + 2), F.length(base))).otherwise(rest)
    out = df.withColumn("base", base).withColumn("fraction", fraction)
    out = out.withColumn("prefix", head).withColumn("rest", rest)
    if labels is None:
        return out.withColumn("label", F.col("base"))
    named = labels.select(F.col("base").alias("_base"), F.col("label").alias("_label"))
    return (out.join(named, out["base"] == named["_base"], "left")
            .withColumn("label", F.coalesce("_label", "base")).drop("_base", "_label"))


def latest_per_label(df: DataFrame, by: Sequence[str], label: str, stamp: str, line: str) -> DataFrame:
    """The stamp of the last line of every label."""
    return df.groupBy(*by, label).agg(F.max_by(stamp, line).alias(stamp))


def telemetry_gaps(df: DataFrame, by: Sequence[str], spec: dict[str, tuple[str, str]],
                   label: str = "label", stamp: str = "epoch_us", line: str = "line_no") -> DataFrame:
    """Named intervals per call: stamp of the second checkpoint minus the first,
    each taken from its last line; null if either is missing."""
    names = sorted({n for pair in spec.values() for n in pair})
    at = {n: F.max_by(stamp, F.when(F.col(label) == n, F.col(line))) for n in names}
    return df.groupBy(*by).agg(*[(at[b] - at[a]).alias(out) for out, (a, b) in spec.items()])


def overhead_summary(df: DataFrame, components: Sequence[str], wall: str, inference: str,
                     size: str = "size") -> DataFrame:
    """Mean and population deviation per component, and the share of the wall time
    outside inference, per size."""
    columns = [*components] + [c for c in (wall, inference) if c not in components]
    stats = [f(c).alias(f"{c}_{n}") for c in columns
             for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    filled = [F.coalesce(f"{c}_{n}", F.lit(0.0)).alias(f"{c}_{n}") for c in columns for n in ("mean", "std")]
    mean = F.col(f"{wall}_mean")
    return df.groupBy(size).agg(*stats).select(size, *filled).withColumn(
        "overhead_pct", F.when(mean > 0, 100 * (mean - F.col(f"{inference}_mean")) / mean)).withColumn(
        "overhead_std_pct", F.when(mean > 0, 100 * F.col(f"{inference}_std") / mean))


def cpu_percent(df: DataFrame, key: str, order: str, cpu: str = "cpu", system: str = "system",
                cpus: str = "cpus") -> DataFrame:
    """Processor share between consecutive counter readings of a key; 0 unless both grew.

    The reading before is found by its position in the order of (key, order),
    so a key with most of the readings is spread like any other rows. A reading
    is identified by key and ``order``.
    """
    placed = with_position(df, key, order, name="_pos")
    before = placed.select((F.col("_pos") + 1).alias("_pos"), F.col(key).alias("_key"),
                           F.col(cpu).alias("_cpu"), F.col(system).alias("_system"))
    both = placed.join(before, "_pos", "left")
    used, passed = F.col(cpu) - F.col("_cpu"), F.col(system) - F.col("_system")
    grew = (F.col("_key") == F.col(key)) & (used > 0) & (passed > 0)
    share = F.when(grew, used / passed * F.col(cpus) * 100.0).otherwise(F.lit(0.0))
    return both.withColumn("cpu_percent", share).drop("_pos", "_key", "_cpu", "_system")


def memory_delta(df: DataFrame, run: str, order: str, value: str = "bytes") -> DataFrame:
    """First and last reading of a run, in MiB, and their difference."""
    mib = float(1024 * 1024)
    return df.groupBy(run).agg(
        (F.min_by(value, order) / mib).alias("baseline_mib"), (F.max_by(value, order) / mib).alias("peak_mib"),
    ).withColumn("delta_mib", F.col("peak_mib") - F.col("baseline_mib"))


def average_and_ratio(df: DataFrame, pairs: Sequence[tuple[str, str]], method: str = "method",
                      value: str = "throughput") -> DataFrame:
    """Mean over all sizes per method and the ratio of each named pair:
    ``(numerator, denominator, numerator_mean, denominator_mean, ratio)``."""
    names = sorted({n for pair in pairs for n in pair})
    means = df.groupBy().agg(*[F.avg(F.when(F.col(method) == n, F.col(value))).alias(f"_m{i}")
                               for i, n in enumerate(names)])
    mean = {n: F.col(f"_m{i}") for i, n in enumerate(names)}
    rows = [F.struct(F.lit(a).alias("numerator"), F.lit(b).alias("denominator"),
                     mean[a].alias("numerator_mean"), mean[b].alias("denominator_mean"),
                     F.when(mean[b] != 0, mean[a] / mean[b]).alias("ratio")) for a, b in pairs]
    return means.select(F.inline(F.array(*rows)))


def apply_size_cap(grid: DataFrame, results: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Results on the full size and method grid; a method above its cap has none."""
    allowed = F.lit(True)
    for method, cap in caps.items():
        allowed = allowed & ~((F.col("method") == method) & (F.col("size") > cap))
    return grid.join(results.where(allowed), ["size", "method"], "left")
