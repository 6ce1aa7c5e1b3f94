"""Analytics over benchmark records: medians, comparison, sweeps, profiles, resumption and shards."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COUNT_TOLERANCE, IMPROVEMENT, REGRESSION
from .store import checkpointed

CASE = ["pdb_id", "method", "variant", "interface_mode", "scenario"]
VARIANT = CASE[1:]


def normalized(records: DataFrame) -> DataFrame:
    """The case key with its defaults, and whether a run was free of profiling; absent columns count as null."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None)
    text = lambda c, d: F.coalesce(has(c).cast("string"), F.lit(d))
    scenario = F.col("interface_params.scenario_mode") if "interface_params" in records.columns else F.lit(None)
    flag = lambda f: F.coalesce(F.col(f"profiling.{f}"), F.lit(False)) if "profiling" in records.columns else F.lit(False)
    variant = F.coalesce(F.when(has("method_variant_name").cast("string") != "", has("method_variant_name").cast("string")), has("variant_name").cast("string"), F.lit("default"))
    return records.withColumns({
        "pdb_id": text("pdb_id", ""), "method": text("method", ""), "variant": variant, "interface_mode": text("interface_mode", "points"),
        "scenario": F.coalesce(scenario.cast("string"), F.lit("independent")), "clean": ~(flag("internal_profile_enabled") | flag("torch_profile_enabled")),
    })


def clean_median(c: str) -> Column:
    """Over the runs without profiling, or over all if there is none."""
    return F.when(F.count_if("clean") > 0, F.median(F.when(F.col("clean"), F.col(c)))).otherwise(F.median(c))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def case_medians(records: DataFrame) -> DataFrame:
    ok = records.where("status = 'ok' AND wall_seconds IS NOT NULL")
    return ok.groupBy(*CASE).agg(F.count("*").alias("records"), F.count_if("clean").alias("clean_records"), clean_median("wall_seconds").alias("wall_seconds"), F.median("point_count").alias("point_count"))


def compare(baseline: DataFrame, current: DataFrame, regression: float = REGRESSION, improvement: float = IMPROVEMENT, count_tolerance: float = COUNT_TOLERANCE) -> DataFrame:
    """A row for each case of both runs, with ratios and flags."""
    b = case_medians(baseline).select(*CASE, F.col("wall_seconds").alias("baseline_seconds"), F.col("point_count").alias("baseline_points"))
    c = case_medians(current).select(*CASE, F.col("wall_seconds").alias("current_seconds"), F.col("point_count").alias("current_points"))
    j = b.join(c, CASE).withColumns({"wall_ratio": ratio(F.col("current_seconds"), F.col("baseline_seconds")), "speedup": ratio(F.col("baseline_seconds"), F.col("current_seconds")), "point_ratio": ratio(F.col("current_points"), F.col("baseline_points"))})
    flag = lambda x: F.coalesce(x, F.lit(False))
    return j.withColumns({"regression": flag(F.col("wall_ratio") > 1 + regression), "improvement": flag(F.col("wall_ratio") < 1 - improvement), "points_changed": flag(F.abs(F.col("point_ratio") - 1) > count_tolerance)})


def unmatched(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cases of one run only: two anti joins."""
    b, c = case_medians(baseline).select(*CASE), case_medians(current).select(*CASE)
    only = lambda x, y, s: x.join(y, CASE, "left_anti").withColumn("side", F.lit(s))
    return only(b, c, "baseline").unionByName(only(c, b, "current"))


def variant_rollup(comparison: DataFrame) -> DataFrame:
    worst = F.max_by("pdb_id", F.struct(F.coalesce("wall_ratio", F.lit(float("-inf"))), "pdb_id"))
    best = F.min_by("pdb_id", F.struct(F.coalesce("wall_ratio", F.lit(float("inf"))), "pdb_id"))
    return comparison.groupBy(*VARIANT).agg(F.count("*").alias("cases"), F.median("wall_ratio").alias("median_ratio"), F.count_if("regression").alias("regressions"), F.count_if("improvement").alias("improvements"), F.count_if("points_changed").alias("points_changed"), worst.alias("worst_case"), best.alias("best_case"))


def top(comparison: DataFrame, kind: str, n: int = 25) -> DataFrame:
    """The n worst regressions, best improvements or largest point changes; ties by case."""
    order = {"regression": F.desc("wall_ratio"), "improvement": F.asc("wall_ratio"), "points_changed": F.desc(F.abs(F.col("point_ratio") - 1))}[kind]
    return comparison.where(kind).orderBy(order, *CASE).limit(n)


def sweep(records: DataFrame) -> DataFrame:
    """Medians of each variant, and its speed-up over the default of its method, interface and scenario."""
    keys = ["method", "interface_mode", "scenario", "variant", "method_parameter_hash"]
    rows = records.where("status = 'ok'").groupBy(*keys).agg(F.count("*").alias("records"), clean_median("wall_seconds").alias("wall_seconds"), F.median("point_count").alias("point_count"))
    default = rows.where("variant = 'default'").groupBy("method", "interface_mode", "scenario").agg(F.max_by("wall_seconds", "method_parameter_hash").alias("default_seconds"))
    return rows.join(default, ["method", "interface_mode", "scenario"], "left").withColumn("speedup_vs_default", ratio(F.col("default_seconds"), F.col("wall_seconds"))).drop("default_seconds")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], more: list[Column] | None = None) -> DataFrame:
    """keys, the aggregates ``more`` and a column for each share: exact percentiles of the non-null values, interpolated as F.percentile does, with no group in one buffer.

    Equal values are counted first, then dealt by range of (keys, value). A running
    sum inside each part of a group, and the sums of its parts before, tell which
    ranks a value has; only values of a wanted rank go on.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    named = lambda rows: rows.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("\0")) for n, k in zip(names, keys)})
    own = named(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(own.select(*names, "_v", "_n").repartitionByRange(parts, *names, "_v").withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*names, "_p").agg(F.sum("_n").alias("_s")).withColumns({"_o": F.coalesce(F.sum("_s").over(before), F.lit(0)), "_total": F.sum("_s").over(Window.partitionBy(*names))}).drop("_s")
    inside = Window.partitionBy(*names, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(sums, [*names, "_p"]).withColumn("_end", F.sum("_n").over(inside) + F.col("_o"))
    at = {name: F.lit(q) * (F.col("_total") - 1) for name, q in shares.items()}
    has = lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end"))
    hits = placed.where(reduce(or_, [has(f(x)) for x in at.values() for f in (F.floor, F.ceil)]))
    columns = []
    for name, x in at.items():
        low, high, rank = F.max(F.when(has(F.floor(x)), F.col("_v"))), F.max(F.when(has(F.ceil(x)), F.col("_v"))), F.max(x)
        columns.append(F.when(F.ceil(rank) == F.floor(rank), low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high).alias(name))
    whole = df.groupBy(*keys).agg(*(more or [F.count("*").alias("_rows")]))
    return named(whole).join(hits.groupBy(*names).agg(*columns), names, "left").drop("_rows", *names)


def numeric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, p90, p95 and maximum of each group."""
    got = percentiles(df, keys, value, {"median": 0.5, "p90": 0.9, "p95": 0.95}, [F.avg(value).alias("mean"), F.max(value).alias("max")])
    return got.select(*keys, "mean", "median", "p90", "p95", "max")


def fastest(records: DataFrame, n: int = 10) -> DataFrame:
    """The n fastest runs of each method."""
    w = Window.partitionBy("method").orderBy("wall_seconds", "pdb_id", "repeat_index")
    return records.where("status = 'ok' AND wall_seconds IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def profile_rollup(payloads: DataFrame, n: int = 50) -> DataFrame:
    """Of payloads with top_functions array<struct<name, calls, wall_seconds_total>>: totals by function, the n costliest."""
    f = payloads.select(F.explode_outer("top_functions").alias("f")).select("f.*").where("name IS NOT NULL AND name <> ''")
    sums = f.groupBy("name").agg(F.count("*").alias("profiles"), F.sum(F.coalesce("calls", F.lit(0))).cast("long").alias("calls"), F.sum(F.coalesce("wall_seconds_total", F.lit(0.0))).alias("seconds"))
    return sums.orderBy(F.desc("seconds"), "name").limit(n)


def pending(jobs: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Jobs (pdb_id, method, method_parameter_hash, repeat_index) that no record of the same program version covers."""
    return jobs.join(done.where(F.col("program_version") == version), ["pdb_id", "method", "method_parameter_hash", "repeat_index"], "left_anti")


def select_shard(files: DataFrame, order: list[Column], shards: int, shard: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Every ``shards``-th file in the order, from ``shard`` on; then the offset and the limit. A listing of files is small enough for one task."""
    numbered = files.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1).where(F.pmod("_i", F.lit(shards)) == shard)
    out = numbered.orderBy("_i").offset(offset)
    return (out if limit is None else out.limit(limit)).drop("_i")


GRAINS = {"method": ["method"], "variant": ["method", "variant_name", "method_parameter_hash"], "interface": ["method", "interface_mode"]}


def summarize(records: DataFrame, values: tuple[str, ...] = ("wall_seconds", "cuda_event_ms", "point_count", "points_per_wall_second", "gpu_peak_allocated_mb", "atom_count")) -> DataFrame:
    """Statistics of successful runs by method, by variant and by interface, in one pass over the records.

    Each value has its mean, median, p90, p95 and maximum over its non-null
    values; clean_<value> of the two timings leaves profiled runs out.
    """
    keys = list(dict.fromkeys(k for g in GRAINS.values() for k in g))
    ok = F.col("status") == "ok"
    columns = {v: F.when(ok, F.col(v)) for v in values} | {f"clean_{v}": F.when(ok & F.col("clean"), F.col(v)) for v in ("wall_seconds", "points_per_wall_second")}
    stats = lambda c: F.struct(F.avg(c).alias("mean"), F.median(c).alias("median"), F.percentile(c, F.lit(0.9)).alias("p90"), F.percentile(c, F.lit(0.95)).alias("p95"), F.max(c).alias("max"))
    sets = records.groupingSets([[F.col(k) for k in g] for g in GRAINS.values()], *keys)
    out = sets.agg(F.grouping_id().alias("_g"), F.count("*").alias("records"), F.count_if(ok).alias("ok"), F.count_if(ok & F.col("clean")).alias("clean"), *[stats(c).alias(n) for n, c in columns.items()])
    grain = F.lit(None)
    for name, g in GRAINS.items():
        absent = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in g)
        grain = F.when(F.col("_g") == absent, name).otherwise(grain)
    return out.withColumn("grain", grain).drop("_g")


def status_counts(records: DataFrame) -> DataFrame:
    """Records by method and status."""
    return records.groupBy("method", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("records"))


def reference_status(records: DataFrame) -> DataFrame:
    """Successful runs by the status of their reference metrics."""
    return records.where("status = 'ok'").groupBy("method", F.coalesce("reference_metrics.status", F.lit("none")).alias("reference_status")).agg(F.count("*").alias("records"))


def profile_ops(payloads: DataFrame, n: int = 50) -> DataFrame:
    """Of payloads with top_ops struct of arrays cuda_time, cpu_time and memory: totals by operation, the n costliest."""
    lists = F.concat(*[F.coalesce(F.col(f"top_ops.{b}"), F.array()) for b in ("cuda_time", "cpu_time", "memory")])
    each = payloads.select(F.explode(lists).alias("o")).select("o.*").where("key IS NOT NULL AND key <> ''")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    sums = each.groupBy("key").agg(F.count("*").alias("profiles"), *[total(c).alias(c) for c in ("count", "cuda_time_total_us", "cpu_time_total_us", "cuda_memory_usage_bytes")])
    return sums.orderBy(F.desc("cuda_time_total_us"), F.desc("cpu_time_total_us"), F.desc(F.abs("cuda_memory_usage_bytes")), "key").limit(n)


def slowest_calls(payloads: DataFrame, n: int = 50) -> DataFrame:
    """Of payloads with top_calls array<struct<name, wall_seconds>>: the n slowest single calls."""
    return payloads.select("pdb_id", "method", "interface_mode", F.explode("top_calls").alias("c")).select("pdb_id", "method", "interface_mode", "c.*").orderBy(F.desc(F.coalesce("wall_seconds", F.lit(0.0))), "pdb_id", "name").limit(n)
