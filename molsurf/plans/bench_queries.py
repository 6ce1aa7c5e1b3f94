"""Benchmark analytics over proxy records: events as runs, line items as sweeps, orders as jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import q6
from ..operators import bench
from ..operators.variants import cartesian, single_axis

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


RECORDS = """WITH rec AS (
  SELECT event_id, (user_id % 50)::VARCHAR AS pdb_id, event_type AS method, 'v' || (user_id % 3) AS variant, 'points' AS interface_mode, 'independent' AS scenario,
         CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, value AS wall_seconds, (event_id % 1000)::DOUBLE AS point_count, event_id % 5 <> 0 AS clean FROM events
)"""
CASES = "pdb_id, method, variant, interface_mode, scenario"
MEDIAN = "coalesce(median(wall_seconds) FILTER (clean), median(wall_seconds)) AS wall_seconds, median(point_count) AS point_count"
COMPARED = (
    RECORDS
    + f""", stats AS (SELECT event_id % 2 AS half, {CASES}, {MEDIAN} FROM rec WHERE status = 'ok' AND wall_seconds IS NOT NULL GROUP BY ALL),
cmp AS (
  SELECT b.pdb_id, b.method, b.variant, b.interface_mode, b.scenario, b.wall_seconds AS baseline_seconds, c.wall_seconds AS current_seconds,
         CASE WHEN b.wall_seconds > 0 THEN c.wall_seconds / b.wall_seconds END AS wall_ratio, CASE WHEN b.point_count > 0 THEN c.point_count / b.point_count END AS point_ratio
  FROM stats b JOIN stats c ON b.half = 0 AND c.half = 1 AND b.pdb_id = c.pdb_id AND b.method = c.method AND b.variant = c.variant
), flags AS (SELECT *, coalesce(wall_ratio > 1.1e0, false) AS regression, coalesce(wall_ratio < 0.95e0, false) AS improvement, coalesce(abs(point_ratio - 1) > 0.05e0, false) AS points_changed FROM cmp)"""
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id", (F.col("user_id") % 50).cast("string").alias("pdb_id"), F.col("event_type").alias("method"), F.concat(F.lit("v"), F.col("user_id") % 3).alias("variant"), F.lit("points").alias("interface_mode"), F.lit("independent").alias("scenario"),
        F.when(F.col("event_id") % 17 == 0, "error").otherwise("ok").alias("status"), F.col("value").alias("wall_seconds"), (F.col("event_id") % 1000).cast("double").alias("point_count"), (F.col("event_id") % 5 != 0).alias("clean"),
    )


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir)
    return r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1")


@query(RECORDS + f" SELECT {CASES}, count(*) AS records, count(*) FILTER (clean) AS clean_records, {MEDIAN} FROM rec WHERE status = 'ok' AND wall_seconds IS NOT NULL GROUP BY ALL")
def bench_case_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.case_medians(records(spark, sf_dir))


@query(COMPARED + f" SELECT {CASES}, {q6('wall_ratio')} AS wall_ratio, {q6('point_ratio')} AS point_ratio, regression, improvement, points_changed FROM flags")
def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bench.compare(*halves(spark, sf_dir))
    return c.select(*bench.CASE, F.expr(q6("wall_ratio")).alias("wall_ratio"), F.expr(q6("point_ratio")).alias("point_ratio"), "regression", "improvement", "points_changed")


@query(
    COMPARED
    + f""" SELECT method, variant, interface_mode, scenario, count(*) AS cases, {q6('median(wall_ratio)')} AS median_ratio, count(*) FILTER (regression) AS regressions, count(*) FILTER (improvement) AS improvements,
count(*) FILTER (points_changed) AS points_changed, arg_max(pdb_id, (coalesce(wall_ratio, '-inf'::DOUBLE), pdb_id)) AS worst_case, arg_min(pdb_id, (coalesce(wall_ratio, 'inf'::DOUBLE), pdb_id)) AS best_case FROM flags GROUP BY method, variant, interface_mode, scenario"""
)
def bench_variant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.variant_rollup(bench.compare(*halves(spark, sf_dir))).withColumn("median_ratio", F.expr(q6("median_ratio")))


@query(COMPARED + f" SELECT {CASES}, {q6('wall_ratio')} AS wall_ratio FROM flags WHERE regression ORDER BY flags.wall_ratio DESC, {CASES} LIMIT 25")
def bench_top_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.top(bench.compare(*halves(spark, sf_dir)), "regression").select(*bench.CASE, F.expr(q6("wall_ratio")).alias("wall_ratio"))


# Two runs of all records: each fifth molecule is in the first run only, the next one in the second only, and the others' records are dealt by event_id.
FIRST_RUN = "coalesce(pdb_id % 5 = 0 OR pdb_id % 5 > 1 AND event_id % 2 = 0, true)"


@query(RECORDS + f", st AS (SELECT DISTINCT {FIRST_RUN.replace('pdb_id', 'pdb_id::BIGINT')} AS first, {CASES} FROM rec WHERE status = 'ok' AND wall_seconds IS NOT NULL), b AS (SELECT {CASES} FROM st WHERE first), c AS (SELECT {CASES} FROM st WHERE NOT first) SELECT *, 'baseline' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'current' FROM (SELECT * FROM c EXCEPT SELECT * FROM b)")
def bench_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    first = F.expr(FIRST_RUN.replace("pdb_id", "cast(pdb_id as bigint)"))
    return bench.unmatched(r.where(first), r.where(~first))


SWEEP = """WITH rec AS (
  SELECT l_shipmode_ AS method, 'points' AS interface_mode, 'independent' AS scenario, CASE WHEN l_linenumber = 1 THEN 'default' ELSE 'm=' || l_linenumber END AS variant,
         'h' || l_linenumber AS method_parameter_hash, l_extendedprice AS wall_seconds, l_quantity AS point_count, l_tax > 0.02e0 AS clean FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem)
), rows AS (SELECT method, interface_mode, scenario, variant, method_parameter_hash, count(*) AS records, coalesce(median(wall_seconds) FILTER (clean), median(wall_seconds)) AS wall_seconds, median(point_count) AS point_count FROM rec GROUP BY ALL)
SELECT r.*, """ + q6("CASE WHEN r.wall_seconds > 0 THEN d.wall_seconds / r.wall_seconds END") + """ AS speedup_vs_default
FROM rows r LEFT JOIN rows d ON d.variant = 'default' AND d.method = r.method"""


@query(SWEEP)
def bench_sweep_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus").alias("method"), F.lit("points").alias("interface_mode"), F.lit("independent").alias("scenario"), F.when(F.col("l_linenumber") == 1, "default").otherwise(F.concat(F.lit("m="), "l_linenumber")).alias("variant"),
        F.concat(F.lit("h"), "l_linenumber").alias("method_parameter_hash"), F.lit("ok").alias("status"), F.col("l_extendedprice").alias("wall_seconds"), F.col("l_quantity").alias("point_count"), (F.col("l_tax") > 0.02).alias("clean"),
    )
    return bench.sweep(rec).withColumn("speedup_vs_default", F.expr(q6("speedup_vs_default")))


@query("SELECT l_returnflag, l_linestatus, " + ", ".join(f"{q6(e)} AS {n}" for n, e in {"mean": "avg(l_extendedprice)", "median": "median(l_extendedprice)", "p90": "quantile_cont(l_extendedprice, 0.9)", "p95": "quantile_cont(l_extendedprice, 0.95)", "max": "max(l_extendedprice)"}.items()) + " FROM lineitem GROUP BY ALL")
def bench_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bench.numeric_summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return s.select("l_returnflag", "l_linestatus", *[F.expr(q6(c)).alias(c) for c in ("mean", "median", "p90", "p95", "max")])


@query(RECORDS + " SELECT status, method, grouping_id(status, method)::INT AS grain, count(*) AS records FROM rec GROUP BY GROUPING SETS ((status), (method), (status, method))")
def bench_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at three grains in one pass."""
    return records(spark, sf_dir).groupingSets([["status"], ["method"], ["status", "method"]], "status", "method").agg(F.grouping_id().cast("int").alias("grain"), F.count("*").alias("records"))


@query(f"SELECT name, count(*) AS profiles, sum(calls)::BIGINT AS calls, {q6('sum(seconds)')} AS seconds FROM (SELECT event_type AS name, event_id % 7 AS calls, value AS seconds FROM events UNION ALL SELECT event_type || ':' || (user_id % 20), event_id % 3, value / 2e0 FROM events) GROUP BY name ORDER BY sum(seconds) DESC, name LIMIT 50")
def bench_profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    f = lambda name, calls, s: F.struct(name.alias("name"), calls.alias("calls"), s.alias("wall_seconds_total"))
    payloads = e.select(F.array(f(F.col("event_type"), F.col("event_id") % 7, F.col("value")), f(F.concat("event_type", F.lit(":"), F.col("user_id") % 20), F.col("event_id") % 3, F.col("value") / 2.0)).alias("top_functions"))
    return bench.profile_rollup(payloads).withColumn("seconds", F.expr(q6("seconds")))


@query("WITH m AS (SELECT unnest([64, 128, 192]) AS m), s AS (SELECT unnest(['0.1', '0.3']) AS s), v AS (SELECT 'm=' || m || '__smoothness=' || s AS variant, substr(sha256('{\"m\":\"' || m || '\",\"smoothness\":\"' || s || '\"}'), 1, 16) AS hash FROM m, s UNION SELECT 'm=' || m, substr(sha256('{\"m\":\"' || m || '\"}'), 1, 16) FROM m WHERE m <> 192) SELECT vec_id, variant, hash FROM embeddings, v")
def bench_variants_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs: every vector, standing for a structure, under a cartesian grid of parameters and a one-axis grid that skips the base value."""
    grid = cartesian(spark, {"m": ["64", "128", "192"], "smoothness": ["0.1", "0.3"]})
    variants = grid.select("variant", "hash").unionByName(single_axis(spark, {"m": "192"}, {"m": ["64", "128", "192"]})).collect()  # a row for each setting
    each = F.explode(F.array(*[F.struct(F.lit(v["variant"]).alias("variant"), F.lit(v["hash"]).alias("hash")) for v in variants]))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", each.alias("v")).select("vec_id", "v.*")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def bench_resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for jobs, returned line items for the records of a program version."""
    jobs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pdb_id"), F.lit("m").alias("method"), F.lit("h").alias("method_parameter_hash"), F.lit(0).alias("repeat_index"), "o_custkey")
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("pdb_id"), F.lit("m").alias("method"), F.lit("h").alias("method_parameter_hash"), F.lit(0).alias("repeat_index"), F.col("l_returnflag").alias("program_version"))
    return bench.pending(jobs, done, "R").select(F.col("pdb_id").alias("o_orderkey"), "o_custkey")


@query("SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS i FROM supplier) WHERE i % 3 = 1 ORDER BY i LIMIT 20 OFFSET 2")
def bench_shard_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return bench.select_shard(files, [F.desc("s_acctbal"), F.asc("s_suppkey")], 3, 1, 2, 20).select("s_suppkey", "s_name")
