"""Benchmark records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

RECORD = (
    "event string, status string, pdb_id string, method string, variant_name string, method_variant_name string, method_parameter_hash string, interface_mode string, repeat_index int, program_version string, "
    "wall_seconds double, cuda_event_ms double, point_count long, points_per_wall_second double, gpu_peak_allocated_mb double, atom_count long, method_params map<string,string>, "
    "interface_params struct<mode:string,scenario_mode:string>, profiling struct<internal_profile_enabled:boolean,torch_profile_enabled:boolean>, "
    "reference_metrics struct<status:string,error:string,reference_vertex_count:long,sampled_point_count:long,sampled_reference_count:long,point_count_to_reference_ratio:double,"
    "point_to_reference_distance:struct<mean:double,median:double,p90:double,p95:double,max:double>,reference_to_point_distance:struct<mean:double,median:double,p90:double,p95:double,max:double>,"
    "symmetric_mean_distance:double>, error string, supports_mean double, supports_max long, normal_error_mean double, normal_error_max double, feature_values long, edge_count long, mean_degree double, finite_weights boolean"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Result records of JSON-lines files; a bad line is an error."""
    return spark.read.schema(RECORD).json(path, mode="FAILFAST").where("event = 'benchmark_result'")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Result records of a JSON file that lists them under records."""
    nested = StructType([StructField("records", ArrayType(StructType.fromDDL(RECORD)))])
    return spark.read.schema(nested).json(path, multiLine=True, mode="FAILFAST").select(F.inline("records")).where("event = 'benchmark_result'")


FUNCTION = "struct<name:string,calls:long,wall_seconds_total:double>"
CALL = "struct<name:string,wall_seconds:double>"
OP = "struct<key:string,count:long,cuda_time_total_us:double,cpu_time_total_us:double,cuda_memory_usage_bytes:long>"
PROFILE = (
    f"pdb_id string, method string, variant_name string, interface_mode string, internal_profile struct<top_functions:array<{FUNCTION}>,top_calls:array<{CALL}>>, "
    f"torch_profile struct<top_ops:struct<cuda_time:array<{OP}>,cpu_time:array<{OP}>,memory:array<{OP}>>>, profile_artifact struct<path:string>"
)


def read_profiles(spark: SparkSession, path: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(payloads, errors): profiles within the records of path, in the JSON files that records name, and in a folder's ``*.profile.json``; each file once.

    errors (path, error) has the files that are not there or hold no JSON. Relative names are looked up beside the records.
    """
    records = spark.read.schema(PROFILE).json(path)
    beside = path.rstrip("/").rpartition("/")[0]
    own = records.where("profile_artifact.path is null and (internal_profile is not null or torch_profile is not null)").drop("profile_artifact")
    named = records.where("profile_artifact.path <> ''").select(F.col("profile_artifact.path").alias("p")).distinct()
    where = F.when(F.col("p").rlike("^(/|[a-z0-9]+:)"), F.col("p")).otherwise(F.concat(F.lit(f"{beside}/" if beside else ""), F.col("p")))
    paths = sorted(r["p"] for r in named.select(where.alias("p")).collect())  # one for each profiled run
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there, missing = [], []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        (there if at.getFileSystem(conf).exists(at) else missing).append(p)
    if folder is not None:
        found = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.profile.json")
        known = {jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).makeQualified(jvm.org.apache.hadoop.fs.Path(p)).toString() for p in there}
        there += [s for f in (found.getFileSystem(conf).globStatus(found) or []) if (s := f.getPath().toString()) not in known]
    errors = [(p, "not there") for p in missing]
    payloads = own
    if there:
        read = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        parsed = read.withColumn("r", F.from_json("value", PROFILE.rpartition(", ")[0] + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
        payloads = payloads.unionByName(parsed.where("r._bad is null").select("r.*").drop("_bad"))
        errors += [(r["path"], "no JSON") for r in parsed.where("r._bad is not null").select("path").collect()]
    return payloads, spark.createDataFrame(errors, "path string, error string")


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
