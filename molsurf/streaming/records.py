"""Benchmark records as they arrive: a folder of JSON lines is read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bench
from ..sources.bench_json import RECORD

RUN = ["pdb_id", "method", "method_parameter_hash", "repeat_index", "program_version"]


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's first record. The state holds a row for each run, which is what resuming needs to know."""
    return spark.readStream.schema(RECORD).json(folder).where("event = 'benchmark_result'").dropDuplicates(RUN)


def compare_as_it_arrives(records: DataFrame, baseline: DataFrame, history: str, report: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to the history and write the comparison with the baseline anew. A batch that is run again overwrites its own part of the history."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{history}/batch={number}")
        current = rows.sparkSession.read.parquet(history)
        bench.compare(bench.normalized(baseline), bench.normalized(current)).write.mode("overwrite").parquet(report)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(records: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean seconds by window and method; state of windows behind the watermark is dropped."""
    return records.withWatermark(time, late).groupBy(F.window(time, window), "method").agg(F.count("*").alias("records"), F.avg("wall_seconds").alias("seconds"))
