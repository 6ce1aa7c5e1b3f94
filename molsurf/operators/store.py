"""Tables that cut the lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder of spark.checkpoint.dir and read again; a temporary folder only in local mode."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints_"))
    return df.checkpoint()


#: Tasks for each shuffle partition, where a group is much work on few bytes.
FINER = 2


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in a fixed number of partitions: groups that are small in bytes and long in work are not put together into few tasks."""
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
