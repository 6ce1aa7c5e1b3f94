"""Parameter grids as tables: names, overrides and stable hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def named(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Add variant (k=v pairs in key order, joined by __; without pairs, default) and hash (of the sorted JSON)."""
    keys = sorted(keys)
    name = F.concat_ws("__", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in keys]) if keys else F.lit("default")
    return grid.withColumns({"variant": name, "hash": F.substring(F.sha2(F.to_json(F.struct(*keys)) if keys else F.lit("{}"), 256), 1, 16)})


def cartesian(spark: SparkSession, values: dict[str, list[str]]) -> DataFrame:
    """All combinations: a grid that the caller lists is small, so its cross join is too."""
    axes = [spark.createDataFrame([(v,) for v in dict.fromkeys(vs)], f"{k} string") for k, vs in values.items()]
    return named(reduce(DataFrame.crossJoin, axes), list(values))


def single_axis(spark: SparkSession, base: dict[str, str], values: dict[str, list[str]]) -> DataFrame:
    """One key at a time, without its base value."""
    parts = [named(spark.createDataFrame([(v,) for v in dict.fromkeys(vs) if v != base.get(k)] or [], f"{k} string"), [k]).select("variant", "hash") for k, vs in values.items()]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["hash"])
