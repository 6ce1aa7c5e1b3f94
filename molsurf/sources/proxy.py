"""Molecules derived from the embeddings table, for tables without structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RADII


def atoms_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, atom_idx, x, y, z, radius): a molecule for each label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    radius = F.element_at(F.array(*[F.lit(RADII[k]) for k in (0, 1, 2, 3, 4, 5)]), (F.col("vec_id") % 6).cast("int") + 1)
    at = {c: F.floor(F.element_at("embedding", k).cast("double") * 40 * F.lit(1e4) + 0.5) / F.lit(1e4) for k, c in enumerate("xyz", 1)}
    index = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("mol_id"), index.cast("long").alias("atom_idx"), *[v.alias(c) for c, v in at.items()], radius.alias("radius"))


#: The same view for other SQL engines.
SQL = """atoms AS (
  SELECT label::BIGINT AS mol_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS atom_idx,
         floor(embedding[1]::DOUBLE * 40 * 1e4 + 0.5) / 1e4 AS x, floor(embedding[2]::DOUBLE * 40 * 1e4 + 0.5) / 1e4 AS y,
         floor(embedding[3]::DOUBLE * 40 * 1e4 + 0.5) / 1e4 AS z,
         CASE vec_id % 6 WHEN 0 THEN 1.7e0 WHEN 1 THEN 1.1e0 WHEN 2 THEN 1.52e0 WHEN 3 THEN 1.55e0 WHEN 4 THEN 1.8e0 ELSE 1.9e0 END AS radius
  FROM embeddings
), e AS (SELECT *, radius + 1.4e0 AS r FROM atoms)"""
