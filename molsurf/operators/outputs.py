"""What a sampler's output amounts to, and its forms as matrices: statistics, dense features and supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def output_stats(points: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """A row for each molecule of points (mol_id, nx, ny, nz, supports array): counts, supports a point, how far normals are from unit length.

    With edges (mol_id, src, dst, weight): their number, the share of all ordered pairs of points that they are, and the mean degree.
    """
    error = F.abs(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) - 1)
    out = points.groupBy("mol_id").agg(
        F.count("*").alias("point_count"),
        F.avg(F.size("supports")).alias("supports_mean"),
        F.max(F.size("supports")).cast("long").alias("supports_max"),
        F.avg(error).alias("normal_error_mean"),
        F.max(error).alias("normal_error_max"),
        F.every(finite(F.col("nx")) & finite(F.col("ny")) & finite(F.col("nz"))).alias("finite_normals"),
    )
    if edges is None:
        return out
    count = edges.groupBy("mol_id").agg(F.count("*").alias("edge_count"), F.every(finite(F.col("weight"))).alias("finite_weights"))
    both = out.join(count, "mol_id", "left").withColumns({"edge_count": F.coalesce("edge_count", F.lit(0).cast("long")), "finite_weights": F.coalesce("finite_weights", F.lit(True))})
    n = F.col("point_count")
    return both.withColumns({"density": F.col("edge_count") / (n.cast("double") * n), "mean_degree": F.col("edge_count") / n})


def supports_of(features: Column) -> Column:
    """The positions, from 0, of a dense row's positive values."""
    return F.filter(F.transform(features, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def dense_features(samples: DataFrame, atoms: DataFrame, weights: bool = True) -> DataFrame:
    """(mol_id, point_id, features): a value for each atom of the molecule, its weight or 1 among the point's supports, else 0.

    atoms (mol_id, atom_idx) tells each molecule's size; supports are structs (atom_idx, weight).
    """
    size = atoms.groupBy("mol_id").agg((F.max("atom_idx") + 1).cast("int").alias("_n"))
    at = samples.select("mol_id", "point_id", "supports").join(size, "mol_id")
    own = F.map_from_entries(F.transform("supports", lambda s: F.struct(s["atom_idx"].cast("int"), s["weight"] if weights else F.lit(1.0))))
    at = at.withColumn("_w", own)
    return at.select("mol_id", "point_id", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at(F.col("_w"), i), F.lit(0.0))).alias("features"))


def crowded(members: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """The keys (such as a molecule's tiles) that at least so many rows share, with their number: 1 for active, 3 for tiles that may hold a triple."""
    return members.groupBy(*keys).agg(F.count("*").alias("members")).where(F.col("members") >= least)


def limited(points: DataFrame, most: int) -> DataFrame:
    """At most ``most`` points (mol_id, point_id) of each molecule, evenly spread over its order: positions floor(k (n - 1) / (most - 1))."""
    if most < 1:
        raise ValueError("most must be positive")
    from pyspark.sql import Window

    by = Window.partitionBy("mol_id")
    at = points.withColumn("_i", F.row_number().over(by.orderBy("point_id")).cast("long") - 1).withColumn("_n", F.count("*").over(by))
    if most == 1:
        return at.where("_i = 0").drop("_i", "_n")
    # position i is taken if some whole k has floor(k (n - 1) / (most - 1)) = i
    k = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    taken = (F.col("_n") <= most) | (F.floor(k * (F.col("_n") - 1) / (most - 1)) == F.col("_i"))
    return at.where(taken).drop("_i", "_n")
