"""Operators on point sets: windowed neighbours, even and farthest picks, shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.formulas import dist2
from .tiles import numbered

LEVELS = 1023


def spatial_key(points: DataFrame) -> DataFrame:
    """Add key: each axis in 1024 steps of the molecule's extent, x first."""
    box = points.groupBy("mol_id").agg(*[F.min(c).alias(f"_l{c}") for c in "xyz"], *[F.max(c).alias(f"_h{c}") for c in "xyz"]).withColumnRenamed("mol_id", "_m")
    step = lambda c: F.floor((F.col(c) - F.col(f"_l{c}")) / F.greatest(F.col(f"_h{c}") - F.col(f"_l{c}"), F.lit(1e-12)) * F.lit(float(LEVELS))).cast("long")
    met = points.join(box, F.col("mol_id") == F.col("_m"))
    return met.withColumn("key", (step("x") * (LEVELS + 1) + step("y")) * (LEVELS + 1) + step("z")).drop("_m", *[f"_{s}{c}" for s in "lh" for c in "xyz"])


#: Slabs along x, of which the places of a group are summed up.
SLAB = (LEVELS + 1) ** 2


def in_frames(points: DataFrame, groups: list[str], reach: int, keep: list[str]) -> DataFrame:
    """Pairs of points (mol_id, point_id, key, groups and ``keep``) at most ``reach`` places apart in the spatial order of a group.

    Columns are mol_id, src, dst and each of ``keep`` with a and b at its end. Places
    are cut into stretches of ``reach``; a point meets its own stretch and the next
    ones on both sides: an equi-join on (group, stretch), of 3 * reach rows at most a
    point however many points a group has.
    """
    placed = numbered(points.select("mol_id", *groups, "point_id", "key", *keep), ["key", "point_id"], "_at", F.floor(F.col("key") / SLAB).cast("long"), ("mol_id", *groups))
    placed = placed.withColumn("_f", F.floor(F.col("_at") / reach).cast("long"))
    side = lambda s, ident: [F.col("point_id").alias(ident), F.col("_at").alias(f"_at{s}"), *[F.col(c).alias(f"{c}{s}") for c in keep]]
    left = placed.select("mol_id", *groups, "_f", *side("a", "src"))
    right = placed.withColumn("_f", F.explode(F.array(F.col("_f") - 1, F.col("_f"), F.col("_f") + 1))).select("mol_id", *groups, "_f", *side("b", "dst"))
    met = left.join(right, ["mol_id", *groups, "_f"]).where((F.col("src") != F.col("dst")) & (F.abs(F.col("_ata") - F.col("_atb")) <= reach))
    return met.drop("_f", "_ata", "_atb", *groups)


def windowed_neighbours(points: DataFrame, k: int, reach: int | None = None) -> DataFrame:
    """(mol_id, src, dst, d, rank): nearest points among ``reach`` places before and after in spatial order.

    Approximate, with linear work: for point clouds too large for the exact self-join.
    """
    pairs = in_frames(spatial_key(points.select("mol_id", "point_id", *"xyz")), [], reach or max(64, 8 * k), list("xyz"))
    pairs = pairs.withColumn("d", F.expr(f"sqrt({dist2('a', 'b')})"))
    best = Window.partitionBy("mol_id", "src").orderBy("d", "dst")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("mol_id", "src", "dst", "d", "rank")


def even_picks(points: DataFrame, most: int) -> DataFrame:
    """At most ``most`` evenly spaced points of each molecule, by position; the picks are computed and joined."""
    numbered = points.withColumn("_at", (F.row_number().over(Window.partitionBy("mol_id").orderBy("point_id")) - 1).cast("long"))
    picks = points.groupBy("mol_id").agg(F.count("*").alias("_n")).withColumn("_m", F.least("_n", F.lit(most)))
    picks = picks.withColumn("_p", F.explode(F.expr("sequence(0L, _m - 1)"))).select("mol_id", F.expr("cast(rint(_p * cast(_n - 1 as double) / greatest(_m - 1, 1)) as bigint)").alias("_at")).distinct()
    return numbered.join(picks, ["mol_id", "_at"], "left_semi").drop("_at")


def farthest_points(points: DataFrame, most: int) -> DataFrame:
    """Greedy farthest-point picks of each molecule, from its first point on: (mol_id, point_id, pick)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        p = pdf[["x", "y", "z"]].to_numpy()
        chosen, gap = [0], ((p - p[0]) ** 2).sum(1)
        while len(chosen) < min(most, len(p)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((p - p[chosen[-1]]) ** 2).sum(1))
        return pd.DataFrame({"mol_id": pdf["mol_id"].iloc[0], "point_id": pdf["point_id"].to_numpy()[chosen], "pick": np.arange(len(chosen))})

    kind = points.schema["mol_id"].dataType.simpleString()
    return points.select("mol_id", "point_id", "x", "y", "z").groupBy("mol_id").applyInPandas(pick, f"mol_id {kind}, point_id long, pick int")


@F.pandas_udf(ArrayType(DoubleType()))
def eigenvalues(c: pd.Series) -> pd.Series:
    """Ascending, of symmetric 3 x 3 matrices given as (xx, yy, zz, xy, xz, yz)."""
    m = np.stack(c)
    full = m[:, [[0, 3, 4], [3, 1, 5], [4, 5, 2]]]
    return pd.Series(list(np.linalg.eigvalsh(full)))


def shape(atoms: DataFrame) -> DataFrame:
    """(mol_id, eigenvalues): of the coordinates' covariance. The moments are one aggregation; only a row a molecule reaches Python."""
    moment = lambda p, q: F.avg(F.col(p) * F.col(q)) - F.avg(p) * F.avg(q)
    return atoms.groupBy("mol_id").agg(F.array(*[moment(*pq) for pq in ("xx", "yy", "zz", "xy", "xz", "yz")]).alias("c")).select("mol_id", eigenvalues("c").alias("eigenvalues"))


def apportioned(weights: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, count) for rows of (mol_id, atom_idx, weight, total): each molecule's total in whole counts.

    Shares are rounded down, but a positive weight gets one at least. What lacks
    goes to the largest remainders; a surplus is taken from the smallest ones, never
    below one. So counts add up to the total, or to the number of positive weights
    where that is more. Without a positive weight the first atom gets all.
    """
    by = Window.partitionBy("mol_id")
    one = F.when(F.col("weight") > 0, 1).otherwise(0)
    share = F.when(F.col("mass") > 0, F.round(F.col("weight") / F.col("mass") * F.col("total"), 9)).when(F.col("place") == 1, F.col("total").cast("double")).otherwise(0.0)
    at = weights.withColumn("mass", F.sum("weight").over(by)).withColumn("place", F.row_number().over(by.orderBy("atom_idx"))).withColumn("share", share)
    at = at.withColumn("rest", F.col("share") - F.floor("share")).withColumn("base", F.when(F.col("total") <= 0, 0).otherwise(F.greatest(F.floor("share"), one)))
    at = at.withColumn("gap", F.greatest(F.col("total"), F.lit(0)) - F.sum("base").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("rest"), "atom_idx")))
    at = at.withColumn("spare", F.col("base") - F.when(F.col("base") > 0, one).otherwise(0))
    at = at.withColumn("before", F.sum("spare").over(by.orderBy("rest", "atom_idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("spare"))
    change = F.when((F.col("gap") > 0) & (F.col("rank") <= F.col("gap")), 1).when(F.col("gap") < 0, -F.least("spare", F.greatest(-F.col("gap") - F.col("before"), F.lit(0)))).otherwise(0)
    return at.select("mol_id", "atom_idx", (F.col("base") + change).cast("long").alias("count"))
