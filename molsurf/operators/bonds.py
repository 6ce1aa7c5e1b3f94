"""Bonds of a molecule from distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BOND_FACTOR, COVALENT
from ..functions.formulas import dist2
from .spatial import near


def bonds(atoms: DataFrame, factor: float = BOND_FACTOR) -> DataFrame:
    """(mol_id, a, b), a < b: atoms (mol_id, atom_idx, x, y, z, element) no farther apart than the factor times the sum of their covalent radii. Elements without a radius bond with nothing."""
    radius = F.lit(None).cast("double")
    for name, r in COVALENT.items():
        radius = F.when(F.upper("element") == name, r).otherwise(radius)
    known = atoms.withColumn("_r", radius).where("_r is not null")
    side = lambda s: known.select("mol_id", F.col("atom_idx").alias(s), *[F.col(c).alias(f"{c}{s}") for c in "xyz"], F.col("_r").alias(f"r{s}"))
    close = near(side("a"), side("b"), 2 * factor * max(COVALENT.values())).where("a < b")
    return close.where(f"sqrt({dist2('a', 'b')}) <= {factor}e0 * (ra + rb)").select("mol_id", "a", "b")
