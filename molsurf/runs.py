"""Benchmark runs of the samplers: molecules times variants times repeats, as records that the analytics read."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import outputs
from .operators.graph import GraphOptions
from .operators.store import checkpointed
from .plans import samplers as sm
from .sources.bench_json import RECORD, append_records, read_records
from .sources.structures import read_surfaces

METHODS = {
    "projected": lambda atoms, p: sm.projected(atoms, **({"m": 192} | p)),
    "analytic": lambda atoms, p: sm.analytic(atoms, sm.Density(**({"point_area": 0.5, "oversample": 1.0} | p))),
    "level_set": lambda atoms, p: sm.level_set(atoms, **({"m": 26, "smoothness": 0.2} | p)),
    "tiled": lambda atoms, p: sm.tiled(atoms, sm.Density(**({"point_area": 0.5, "oversample": 1.0} | p))),
}
#: What is taken of a sampler's output: points alone, or points and more.
INTERFACES = ("points", "features", "normals", "adjacency")


@dataclass(frozen=True)
class Variant:
    method: str
    params: dict = field(default_factory=dict)
    interface: str = "points"

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method}; known: {', '.join(METHODS)}")
        if self.interface not in INTERFACES:
            raise ValueError(f"unknown interface {self.interface}; known: {', '.join(INTERFACES)}")

    @property
    def name(self) -> str:
        return "__".join(f"{k}={v}" for k, v in sorted(self.params.items())) or "default"

    @property
    def key(self) -> str:
        """A hash of all that tells it from other variants."""
        return sha256(json.dumps([self.method, self.params, self.interface], sort_keys=True).encode()).hexdigest()[:16]


def variants(methods: Iterable[str], axes: dict[str, dict[str, list]] | None = None, interfaces: Iterable[str] = ("points",)) -> list[Variant]:
    """For each method and interface the default, then each value of its axes alone; equal ones once."""
    out = []
    for m in methods:
        for i in interfaces:
            out.append(Variant(m, {}, i))
            out += [Variant(m, {k: v}, i) for k, values in (axes or {}).get(m, {}).items() for v in values]
    return list({v.key: v for v in out}.values())


def measured(atoms: DataFrame, v: Variant, surfaces: DataFrame | None = None) -> dict:
    """One timed run of all given atoms, and what came out.

    The sampler is evaluated once. An interface adds what it asks for to the timed part: normals their columns, features
    the point-by-atom matrix, adjacency the graph. Statistics and reference metrics come after the clock has stopped.
    """
    began = time.perf_counter()
    got = METHODS[v.method](atoms, v.params)
    place = ["mol_id", "point_id", "x", "y", "z"]
    kept = {"points": place, "normals": [*place, "nx", "ny", "nz"], "features": [*place, "supports"], "adjacency": got.columns}[v.interface]
    got = checkpointed(got.select(*kept))
    more: dict = {}
    edges = None
    if v.interface == "features":
        more["feature_values"] = outputs.dense_features(got, atoms.withColumn("mol_id", F.col("mol_id").cast("string"))).agg(F.sum(F.size("features"))).first()[0] or 0
    elif v.interface == "adjacency":
        edges = checkpointed(sm.surface_graph(got, GraphOptions()))
    n = got.count()
    seconds = time.perf_counter() - began
    if v.interface == "features":
        more |= got.agg(F.avg(F.size("supports")).alias("supports_mean"), F.max(F.size("supports")).cast("long").alias("supports_max")).first().asDict()
    elif v.interface == "normals":
        off = F.abs(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) - 1)
        more |= got.agg(F.avg(off).alias("normal_error_mean"), F.max(off).alias("normal_error_max")).first().asDict()
    elif edges is not None:
        stats = outputs.output_stats(got, edges).agg(F.sum("edge_count").alias("edge_count"), F.avg("mean_degree").alias("mean_degree"), F.every("finite_weights").alias("finite_weights"), F.avg("supports_mean").alias("supports_mean"), F.max("supports_max").alias("supports_max"), F.avg("normal_error_mean").alias("normal_error_mean"), F.max("normal_error_max").alias("normal_error_max"))
        more |= stats.first().asDict()
    if surfaces is not None:
        metrics = sm.reference_metrics(got, surfaces).drop("mol_id").first()
        more["reference_metrics"] = metrics.asDict(recursive=True) if metrics else {"status": "no_points"}
    return {"status": "ok", "wall_seconds": seconds, "point_count": n, "points_per_wall_second": n / seconds if seconds else None} | more


def base_record(mol: str, v: Variant, repeat: int, version: str) -> dict:
    """What every record of a run says, however it went."""
    return {"event": "benchmark_result", "pdb_id": mol, "method": v.method, "variant_name": v.name, "method_variant_name": v.name, "method_parameter_hash": v.key, "interface_mode": v.interface, "repeat_index": repeat, "program_version": version, "method_params": {a: str(b) for a, b in v.params.items()}, "interface_params": {"mode": v.interface, "scenario_mode": "independent"}}


def appended(spark: SparkSession, records: list[dict], path: str) -> int:
    """Append records of runs that have just been timed."""
    if records:
        told = spark.createDataFrame([(json.dumps(r),) for r in records], "line string").select(F.from_json("line", RECORD).alias("r")).select("r.*")
        append_records(told.coalesce(1), path)
    return len(records)


def recorded(spark: SparkSession, path: str, version: str) -> set[tuple[str, str, int]]:
    """(molecule, variant, repeat) of the version's records at path."""
    try:
        done = read_records(spark, path).where(F.col("program_version") == version)
        return {(r["pdb_id"], r["method_parameter_hash"], r["repeat_index"]) for r in done.select("pdb_id", "method_parameter_hash", "repeat_index").collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return set()


def record_load_error(spark: SparkSession, name: str, error: Exception, todo: list[Variant], path: str, repeats: int = 1, version: str = "1") -> int:
    """A record with status load_error for every run of a structure that cannot be read, unless there is one."""
    mol = name.rstrip("/").rpartition("/")[2].removesuffix(".pdb")
    done = recorded(spark, path, version)
    rows = [base_record(mol, v, k, version) | {"status": "load_error", "error": str(error)[:500]} for v in todo for k in range(repeats) if (mol, v.key, k) not in done]
    return appended(spark, rows, path)


def run(spark: SparkSession, atoms: DataFrame, todo: list[Variant], path: str, repeats: int = 1, version: str = "1", most_atoms: int | None = None, surfaces: str | None = None) -> int:
    """Measure every molecule of atoms (mol_id, ...) under every variant, and append a record of each run to JSON lines at path.

    Runs are timed one at a time. What path already records for the version is not
    run again, so a stopped run goes on. A molecule of more than ``most_atoms``
    gets a record with status skipped, a run that raises one with status error
    and the message. surfaces: a folder of reference surfaces, ``<molecule>.ply``;
    records then say how far the points lie from them, or why not. Gives the
    number of new records.
    """
    known = checkpointed(read_surfaces(spark, surfaces)) if surfaces else None
    sizes = {str(r["mol_id"]): r["count"] for r in atoms.groupBy("mol_id").count().collect()}  # a row for each molecule to be timed
    done = recorded(spark, path, version)
    new = 0
    for mol in sorted(sizes):
        rows = []
        own = atoms.where(F.col("mol_id").cast("string") == mol)
        for v in todo:
            for k in range(repeats):
                if (mol, v.key, k) in done:
                    continue
                record = base_record(mol, v, k, version) | {"atom_count": sizes[mol]}
                if most_atoms is not None and sizes[mol] > most_atoms:
                    record |= {"status": "skipped"}
                else:
                    try:
                        record |= measured(own, v, None if known is None else known.where(F.col("mol_id") == mol))
                    except Exception as e:  # recorded, and the other runs go on
                        record |= {"status": "error", "error": str(e)[:500]}
                rows.append(record)
        new += appended(spark, rows, path)
    return new
