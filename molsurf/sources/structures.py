"""Readers and writers of structure files: PDB, NPY sets, ASCII PLY, and the demonstration molecules."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..config import DEMO_RADII, ELEMENTS, RADII
from ..operators.store import checkpointed

ATOMS = (
    "mol_id string, atom_idx int, x double, y double, z double, radius double, type_idx int, atom_serial long, residue_number long, chain_index long, model_index long, "
    "occupancy double, b_factor double, atom_name string, residue_name string, chain_id string, insertion_code string, element string, record string"
)
NAMES = [c.split()[0] for c in ATOMS.split(", ")]


def element_table(spark: SparkSession) -> DataFrame:
    """(element, type_idx, radius): six rows."""
    return spark.createDataFrame([(e, k, r) for k, (e, r) in enumerate(zip(ELEMENTS, RADII))], "element string, type_idx int, radius double")


def normalized_element(element: Column, atom_name: Column) -> Column:
    """Upper-cased; where blank, the name's first two letters if they are a known element, else its first."""
    given = F.upper(F.trim(element))
    letters = F.upper(F.regexp_replace(atom_name, "[^A-Za-z]", ""))
    return F.when(given != "", given).when(F.substring(letters, 1, 2).isin(*ELEMENTS), F.substring(letters, 1, 2)).otherwise(F.substring(letters, 1, 1))


def chain_filter(chains: str | Iterable[str] | None) -> list[str] | None:
    """A string of several characters is a set of one-character chains."""
    return None if chains is None else sorted(set(chains))


def read_pdb(spark: SparkSession, path: str, *, center: bool = False, chains: str | Iterable[str] | None = None, include_hetatm: bool = True, include_hydrogens: bool = True, altlocs: tuple[str, ...] = ("", "A", "1"), unknown: str = "error") -> DataFrame:
    """Atoms of all files under path (*.pdb, or one file), columns as in ATOMS; mol_id is the file's stem.

    Fixed-width columns of ATOM and HETATM lines become codegen'd substrings.
    Atoms are ordered by model, first line of chain and of residue, then line. An
    unknown element raises or is skipped. Files are read whole, one at a time,
    as a line's place matters; a structure file is a few megabytes.
    """
    if unknown not in ("error", "skip"):
        raise ValueError("unknown must be 'error' or 'skip'")
    lines = spark.read.text(path, wholetext=True, pathGlobFilter="*.pdb").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.pdb)?$", 1).alias("mol_id"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    model = F.sum(F.when(F.col("value").startswith("MODEL"), 1).otherwise(0)).over(Window.partitionBy("mol_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    record = F.trim(F.substring("value", 1, 6))
    rows = lines.withColumns({"model": F.greatest(model - 1, F.lit(0)), "record": record}).where(F.col("record").isin("ATOM", "HETATM"))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    num = lambda a, n, t: F.expr(f"try_cast(trim(substring(value, {a}, {n})) as {t})")
    rows = rows.select(
        "mol_id", "line", "model", "record", num(7, 5, "long").alias("serial"), cut(13, 4).alias("atom_name"), cut(17, 1).alias("altloc"), cut(18, 3).alias("residue_name"), cut(22, 1).alias("chain_id"), F.coalesce(num(23, 4, "long"), F.lit(0)).cast("long").alias("residue_number"),
        cut(27, 1).alias("insertion_code"), *[num(31 + 8 * k, 8, "float").cast("double").alias(c) for k, c in enumerate("xyz")], F.coalesce(num(55, 6, "double"), F.lit(1.0)).alias("occupancy"), F.coalesce(num(61, 6, "double"), F.lit(0.0)).alias("b_factor"), normalized_element(F.substring("value", 77, 2), cut(13, 4)).alias("element"),
    ).where(F.col("altloc").isin(*altlocs))
    if (kept := chain_filter(chains)) is not None:
        rows = rows.where(F.col("chain_id").isin(*kept))
    if not include_hetatm:
        rows = rows.where("record <> 'HETATM'")
    if not include_hydrogens:
        rows = rows.where(~F.col("element").isin("H", "D"))
    known = F.array_position(F.array(*map(F.lit, ELEMENTS)), F.col("element"))
    if unknown == "skip":
        rows = rows.where(known > 0)
    kind = F.when(known > 0, known - 1).otherwise(F.raise_error(F.concat(F.lit("unknown element "), "element"))).cast("int")
    m = Window.partitionBy("mol_id")
    first_chain = F.min("line").over(Window.partitionBy("mol_id", "chain_id"))
    rows = rows.withColumns({"_chain": first_chain, "_own": F.min("line").over(Window.partitionBy("mol_id", "model", "chain_id")), "_residue": F.min("line").over(Window.partitionBy("mol_id", "model", "chain_id", "residue_number", "insertion_code", "residue_name"))})
    index = F.row_number().over(m.orderBy("model", "_own", "_residue", "line"))
    rows = rows.withColumns({"atom_idx": (index - 1).cast("int"), "chain_index": (F.dense_rank().over(m.orderBy("_chain")) - 1).cast("long"), "type_idx": kind, "model_index": F.col("model").cast("long")})
    rows = rows.withColumns({"atom_serial": F.coalesce(F.nullif("serial", F.lit(0)), (F.col("atom_idx") + 1).cast("long")), "radius": F.element_at(F.array(*map(F.lit, RADII)), F.col("type_idx") + 1)})
    if center:
        rows = rows.withColumns({c: F.col(c) - F.avg(c).over(m) for c in "xyz"})
    return rows.select(*NAMES)


def atom_counts(spark: SparkSession, path: str, hetatm: bool = True, hydrogens: bool = True) -> DataFrame:
    """(mol_id, atoms, bytes) of structure files by their lines alone, for ordering and sharding."""
    lines = spark.read.text(path, pathGlobFilter="*.pdb").select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.pdb)?$", 1).alias("mol_id"), F.col("_metadata.file_size").alias("bytes"), "value")
    own = F.col("value").rlike("^(ATOM  |HETATM)" if hetatm else "^ATOM  ")
    if not hydrogens:
        own = own & ~normalized_element(F.substring("value", 77, 2), F.trim(F.substring("value", 13, 4))).isin("H", "D")
    return lines.groupBy("mol_id").agg(F.count_if(own).alias("atoms"), F.max("bytes").alias("bytes"))


# The files of an NPY set and their columns.
NPY = {
    "atomtype_indices": "type_idx", "atomradii": "radius", "atomserials": "atom_serial", "residue_numbers": "residue_number", "chain_indices": "chain_index", "model_indices": "model_index", "occupancy": "occupancy", "bfactors": "b_factor",
    "atomnames": "atom_name", "residue_names": "residue_name", "chain_ids": "chain_id", "insertion_codes": "insertion_code", "elements": "element", "records": "record",
}
FILE = re.compile(r"^(.*)_(atomxyz|atomtypes|" + "|".join(NPY) + r")\.npy$")
REQUIRED = ("atomxyz", "atomtypes")


def npy_bytes(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


def to_npy(atoms: DataFrame, metadata: bool = True) -> DataFrame:
    """(name, content): the files of each molecule's NPY set. Blank string columns are left out."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("atom_idx")
        mol = pdf["mol_id"].iloc[0]
        sets = {"atomxyz": pdf[["x", "y", "z"]].to_numpy(np.float32), "atomtypes": np.eye(len(ELEMENTS), dtype=np.float32)[pdf["type_idx"]]}
        for suffix, c in NPY.items():
            v = pdf[c].to_numpy()
            if v.dtype == object:
                if metadata and any(v):
                    sets[suffix] = v.astype(str)
            else:
                sets[suffix] = v.astype(np.float32 if v.dtype.kind == "f" else np.int64)
        return pd.DataFrame({"name": [f"{mol}_{s}.npy" for s in sets], "content": [npy_bytes(v) for v in sets.values()]})

    return atoms.select(*NAMES).groupBy("mol_id").applyInPandas(pack, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files of a folder, which may stand on any file system that Arrow knows, from the tasks that hold them.

    A task writes under a name of its own attempt and moves each file in place once it is whole, so a task that is lost or
    runs twice leaves whole files only; the job's end clears what lost attempts left, and marks the folder with ``_SUCCESS``.
    Other file systems are written through the driver, a partition at a time.
    """
    spark = files.sparkSession
    try:
        store_of(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return through_driver(files, folder)
    spark.dataSource.register(NamedFiles)
    files.select(F.col("name").cast("string"), F.col("content").cast("binary")).write.format(NamedFiles.name()).option("folder", folder).mode("append").save()


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


class NamedFiles(DataSource):
    """A sink for (name, content) rows."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["folder"])


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def waiting(self, top: str) -> str:
        return f"{top}/_temporary_{self.job}"

    def write(self, rows) -> Written:
        store, top = store_of(self.folder)
        context = TaskContext.get()
        own = f"{self.waiting(top)}/{context.partitionId()}_{context.taskAttemptId()}"
        store.create_dir(own, recursive=True)
        n = 0
        for n, row in enumerate(rows, 1):
            with store.open_output_stream(f"{own}/{row['name']}") as out:
                out.write(row["content"])
            store.move(f"{own}/{row['name']}", f"{top}/{row['name']}")
        return Written(n)

    def commit(self, messages) -> None:
        self.clear()
        store, top = store_of(self.folder)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self.clear()

    def clear(self) -> None:
        store, top = store_of(self.folder)
        if store.get_file_info(self.waiting(top)).type == fs.FileType.Directory:
            store.delete_dir(self.waiting(top))


def through_driver(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows by Hadoop's file system; the driver streams one partition at a time."""
    vm, conf = files.sparkSession._jvm, files.sparkSession._jsc.hadoopConfiguration()
    top = vm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(conf)
    store.mkdirs(top)
    for r in files.toLocalIterator():
        out = store.create(vm.org.apache.hadoop.fs.Path(top, r["name"]), True)
        out.write(bytearray(r["content"]))
        out.close()


def read_npy(spark: SparkSession, folder: str, *, center: bool = False) -> DataFrame:
    """Atoms of all NPY sets in a folder; only coordinates and types are required, others get defaults."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(name.alias("name"), "content").withColumn("mol_id", F.regexp_extract("name", FILE.pattern, 1)).withColumn("suffix", F.regexp_extract("name", FILE.pattern, 2)).where("suffix <> ''")

    def unpack(pdf: pd.DataFrame) -> pd.DataFrame:
        mol = pdf["mol_id"].iloc[0]
        sets = {s: np.load(io.BytesIO(c), allow_pickle=False) for s, c in zip(pdf["suffix"], pdf["content"])}
        for s in REQUIRED:
            if s not in sets:
                raise FileNotFoundError(f"{mol}_{s}.npy")
        n = len(sets["atomxyz"])
        kind = sets["atomtypes"].argmax(1)
        default = {"type_idx": kind, "radius": np.array(RADII)[kind], "atom_serial": np.arange(1, n + 1), "residue_number": np.zeros(n, int), "chain_index": np.zeros(n, int), "model_index": np.zeros(n, int), "occupancy": np.ones(n), "b_factor": np.zeros(n)}
        default |= {c: np.full(n, "", object) for c in ("atom_name", "residue_name", "chain_id", "insertion_code", "record")} | {"element": np.array(ELEMENTS, object)[kind]}
        got = {c: sets[s] if s in sets else default[c] for s, c in NPY.items()}
        out = pd.DataFrame({"mol_id": mol, "atom_idx": np.arange(n), **dict(zip("xyz", sets["atomxyz"].astype(float).T)), **got})
        for c in ("atom_name", "residue_name", "chain_id", "insertion_code", "element", "record"):
            out[c] = out[c].astype(str)
        return out[NAMES]

    atoms = files.groupBy("mol_id").applyInPandas(unpack, ATOMS)
    return atoms.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy("mol_id")) for c in "xyz"}) if center else atoms


#: Other names of the columns of atoms.
ALIASES = {"xyz": ("atom_coords",), "types": ("atom_types",), "radius": ("radii", "atom_radii"), "type_idx": ("atom_type_indices",), "atom_serial": ("atom_serials",), "residue_number": ("residue_numbers",), "chain_index": ("chain_indices",), "model_index": ("model_indices",), "b_factor": ("b_factors",)}


def atoms_of(given: DataFrame) -> DataFrame:
    """Atoms with all columns of ``ATOMS``, of a table that has some of them, or names them otherwise.

    Needed are mol_id, atom_idx, a place (x, y and z, or an array xyz) and a kind (type_idx, an array types with one entry
    for each element, or element). The rest gets defaults: radii by kind, serials from 1, zeros, full occupancy, empty names.
    """
    have = set(given.columns)
    for name, others in ALIASES.items():
        other = next((o for o in others if o in have), None)
        if name not in have and other:
            given = given.withColumnRenamed(other, name)
            have |= {name}
    missing = [n for n, ok in (("mol_id", "mol_id" in have), ("atom_idx", "atom_idx" in have), ("x, y and z or xyz", {"x", "y", "z"} <= have or "xyz" in have), ("type_idx, types or element", have & {"type_idx", "types", "element"})) if not ok]
    if missing:
        raise ValueError(f"atoms need {', '.join(missing)}")
    place = {c: F.col(c) if c in have else F.element_at("xyz", k + 1) for k, c in enumerate("xyz")}
    known = F.array(*map(F.lit, ELEMENTS))
    if "type_idx" in have:
        kind = F.col("type_idx")
    elif "types" in have:  # the first of the largest
        kind = F.array_position(F.transform("types", lambda t: t.cast("double")), F.array_max(F.transform("types", lambda t: t.cast("double")))) - 1
    else:
        kind = F.when(F.array_contains(known, F.upper(F.trim("element"))), F.array_position(known, F.upper(F.trim("element"))) - 1)
    kind = F.when(kind.isNull() | ~kind.between(0, len(ELEMENTS) - 1), F.raise_error(F.concat(F.lit("unknown kind of an atom of "), F.col("mol_id").cast("string")))).otherwise(kind).cast("int")
    out = given.withColumns({**place, "type_idx": kind})
    radius = F.element_at(F.array(*map(F.lit, RADII)), F.col("type_idx") + 1)
    default = {"radius": radius, "atom_serial": F.col("atom_idx") + 1, "occupancy": F.lit(1.0), "element": F.element_at(known, F.col("type_idx") + 1)} | {c: F.lit(0) for c in ("residue_number", "chain_index", "model_index")} | {"b_factor": F.lit(0.0)} | {c: F.lit("") for c in ("atom_name", "residue_name", "chain_id", "insertion_code", "record")}
    kinds = [c.split() for c in ATOMS.split(", ")]
    return out.select(*[(F.coalesce(F.col(c), default[c]) if c in have and c in default else F.col(c) if c not in default else default[c]).cast(t).alias(c) for c, t in kinds])


def convert_pdbs(spark: SparkSession, pdb_folder: str, npy_folder: str, metadata: bool = True) -> DataFrame:
    """All structure files of a folder into NPY sets; gives the atoms."""
    atoms = checkpointed(read_pdb(spark, pdb_folder))  # read once, for the files and for the result
    write_files(to_npy(atoms, metadata), npy_folder)
    return atoms


def read_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """(mol_id, status, error, vertices array<struct<x, y, z>>): the ASCII PLY files of a folder; status is ok, or load_error with what is wrong."""
    text = spark.read.option("pathGlobFilter", "*.ply").text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.ply)?$", 1).alias("mol_id"), F.col("value").alias("v"))
    count = F.regexp_extract("v", r"element vertex (\d+)", 1)
    body = F.slice(F.split(F.trim(F.element_at(F.split("v", "end_header\r?\n", 2), 2)), "\r?\n"), 1, F.greatest(F.col("n"), F.lit(0)))
    number = lambda row, k: F.try_element_at(F.split(F.trim(row), r"\s+"), F.lit(k + 1)).try_cast("double")
    read = text.withColumn("n", F.coalesce(count.try_cast("int"), F.lit(-1))).withColumn("rows", F.when(F.col("v").contains("end_header") & (F.col("n") >= 0), body))
    read = read.withColumn("vertices", F.transform("rows", lambda row: F.struct(*[number(row, k).alias(c) for k, c in enumerate("xyz")])))
    bad = F.exists("vertices", lambda p: p["x"].isNull() | p["y"].isNull() | p["z"].isNull())
    error = (
        F.when(~F.col("v").startswith("ply") | ~F.col("v").contains("format ascii"), "not an ASCII PLY file")
        .when(F.col("rows").isNull(), "no vertex element or end of the header")
        .when((F.size("rows") < F.col("n")) | bad, "a vertex is missing or no number")
    )
    read = read.withColumn("error", error)
    return read.select("mol_id", F.when(F.col("error").isNull(), "ok").otherwise("load_error").alias("status"), "error", F.when(F.col("error").isNull(), F.col("vertices")).alias("vertices"))


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(mol_id, point_id, x, y, z): vertices of ASCII PLY files."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.ply)?$", 1).alias("mol_id"), "value")
    count = F.regexp_extract("value", r"element vertex (\d+)", 1).cast("int")
    body = F.split(F.trim(F.element_at(F.split("value", "end_header\r?\n", 2), 2)), "\r?\n")
    rows = text.where(F.col("value").startswith("ply") & F.col("value").contains("format ascii")).select("mol_id", F.posexplode(F.slice(body, 1, count)).alias("point_id", "v"))
    v = F.split(F.trim("v"), r"\s+")
    return rows.select("mol_id", F.col("point_id").cast("long"), *[v[k].cast("double").alias(c) for k, c in enumerate("xyz")])


def tetrahedron() -> np.ndarray:
    return np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]]) / np.sqrt(3)


def ring(n: int, radius: float, z: np.ndarray | float = 0.0, turn: float = 0.0) -> np.ndarray:
    a = 2 * np.pi * np.arange(n) / n + turn
    return np.stack((radius * np.cos(a), radius * np.sin(a), np.broadcast_to(z, n)), 1)


def along(heavy: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Hydrogens one C-H bond (1.09) away in the directions."""
    return heavy + 1.09 * direction / np.linalg.norm(direction, axis=1, keepdims=True)


def flat(p: np.ndarray, z: np.ndarray | float = 0.0) -> np.ndarray:
    """The in-plane part of points, with heights z."""
    out = p.copy()
    out[:, 2] = z
    return out


def joined(*parts: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
    """Parts of (element for all, or elements in words; coordinates)."""
    words = [w for e, p in parts for w in (e.split() if " " in e else [e] * len(p))]
    return " ".join(words), np.vstack([p for _, p in parts])


def carbon_cage(shells: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
    """Carbons, each with a hydrogen in its direction."""
    return [x for c, d in shells for x in (("C", c), ("H", along(c, d)))]


def demo_molecules() -> dict[str, tuple[str, np.ndarray]]:
    """name -> (elements, coordinates): small molecules, and rings and cages for trying accessibility."""
    # Coordinates of water, carbon dioxide, ammonia, ethanol and methionine.
    out = {
        "H2O": ("O H H", np.array([[0, 0, 0], [0.9572, 0, 0], [-0.2390, 0.9270, 0]])),
        "CO2": ("O C O", np.array([[-1.16, 0, 0], [0, 0, 0], [1.16, 0, 0]])),
        "NH3": ("N H H H", np.array([[0, 0, 0], [0.94, 0, -0.36], [-0.47, 0.8141, -0.36], [-0.47, -0.8141, -0.36]])),
        "Ethanol": ("C C O H H H H H H", np.array([[0, 0, 0], [1.52, 0, 0], [2.12, 1.21, 0], [-0.54, 0.93, 0], [-0.54, -0.465, 0.805], [-0.54, -0.465, -0.805], [1.91, -0.52, 0.89], [1.91, -0.52, -0.89], [2.95, 1.1, 0]])),
        "Methionine": (
            "N C C O O C C S C H H H H H H H H H H H",
            np.array([
                [0, 0, 0], [1.45, 0, 0], [2.15, 1.25, 0], [1.64, 2.33, 0], [3.37, 1.22, 0], [2.25, -1.2, 0], [3.78, -1.08, 0], [4.46, -2.72, 0], [6.18, -2.46, 0], [-0.34, 0.54, 0.81],
                [-0.34, 0.54, -0.81], [1.7, 0.02, 1.04], [2.01, -2.16, 0.44], [2.01, -1.26, -1.03], [4.16, -0.5, 0.84], [4.16, -0.5, -0.84], [6.52, -1.43, 0], [6.52, -2.96, 0.88], [6.52, -2.96, -0.88], [3.79, 1.97, 0],
            ]),
        ),
    }
    # Radii, heights and waves of the rings and cages.
    out["CH4"] = joined(("C", np.zeros((1, 3))), ("H", 1.09 * tetrahedron()))
    out["Benzene"] = joined(("C", ring(6, 1.39)), ("H", ring(6, 2.48)))
    left, right = ring(6, 1.4, turn=np.pi / 6), ring(6, 1.4, turn=np.pi / 6) + [1.4 * np.sqrt(3), 0, 0]
    outer = [1, 2, 3, 4], [0, 1, 4, 5]
    out["Naphthalene"] = joined(("C", left), ("C", right[outer[1]]), ("H", along(left[outer[0]], left[outer[0]])), ("H", along(right[outer[1]], (right - [1.4 * np.sqrt(3), 0, 0])[outer[1]])))
    chair = ring(6, 1.34, 0.38 * np.array([1, -1, 1, -1, 1, -1]))
    up = np.sign(chair[:, 2])
    out["Cyclohexane chair"] = joined(("C", chair), ("H", along(chair, flat(0 * chair, up))), ("H", along(chair, flat(chair / 1.34, -0.25 * up))))
    turn = 2 * np.pi * np.arange(20) / 20
    pore = ring(20, 4.35, 0.08 * np.sin(4 * turn))
    out["Porphyrin pore"] = joined((" ".join("N" if k % 5 == 0 else "C" for k in range(20)), pore), ("H", along(pore, flat(pore))[np.arange(20) % 5 > 0]))
    turn = 2 * np.pi * np.arange(18) / 18
    crown = ring(18, 4.08, 0.28 * np.sin(3 * turn))
    side, tangent, lift = flat(crown) / 4.08, np.stack((-np.sin(turn), np.cos(turn), 0 * turn), 1), 0.45 * (-1.0) ** np.arange(18)
    carbons = np.arange(18) % 3 > 0
    out["18-Crown-6 cavity"] = joined((" ".join("C" if c else "O" for c in carbons), crown), *[("H", along(crown, flat(0.85 * side + h * 0.25 * tangent, h * lift))[carbons]) for h in (1, -1)])
    out["Octahedral probe cage"] = joined(("C", 3.0 * np.vstack((np.eye(3), -np.eye(3)))))
    golden = (1 + np.sqrt(5)) / 2
    shell = np.array([np.roll([0, a, b * golden], k) for a in (-1, 1) for b in (-1, 1) for k in range(3)])
    shell = 3.25 * shell / np.linalg.norm(shell, axis=1, keepdims=True)
    out["Closed carbon shell"] = joined(("C", shell), ("H", along(shell, shell)))
    walls = [ring(12, 3.35, z) for z in (-2.15, 0.0, 2.15)]
    caps = [ring(4, 1.55, z) for z in (-3.85, 3.85)]
    out["Sealed nanotube capsule"] = joined(*carbon_cage([(w, flat(w, 0.25 * np.sign(w[:, 2]))) for w in walls] + [(c, flat(c / 1.55, np.sign(c[:, 2]))) for c in caps]), ("C", np.array([[0, 0, -3.85], [0, 0, 3.85]])))
    rings = [np.roll(ring(10, r, x + dx), 1, 1) for x in (-2.35, 2.35) for dx, r in ((-1.25, 2.65), (0.0, 3.05), (1.25, 2.65))]
    outward = lambda p: np.hstack((0.25 * np.sign(p[:, :1]), p[:, 1:]))
    # The chain of hexane, the ring of glucose.
    chain = np.array([[0, 0, 0], [1.54, 0, 0], [2.31, 1.334, 0], [3.85, 1.334, 0], [4.62, 0, 0], [6.16, 0, 0]])
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    open_side = unit(2 * chain[1:-1] - chain[:-2] - chain[2:])  # away from both neighbours
    ends = []
    for own, other in ((0, 1), (5, 4)):  # three hydrogens around the bond's axis
        axis = unit(chain[other] - chain[own])
        side = np.cross(axis, [0, 0, 1.0])
        around = ring(3, 1.0)[:, :2] @ np.stack((side, np.cross(side, axis)))
        ends.append(along(np.tile(chain[own], (3, 1)), np.sqrt(8) / 3 * around - axis / 3))
    out["C6H14"] = joined(("C", chain), ("H", np.vstack(ends)), *[("H", along(chain[1:-1], flat(0.55 * open_side, z))) for z in (0.83, -0.83)])
    sugar = np.array([[1.25, 0.00, 0.35], [0.62, 1.08, -0.35], [-0.62, 1.08, 0.35], [-1.25, 0.00, -0.35], [-0.62, -1.08, 0.35], [0.62, -1.08, -0.35]])
    side, lift = unit(flat(sugar[1:])), np.array([1, -1, 1, -1, -1])  # of the five carbons; the last one carries the sixth
    hydroxyl = unit(flat(side[:4], 0.35 * lift[:4]))
    sixth = sugar[5] + 1.52 * unit(flat(side[4:], -0.15))
    last = unit(flat(side[4:], 0.75))
    across = np.array([[-side[4, 1], side[4, 0], 0.45]])
    alcohols = np.vstack((sugar[1:5] + 1.43 * hydroxyl, sixth + 1.43 * last))
    out["Glucose chair"] = joined(("O C C C C C", sugar), ("O", alcohols), ("C", sixth), ("H", along(sugar[1:], flat(-0.45 * side, 0.9 * lift))), ("H", along(np.vstack((sixth, sixth)), np.vstack((across, -across)))), ("H", alcohols + 0.96 * np.vstack((hydroxyl, last))))
    panels, hydrogens, bridges, links = [], [], [], []
    for quarter in range(4):
        frame = lambda turn: (np.array([np.cos(turn), np.sin(turn), 0.0]), np.array([-np.sin(turn), np.cos(turn), 0.0]))
        (radial, tangent), (between, around) = frame(quarter * np.pi / 2), frame((quarter + 0.5) * np.pi / 2)
        hexagon = ring(6, 1.39)[:, :2] @ np.stack((tangent, unit(np.array([0, 0, 1.0]) + 0.45 * radial))) + 2.65 * radial + [0, 0, 0.25]
        panels.append(hexagon)
        hydrogens.append(along(hexagon, flat(np.tile(radial, (6, 1)), 0.12 * hexagon[:, 2])))
        bridges.append(1.55 * between + [0, 0, -1.35])
        links.append(along(np.tile(bridges[-1], (2, 1)), flat(-0.35 * between + np.outer([0.55, -0.55], around), -0.75)))
    out["Calixarene bowl"] = joined(("C", np.vstack(panels)), ("H", np.vstack(hydrogens)), ("C", np.array(bridges)), ("H", np.vstack(links)))
    decks = [ring(12, 3.0, z) for z in (-1.35, 1.35)]
    oxygen = np.arange(12) % 4 == 0
    arms = ring(12, 3.0)[[2, 6, 10]]
    tangents = np.stack((-arms[:, 1], arms[:, 0], 0 * arms[:, 0]), 1) / 3
    out["Cryptand cage"] = joined(
        *[(" ".join("O" if o else "C" for o in oxygen), d) for d in decks], *[("H", along(d, flat(flat(d) / 3, 0.25 * np.sign(d[:, 2])))[~oxygen]) for d in decks],
        ("C", arms), *[("H", along(arms, arms / 3 + turn * tangents)) for turn in (0.55, -0.55)],
    )
    out["Double chamber cage"] = joined(*carbon_cage([(p, outward(p)) for p in rings]), ("N", np.roll(ring(8, 1.75), 1, 1)))
    return out


def read_demo(spark: SparkSession, name: str | None = None) -> DataFrame:
    """(mol_id, atom_idx, element, x, y, z, radius) of one demonstration molecule, or of all."""
    known = demo_molecules()
    if name is not None and name not in known:
        raise ValueError(f"unknown molecule {name!r}; known are {', '.join(sorted(known))}")
    rows = [(m, k, e, *map(float, p), DEMO_RADII[e]) for m in ([name] if name else sorted(known)) for k, (e, p) in enumerate(zip(known[m][0].split(), known[m][1]))]
    return spark.createDataFrame(rows, "mol_id string, atom_idx int, element string, x double, y double, z double, radius double")
