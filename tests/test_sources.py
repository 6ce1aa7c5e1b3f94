import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from molsurf.operators import bench
from molsurf.sources import bench_json
from molsurf.sources import structures as st
from molsurf.streaming.records import compare_as_it_arrives, stream_records


def line(record, serial, name, x, y=0.0, z=0.0, element="", altloc="", chain="A", residue=1):
    return f"{record:<6}{serial:>5} {name:^4}{altloc:1}{'ALA':>3} {chain}{residue:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{0:6.2f}          {element:>2}"


@pytest.fixture
def pdb(tmp_path):
    def write(name, *lines):
        (tmp_path / f"{name}.pdb").write_text("\n".join(lines) + "\nEND\n")
        return str(tmp_path / f"{name}.pdb")

    return write


def test_filters_and_centre(spark, pdb):
    path = pdb("small", line("ATOM", 1, "C", 0, element="C"), line("ATOM", 2, "N", 2, element="N"), line("HETATM", 3, "O", 10, element="O"))
    got = st.read_pdb(spark, path, center=True, include_hetatm=False).orderBy("atom_idx").collect()
    assert [(r["x"], r["element"], r["radius"]) for r in got] == [(-1.0, "C", 1.7), (1.0, "N", 1.55)]
    assert got[0]["mol_id"] == "small"


def test_alternatives_elements_and_chains(spark, pdb):
    path = pdb("alt", line("ATOM", 1, "CA", 0, altloc="A"), line("ATOM", 2, "CA", 1, altloc="B"), line("ATOM", 3, "SE", 5, chain="B"))
    assert [r["x"] for r in st.read_pdb(spark, path, altlocs=("B",)).collect()] == [1.0]
    assert {r["element"] for r in st.read_pdb(spark, path).collect()} == {"C", "SE"}
    assert st.read_pdb(spark, path, chains="BX").count() == 1


def test_unknown_elements(spark, pdb):
    path = pdb("zinc", line("ATOM", 1, "C", 0, element="C"), line("HETATM", 2, "ZN", 1, element="ZN"))
    assert st.read_pdb(spark, path, unknown="skip").count() == 1
    with pytest.raises(Exception, match="unknown element ZN"):
        st.read_pdb(spark, path).collect()
    with pytest.raises(ValueError):
        st.read_pdb(spark, path, unknown="x")


def test_npy_round_trip_and_defaults(spark, pdb, tmp_path):
    pdb("one", line("ATOM", 7, "C", 0.125, element="C"), line("ATOM", 8, "O", 2.5, element="O"))
    out = str(tmp_path / "npy")
    atoms = st.convert_pdbs(spark, str(tmp_path), out)
    back = st.read_npy(spark, out)
    assert sorted(map(str, atoms.drop("radius").collect())) == sorted(map(str, back.drop("radius").collect()))
    legacy = tmp_path / "legacy"
    legacy.mkdir()
    np.save(legacy / "m_atomxyz.npy", np.zeros((2, 3), np.float32))
    np.save(legacy / "m_atomtypes.npy", np.eye(6, dtype=np.float32)[[1, 3]])
    got = st.read_npy(spark, str(legacy)).orderBy("atom_idx").collect()
    assert [(r["atom_serial"], r["occupancy"], r["element"], r["radius"]) for r in got] == [(1, 1.0, "H", 1.1), (2, 1.0, "N", 1.55)]


def test_files_are_written_by_tasks(spark, tmp_path):
    """Whole files only, whichever attempt wrote them; the driver holds none."""
    out = tmp_path / "files"
    rows = [(f"f{k}.bin", bytes([k]) * (k + 1)) for k in range(40)]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    for _ in range(2):  # a second time over the same names
        st.write_files(files, str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted([*(n for n, _ in rows), "_SUCCESS"])
    assert all((out / n).read_bytes() == c for n, c in rows)
    with pytest.raises(Exception, match="no file"):
        st.write_files(files.withColumn("content", F.when(F.col("name") == "f7.bin", F.raise_error(F.lit("no file")).cast("binary")).otherwise(F.col("content"))), str(tmp_path / "bad"))
    bad = tmp_path / "bad"
    assert not bad.exists() or all(p.name != "_SUCCESS" and not p.name.startswith("_temporary") for p in bad.iterdir())
    st.through_driver(files, str(tmp_path / "own"))
    assert all((tmp_path / "own" / n).read_bytes() == c for n, c in rows)


def test_atoms_by_other_names_and_with_defaults(spark):
    by_arrays = spark.createDataFrame([("m", 0, [1.0, 2.0, 3.0], [0, 0, 0, 1, 0, 0], None), ("m", 1, [0.0, 0.0, 0.5], [1, 0, 0, 0, 0, 0], 9.0)], "mol_id string, atom_idx int, atom_coords array<double>, atom_types array<int>, radii double")
    a, b = st.atoms_of(by_arrays).orderBy("atom_idx").collect()
    assert (a["x"], a["z"], a["type_idx"], a["element"], a["radius"], a["atom_serial"], a["occupancy"], a["record"]) == (1.0, 3.0, 3, "N", 1.55, 1, 1.0, "")
    assert (b["radius"], b["atom_serial"]) == (9.0, 2)
    plain = spark.createDataFrame([("m", 0, 1.0, 2.0, 3.0, " se ")], "mol_id string, atom_idx int, x double, y double, z double, element string")
    assert st.atoms_of(plain).first()["type_idx"] == 5 and st.atoms_of(plain).columns == st.NAMES
    with pytest.raises(Exception, match="unknown kind"):
        st.atoms_of(plain.withColumn("element", F.lit("ZN"))).collect()
    with pytest.raises(ValueError, match="x, y and z or xyz"):
        st.atoms_of(plain.drop("z"))


def test_demonstration_molecules(spark):
    """All nineteen: formulas, and no two atoms in one place."""
    known = st.demo_molecules()
    formula = {m: {x: e.split().count(x) for x in sorted(set(e.split()))} for m, (e, _) in known.items()}
    assert len(known) == 19
    assert formula["C6H14"] == {"C": 6, "H": 14}
    bonds = np.linalg.norm(known["C6H14"][1][:6, None] - known["C6H14"][1][6:], axis=2)
    assert np.allclose(bonds.min(0), 1.09) and sorted((bonds < 1.1).sum(1)) == [2, 2, 2, 2, 3, 3]
    assert formula["Methionine"] == {"C": 5, "H": 11, "N": 1, "O": 2, "S": 1}
    assert formula["Glucose chair"] == {"C": 6, "H": 12, "O": 6}
    assert formula["Calixarene bowl"] == {"C": 28, "H": 32} and formula["Cryptand cage"] == {"C": 21, "H": 24, "O": 6}
    for e, p in known.values():
        d = np.linalg.norm(p[:, None] - p, axis=2)
        assert len(e.split()) == len(p) and d[~np.eye(len(p), dtype=bool)].min() > 0.3


def test_ply(spark, tmp_path):
    (tmp_path / "s.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nelement face 0\nend_header\n0 0.5 1\n1 2 3\n")
    assert [(r["x"], r["y"], r["z"]) for r in st.read_ply(spark, str(tmp_path / "s.ply")).orderBy("point_id").collect()] == [(0.0, 0.5, 1.0), (1.0, 2.0, 3.0)]


def record(pdb_id, seconds, points, variant="default", **more):
    return {"event": "benchmark_result", "status": "ok", "pdb_id": pdb_id, "method": "sdf", "method_variant_name": variant, "method_parameter_hash": variant, "interface_mode": "points", "wall_seconds": seconds, "point_count": points, "repeat_index": 0, "program_version": "1", "profiling": {"internal_profile_enabled": False, "torch_profile_enabled": False}} | more


def write(path, *records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def test_compare(spark, tmp_path):
    base = bench_json.read_records(spark, write(tmp_path / "b.jsonl", record("1ABC_A", 1.0, 100), record("2DEF_A", 2.0, 200), {"event": "start"}))
    now = bench_json.read_records(spark, write(tmp_path / "c.jsonl", record("1ABC_A", 1.3, 100), record("2DEF_A", 1.8, 240)))
    c = bench.compare(bench.normalized(base), bench.normalized(now))
    assert c.count() == 2
    assert [r["pdb_id"] for r in bench.top(c, "regression").collect()] == ["1ABC_A"]
    assert c.where("improvement").count() == 1 and c.where("points_changed").count() == 1


def test_sweep(spark, tmp_path):
    rows = bench_json.read_records(spark, write(tmp_path / "s.jsonl", record("a", 2.0, 1), record("a", 1.0, 1, "m=160"), record("a", 3.0, 1, "m=320")))
    got = bench.sweep(bench.normalized(rows)).orderBy("wall_seconds").collect()
    assert [(r["variant"], r["speedup_vs_default"]) for r in got] == [("m=160", 2.0), ("default", 1.0), ("m=320", 2.0 / 3.0)]


def test_profiled_runs_count_only_where_alone(spark, tmp_path):
    on = {"profiling": {"internal_profile_enabled": True, "torch_profile_enabled": False}}
    rows = bench_json.read_records(spark, write(tmp_path / "p.jsonl", record("a", 9.0, 1, **on), record("a", 1.0, 1), record("b", 5.0, 1, **on)))
    assert {r["pdb_id"]: r["wall_seconds"] for r in bench.case_medians(bench.normalized(rows)).collect()} == {"a": 1.0, "b": 5.0}


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        bench_json.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_stream_drops_repeated_runs_and_compares(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "1.json", record("a", 1.3, 100), record("a", 7.0, 100))
    base = bench_json.read_records(spark, write(tmp_path / "b.json", record("a", 1.0, 100)))
    q = compare_as_it_arrives(stream_records(spark, str(folder)), base, str(tmp_path / "h"), str(tmp_path / "r"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1
    assert spark.read.parquet(str(tmp_path / "r")).where("regression").count() <= 1


def test_three_grains_in_one_pass(spark, tmp_path):
    rows = bench_json.read_records(spark, write(tmp_path / "g.jsonl", record("a", 1.0, 10), record("b", 3.0, 10), record("c", 9.0, 10, "x", interface_mode="normals"), record("d", 5.0, 1, status="error")))
    got = {(r["grain"], r["variant_name"], r["interface_mode"]): (r["ok"], r["wall_seconds"]["median"]) for r in bench.summarize(bench.normalized(rows).withColumn("variant_name", rows["method_variant_name"])).collect()}
    assert got["method", None, None] == (3, 3.0)
    assert got["interface", None, "normals"] == (1, 9.0) and got["interface", None, "points"] == (2, 2.0)
    assert got["variant", "x", None] == (1, 9.0)


def test_profiles(spark):
    op = "key string, count long, cuda_time_total_us double, cpu_time_total_us double, cuda_memory_usage_bytes long"
    kind = f"pdb_id string, method string, interface_mode string, top_ops struct<cuda_time:array<struct<{op.replace(' ', ':').replace(',:', ',')}>>,cpu_time:array<struct<{op.replace(' ', ':').replace(',:', ',')}>>,memory:array<struct<{op.replace(' ', ':').replace(',:', ',')}>>>, top_calls array<struct<name:string,wall_seconds:double>>"
    p = spark.createDataFrame([("a", "m", "points", ([("mul", 2, 5.0, 1.0, 0), ("add", 1, 9.0, 1.0, 0)], [("mul", 1, 6.0, 0.0, 4)], None), [("f", 1.0), ("g", 2.0)])], kind)
    assert [(r["key"], r["count"], r["profiles"]) for r in bench.profile_ops(p).collect()] == [("mul", 3, 2), ("add", 1, 1)]
    assert [r["name"] for r in bench.slowest_calls(p, 1).collect()] == ["g"]


def test_counting_atoms_and_demo_molecules(spark, pdb, tmp_path):
    pdb("n", line("ATOM", 1, "C", 0, element="C"), line("ATOM", 2, "H", 0, element="H"), line("HETATM", 3, "O", 10, element="O"))
    assert st.atom_counts(spark, str(tmp_path), hetatm=False, hydrogens=False).first()["atoms"] == 1
    for name, (elements, xyz) in st.demo_molecules().items():
        gap = np.linalg.norm(xyz[:, None] - xyz, axis=2) + 9 * np.eye(len(xyz))
        assert len(elements.split()) == len(xyz) and gap.min() > 0.5, name


def test_command_line(spark, tmp_path):
    from molsurf.cli import main

    base, now = write(tmp_path / "b.jsonl", record("a", 1.0, 100)), write(tmp_path / "c.jsonl", record("a", 1.3, 100))
    assert main(["compare", base, now, "--fail-on-regression"]) == 1
    assert main(["compare", base, base, "--fail-on-regression"]) == 0
    assert main(["sweep", base]) == 0
