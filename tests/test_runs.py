"""Benchmark runs, their records, output forms and bonds."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from molsurf import runs
from molsurf.cli import main
from molsurf.operators.bonds import bonds
from molsurf.operators.outputs import crowded, dense_features, limited, output_stats, supports_of
from molsurf.sources.bench_json import read_profiles, read_records
from molsurf.sources.structures import read_demo


def test_runs_are_recorded_and_resumed(spark, tmp_path):
    path = str(tmp_path / "records")
    atoms = read_demo(spark, "H2O").select(F.col("mol_id").cast("string"), "atom_idx", "x", "y", "z", "radius")
    big = atoms.withColumn("mol_id", F.lit("big")).unionByName(atoms.withColumn("mol_id", F.lit("big")).withColumn("atom_idx", F.col("atom_idx") + 3))
    todo = runs.variants(["level_set"], {"level_set": {"iterations": [2], "m": [0]}})
    assert [v.name for v in todo] == ["default", "iterations=2", "m=0"] and len({v.key for v in todo}) == 3
    assert runs.run(spark, atoms.unionByName(big), todo, path, most_atoms=4) == 6
    got = {(r["pdb_id"], r["variant_name"]): r for r in read_records(spark, path).collect()}
    own = {k[1]: r for k, r in got.items() if k[0] != "big"}
    assert own["default"]["status"] == "ok" and own["default"]["point_count"] > 0 and own["default"]["wall_seconds"] > 0
    assert own["m=0"]["status"] == "error" and {r["status"] for k, r in got.items() if k[0] == "big"} == {"skipped"}
    assert runs.run(spark, atoms.unionByName(big), todo, path, most_atoms=4) == 0
    with pytest.raises(ValueError):
        runs.Variant("other")


def test_interfaces_and_reference_metrics_are_in_the_records(spark, tmp_path):
    """What a run found is read back from its record; the interfaces differ in it."""
    folder, path = tmp_path / "surfaces", str(tmp_path / "records")
    folder.mkdir()
    atoms = read_demo(spark, "H2O").select("atom_idx", "x", "y", "z", "radius")
    four = atoms.withColumn("mol_id", F.explode(F.array(*map(F.lit, ("good", "cut", "other", "gone")))))
    rng = np.random.default_rng(0)
    p = rng.standard_normal((500, 3))
    p = 3 * p / np.linalg.norm(p, axis=1, keepdims=True)
    head = "ply\nformat ascii 1.0\nelement vertex {}\nproperty float x\nend_header\n"
    body = "\n".join(" ".join(f"{c:.6f}" for c in v) for v in p)
    (folder / "good.ply").write_text(head.format(500) + body + "\n")
    (folder / "cut.ply").write_text(head.format(501) + body + "\n")
    (folder / "other.ply").write_text("ply\nformat binary_little_endian 1.0\nend_header\n")
    todo = [runs.Variant("projected", {"m": 12}, i) for i in runs.INTERFACES]
    assert runs.run(spark, four.where("mol_id = 'good'"), todo, path, surfaces=str(folder)) == 4
    assert runs.run(spark, four.where("mol_id <> 'good'"), todo[:1], path, surfaces=str(folder)) == 3
    got = {(r["pdb_id"], r["interface_mode"]): r for r in read_records(spark, path).collect()}
    good = {i: got["good", i] for i in runs.INTERFACES}
    assert len({r["point_count"] for r in good.values()}) == 1 and good["points"]["point_count"] > 0
    assert good["features"]["feature_values"] == 3 * good["points"]["point_count"] and good["features"]["supports_max"] == 1
    assert good["normals"]["normal_error_max"] < 1e-9 and good["adjacency"]["edge_count"] > 0 and good["adjacency"]["finite_weights"]
    assert good["points"]["feature_values"] is None and good["points"]["edge_count"] is None and good["points"]["normal_error_max"] is None
    m = good["points"]["reference_metrics"]
    points = np.array([tuple(r) for r in runs.METHODS["projected"](four.where("mol_id = 'good'"), {"m": 12}).select("x", "y", "z").collect()])
    gap = np.linalg.norm(points[:, None] - np.round(p, 6), axis=2)
    assert (m["status"], m["reference_vertex_count"], m["sampled_point_count"], m["sampled_reference_count"]) == ("ok", 500, len(points), 500)
    assert abs(m["symmetric_mean_distance"] - (gap.min(1).mean() + gap.min(0).mean()) / 2) < 1e-9
    assert abs(m["point_to_reference_distance"]["p90"] - np.percentile(gap.min(1), 90)) < 1e-9
    assert abs(m["reference_to_point_distance"]["max"] - gap.min(0).max()) < 1e-9
    states = {k[0]: (r["reference_metrics"]["status"], r["reference_metrics"]["error"]) for k, r in got.items() if k[1] == "points"}
    assert states == {"good": ("ok", None), "cut": ("load_error", "a vertex is missing or no number"), "other": ("load_error", "not an ASCII PLY file"), "gone": ("missing_surface", None)}


def test_errors_are_in_the_records(spark, tmp_path):
    atoms = read_demo(spark, "H2O").select(F.col("mol_id"), "atom_idx", "x", "y", "z", "radius")
    runs.run(spark, atoms, [runs.Variant("projected", {"m": 0})], str(tmp_path / "r"))
    r = read_records(spark, str(tmp_path / "r")).first()
    assert r["status"] == "error" and "m must be positive" in r["error"]


def test_command_line_records_what_cannot_be_read(spark, tmp_path):
    path = str(tmp_path / "records")
    broken = tmp_path / "broken.pdb"
    broken.write_text("ATOM      1  ZN  ALA A   1       0.000   0.000   0.000  1.00  0.00          ZN\n")
    for _ in range(2):  # the second time there is nothing new
        assert main(["run", str(broken), str(tmp_path / "gone.pdb"), "H2O", "--records", path, "--methods", "projected"]) == 0
    got = {r["pdb_id"]: r for r in read_records(spark, path).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"broken": "load_error", "gone": "load_error", "H2O": "ok"}
    assert "unknown element ZN" in got["broken"]["error"] and read_records(spark, path).count() == 3
    assert main(["summary", path, "--output-json", str(tmp_path / "out")]) == 0
    status = {r["status"]: r["records"] for r in spark.read.json(str(tmp_path / "out" / "status")).collect()}
    assert status == {"load_error": 2, "ok": 1}


def test_profiles_are_collected(spark, tmp_path):
    f = lambda s: {"top_functions": [{"name": "f", "calls": 2, "wall_seconds_total": s}], "top_calls": [{"name": "f", "wall_seconds": s}]}
    (tmp_path / "a.profile.json").write_text(json.dumps({"pdb_id": "a", "method": "m", "internal_profile": f(1.0)}, indent=1))
    (tmp_path / "b.profile.json").write_text(json.dumps({"pdb_id": "b", "method": "m", "internal_profile": f(2.0)}))
    (tmp_path / "c.profile.json").write_text("not json {")
    lines = [{"pdb_id": "own", "method": "m", "internal_profile": f(4.0)}, {"pdb_id": "a", "profile_artifact": {"path": "a.profile.json"}}, {"pdb_id": "a", "profile_artifact": {"path": "a.profile.json"}}, {"pdb_id": "gone", "profile_artifact": {"path": "gone.profile.json"}}, {"pdb_id": "plain"}]
    path = tmp_path / "records.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    payloads, errors = read_profiles(spark, str(path), str(tmp_path))
    assert sorted(r["pdb_id"] for r in payloads.collect()) == ["a", "b", "own"]
    assert sorted((r["path"].rpartition("/")[2], r["error"]) for r in errors.collect()) == [("c.profile.json", "no JSON"), ("gone.profile.json", "not there")]
    assert main(["profiles", str(path), "--output-json", str(tmp_path / "out")]) == 1
    assert [r["seconds"] for r in spark.read.json(str(tmp_path / "out" / "functions")).collect()] == [5.0]


def test_output_statistics(spark):
    rows = [(1, 0, 1.0, 0.0, 0.0, [0, 1]), (1, 1, 0.0, 2.0, 0.0, [2]), (2, 0, 0.0, 0.0, 1.0, [0, 1, 2])]
    points = spark.createDataFrame(rows, "mol_id long, point_id long, nx double, ny double, nz double, supports array<int>")
    edges = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 0, 0.5)], "mol_id long, src long, dst long, weight double")
    a, b = output_stats(points, edges).orderBy("mol_id").collect()
    assert (a["point_count"], a["supports_mean"], a["supports_max"], a["normal_error_mean"], a["normal_error_max"]) == (2, 1.5, 2, 0.5, 1.0)
    assert (a["edge_count"], a["density"], a["mean_degree"], b["edge_count"], b["density"]) == (2, 0.5, 1.0, 0, 0.0)


def test_dense_features_and_back(spark):
    atoms = spark.createDataFrame([(1, k) for k in range(4)] + [(2, 0)], "mol_id long, atom_idx long")
    samples = spark.createDataFrame([(1, 0, [(0, 0.25), (3, 0.75)]), (1, 1, [(2, 1.0)]), (2, 0, [])], "mol_id long, point_id long, supports array<struct<atom_idx:int,weight:double>>")
    dense = dense_features(samples, atoms).orderBy("mol_id", "point_id")
    assert [r["features"] for r in dense.collect()] == [[0.25, 0, 0, 0.75], [0, 0, 1.0, 0], [0.0]]
    assert [r["s"] for r in dense.select(supports_of(F.col("features")).alias("s")).collect()] == [[0, 3], [2], []]


def test_bonds_of_demonstration_molecules(spark):
    atoms = read_demo(spark).select(F.col("mol_id"), "atom_idx", "x", "y", "z", "element")
    count = {r["mol_id"]: r["count"] for r in bonds(atoms).groupBy("mol_id").count().collect()}
    assert (count["H2O"], count["CH4"], count["Benzene"]) == (2, 4, 12)


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 21, 57, 400])
def test_limited_points_are_a_truncated_grid(spark, n):
    points = spark.range(n).select(F.lit(1).alias("mol_id"), F.col("id").alias("point_id"))
    got = sorted(r["point_id"] for r in limited(points, 20).collect())
    assert got == (list(range(n)) if n <= 20 else sorted(set(np.linspace(0, n - 1, 20).astype(int).tolist())))


def test_crowded_tiles(spark):
    members = spark.createDataFrame([(1, 5, k) for k in range(3)] + [(1, 6, 0)], "mol_id long, tile_id long, atom_idx long")
    assert [(r["tile_id"], r["members"]) for r in crowded(members, ["mol_id", "tile_id"], 3).collect()] == [(5, 3)]
