"""Queries whose rows are many times their atoms: only atoms are shuffled."""

import re

import duckdb
import numpy as np
import pytest

from molsurf.functions import kernels as kn
from molsurf.operators import spatial as sp
from molsurf.plans import graph_queries as gq
from molsurf.queries import ORACLE_SQL, QUERIES
from molsurf.sources.proxy import atoms_proxy

NAMES = [
    "triangles",
    "triangles_capped",
    "triple_centers",
    "barycentric_rows",
    "tile_pair_membership",
    "pair_arc_cdf",
    "pair_patch_area",
]


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Two molecules of 45 atoms over several cells, negative places included, and one of two atoms at one place."""
    folder = tmp_path_factory.mktemp("crowd")
    v = np.random.default_rng(5).normal(size=(92, 3)) * 4.0 / 40
    v[91] = v[90]
    rows = [(k, [float(x) for x in v[k]], 2 if k >= 90 else k % 2) for k in range(92)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_only_atoms_are_shuffled(spark, crowd, name):
    got = QUERIES[name](spark, crowd)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\b[abc]#", plan)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{crowd}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert len(want) and sorted(map(tuple, got.collect())) == sorted(want)


def test_triples_in_small_batches(spark, crowd, monkeypatch):
    """Batches cut triangles of one pair, and stretches cut a sphere's neighbours: the same rows."""
    rng = np.random.default_rng(2)
    xyz, r, own = rng.normal(size=(40, 3)) * 3, rng.uniform(2.5, 3.3, 40), rng.random(40) < 0.6

    def listed():
        return [(a, x, y) for a, b, counts, c in kn.triples_of(xyz, r, own) for x, y in zip(np.repeat(b, counts), c)]

    d = np.linalg.norm(xyz[:, None] - xyz, axis=2)
    met = (d < r[:, None] + r) & (d > abs(r[:, None] - r))
    want = [(a, b, c) for a in range(40) for b in range(a + 1, 40) for c in range(b + 1, 40) if own[a] and met[a, b] and met[a, c] and met[b, c]]
    assert listed() == want
    monkeypatch.setattr(kn, "TRIPLES", 7)
    assert listed() == want


def test_first_triangles_of_cells_hold_those_of_the_molecule(spark, crowd):
    every = sorted(map(tuple, sp.triangles_by_cell(atoms_proxy(spark, crowd)).where("mol_id = 0").collect()))
    first = sorted(map(tuple, sp.triangles_by_cell(atoms_proxy(spark, crowd), most=7).where("mol_id = 0").collect()))
    assert first[:7] == every[:7] and 7 < len(first) < len(every)


def test_supports_are_compared_once_a_set(spark, monkeypatch):
    """Nested and equal supports of two molecules, against brute force; only distinct supports meet by their atoms."""
    sets = [[1], [2], [1, 2], [1, 2, 3], [3, 4], [4], [1, 2]]
    given = [(m, k, sets[(k * (m + 2)) % 7]) for m in (0, 1) for k in range(20)]
    monkeypatch.setattr(gq, "points", lambda *_: spark.createDataFrame(given, "mol_id long, point_id long, supports array<long>"))
    got = gq.support_subset_pairs(spark, "")
    want = [(m, i, j, set(s) == set(t)) for m, i, s in given for n, j, t in given if m == n and i < j and (set(s) <= set(t) or set(t) <= set(s))]
    assert sorted(map(tuple, got.select("mol_id", "a", "b", "same").collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(supports") == plan.count("Aggregate [mol_id") == 2


def test_pairs_are_not_joined_to_tiles(spark, crowd):
    plan = QUERIES["tile_pair_membership"](spark, crowd)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join " in line and "tile_id" in line]


def test_pairs_deal_an_atom_to_half_of_the_cells_around_it(spark, crowd):
    """Fifteen rows an atom are shuffled, and none sorted: the pairs are held on the side that goes nowhere else."""
    got = QUERIES["pair_circle_params"](spark, crowd)
    assert len(sp.AHEAD) == 14 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{crowd}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['pair_circle_params']})").fetchall()
    assert len(want) and sorted(map(tuple, got.collect())) == sorted(want)
