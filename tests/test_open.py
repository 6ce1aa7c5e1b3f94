"""Places outside all spheres of dense molecules: only open atoms are asked for them."""

import duckdb
import numpy as np
import pytest

from molsurf.functions import kernels as kn
from molsurf.operators import spatial as sp
from molsurf.plans import geometry_queries as gq
from molsurf.plans import samplers as sm


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Two molecules of 60 atoms, each inside a ball of a few radii."""
    folder = tmp_path_factory.mktemp("dense")
    v = np.random.default_rng(3).normal(size=(120, 3)) * 1.6 / 40
    rows = [(k, [float(x) for x in v[k]], k % 2) for k in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_patches_cover_the_sphere():
    middle, chord = kn.sphere_patches()
    v = kn.unit(np.random.default_rng(0).normal(size=(5000, 3)))
    assert (np.linalg.norm(v[:, None] - middle, axis=2) - chord).min(1).max() <= 0


def test_atoms_with_exposed_places_are_open():
    rng = np.random.default_rng(1)
    for spread in (1.0, 3.0, 6.0):
        xyz, r = rng.normal(size=(80, 3)) * spread, rng.uniform(2.5, 3.3, 80)
        p = xyz[:, None] + r[:, None, None] * kn.fibonacci(2000)
        d = np.linalg.norm(p[:, :, None] - xyz, axis=3)
        exposed = (d >= r - 1e-9).all(2).any(1)
        open_ = kn.open_spheres(xyz, r, xyz, r)
        assert open_[exposed].all() and (spread > 1 or open_.sum() < 60)
    same = np.zeros((2, 3)), np.full(2, 3.0)
    assert kn.open_spheres(*same, *same).all()


@pytest.mark.parametrize("name", ["pair_exterior_any", "triple_centers_feasible"])
def test_dense_molecules(spark, dense, name, monkeypatch):
    """The rows of the SQL, from few of the pairs."""
    whole, graph, asked = gq.pairs(spark, dense).count(), sp.pair_graph, []
    monkeypatch.setattr(sp, "pair_graph", lambda *a: asked.append(graph(*a)) or asked[-1])
    got = gq.QUERIES[name](spark, dense)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{dense}/embeddings.parquet/*.parquet'")
    want = con.execute(gq.SQL[name]).fetchall()
    assert len(want) and sorted(map(tuple, got.collect())) == sorted(want)
    assert all(p.count() < whole / 2 for p in asked) and asked


@pytest.mark.parametrize("name", ["sdf_values", "sdf_supports"])
def test_smooth_distance_sorts_no_terms(spark, dense, name):
    """Terms are summed where they are joined: no window over the terms of a point."""
    plan = gq.QUERIES[name](spark, dense)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "windowspecdefinition" in line and "point_id" in line]


@pytest.mark.parametrize("spread", [1.0, 3.0])
def test_samplers_ask_open_atoms_alone(spread):
    """The points of all atoms, pairs and triangles, from those of open atoms."""
    rng = np.random.default_rng(4)
    xyz, radii = rng.normal(size=(50, 3)) * spread, rng.choice([1.1, 1.52, 1.7, 1.9], 50)
    some, every = (kn.Surface(xyz, radii, 1.4, 0.5) for _ in range(2))
    every.open = np.ones(50, bool)
    got, want = (sm.analytic_samples(s, sm.Density(point_area=2.0), sm.Blocks()).frame("m") for s in (some, every))
    assert len(got) and got.astype(str).equals(want.astype(str))
    assert "pairs" not in vars(some) and "triangles" not in vars(some)
    assert len(some.open_triangles) < len(every.open_triangles) or spread > 1


@pytest.mark.parametrize("dense_up_to", [2000, 0])
def test_covered_places_meet_few_spheres(monkeypatch, dense_up_to):
    """Places outside all spheres are brute force's; most others are seen to be inside by the spheres deepest around their cube."""
    rng = np.random.default_rng(4)
    xyz, radii = rng.normal(size=(600, 3)) * 4, rng.uniform(1.1, 1.9, 600)
    monkeypatch.setattr(kn, "DENSE", dense_up_to)
    s = kn.Surface(xyz, radii, 1.4)
    p = (xyz[:, None] + s.r[:, None, None] * kn.fibonacci(40)).reshape(-1, 3)
    d2 = ((p[:, None] - xyz) ** 2).sum(2)
    r2 = s.r**2
    want = (d2 >= r2 - kn.TOUCH * kn.EPS * np.maximum(np.maximum(d2, r2), 1)).all(1)
    sizes = []
    monkeypatch.setattr(kn, "apart2", lambda *a, keep=kn.apart2: (sizes.append((x := keep(*a)).size), x)[1])
    assert (s.outside(p, s.r, kn.TOUCH) == want).all() and 0 < want.sum() < 0.2 * len(p)
    assert sum(sizes) < 0.6 * len(p) * len(xyz)
    s.outside(p, s.r, kn.TOUCH)
    assert len(s.deepest) < len(p) and (s.outside(p[:0], s.r, kn.TOUCH).shape == (0,))


def test_smooth_distance_looks_at_near_atoms_only(monkeypatch):
    """A long chain of atoms: the values and normals of all terms, from a fraction of them."""
    rng = np.random.default_rng(6)
    xyz = np.c_[np.arange(1500) * 0.4, rng.normal(size=(1500, 2))]
    s = kn.Surface(xyz, rng.uniform(1.1, 1.9, 1500), 1.4)
    p = np.concatenate([(s.xyz[None] + s.r[None, :, None] * kn.fibonacci(6)[:, None]).reshape(-1, 3), s.xyz[:2], [[np.nan, 0, 0]]])
    value, normal, _ = sm.soft_distance(s, p[:-1], 0.3)
    sizes = []
    monkeypatch.setattr(kn, "apart2", lambda *a, keep=kn.apart2: (sizes.append((x := keep(*a)).size), x)[1])
    got, along = sm.soft_place(s, p, 0.3)
    assert np.abs(got[:-1] - value).max() < 1e-12 and np.abs(along[:-1] - normal).max() < 1e-9 and np.isnan(got[-1])
    assert sum(sizes) < 0.6 * len(p) * s.n


def test_seeds_of_a_molecule_are_dealt_over_tasks(spark, dense, monkeypatch):
    """The same points from one part and from several; each part has its share of the seeds."""
    from molsurf.sources.proxy import atoms_proxy

    rows = []
    for most in (1, 3):
        monkeypatch.setattr(sm, "MOST_PARTS", most)
        monkeypatch.setattr(sm, "PART_PAIRS", 20_000)
        got = sm.level_set(atoms_proxy(spark, dense), 12, subsample_spacing=0.8)
        assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()
        rows.append(sorted((r["mol_id"], r["point_id"], *(round(r[c], 6) for c in ("x", "y", "z", "nx", "ny", "nz"))) for r in got.collect()))
    assert rows[0] == rows[1] and rows[0]


def test_no_triangle_is_left_out():
    """5.4 million triangles of a tight cluster come before that of three atoms apart, whose two probe positions are found."""
    xyz = np.concatenate([kn.fibonacci(320), [(40, 0, 0), (42.8, 0, 0), (41.4, 2.3, 0)]])
    s = kn.Surface(xyz, np.full(323, 1.5), 1.4)
    asked = sm.Blocks()
    found = s.probe_blocks(asked.max_supports, asked.support_tolerance, asked.dedup)
    assert [sign for _, sign, sup in found if list(sup) == [320, 321, 322]] == [0, 1]


def test_all_atoms_that_a_probe_touches_are_named():
    """Twenty atoms around one place: each of its blocks' supports are all of them."""
    s = kn.Surface(5 * kn.unit(np.stack([np.cos(np.arange(20) * np.pi / 10), np.sin(np.arange(20) * np.pi / 10), np.full(20, 0.3)], 1)), np.full(20, 3.6), 1.4)
    many = sm.Blocks()
    blocks = [sup for c, _, sup in s.probe_blocks(many.max_supports, many.support_tolerance, many.dedup) if np.linalg.norm(c) < 1e-6]
    assert len(blocks) == 1 and sorted(blocks[0]) == list(range(20))


def test_blocks_beyond_five_million_triangles_are_sampled():
    """The analytic sampler has points of the last triangle's two patches."""
    xyz = np.concatenate([kn.fibonacci(320), [(40, 0, 0), (42.8, 0, 0), (41.4, 2.3, 0)]])
    got = sm.analytic_samples(kn.Surface(xyz, np.full(323, 1.5), 1.4), sm.Density(point_area=6.0, atom=0.0, pair=0.0), sm.Blocks()).frame("m")
    last = ((320 * 323 + 321) * 323 + 322) * 2
    assert {last, last + 1} <= set(got["block_id"]) and (got["block_type"] == 3).all()


def test_smooth_distance_makes_no_rows_of_points_and_atoms(spark, dense):
    """Terms are summed inside a cell's task; the plan joins no points with atoms, and the rows are the SQL's."""
    got = gq.QUERIES["sdf_step"](spark, dense)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and not [line for line in plan.splitlines() if "Join" in line]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{dense}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(gq.SQL["sdf_step"]).fetchall())


def test_points_without_a_place_have_no_smooth_distance(spark, tmp_path):
    """As in the SQL, an atom without coordinates has its seeds' rows, without values, and adds no terms to others."""
    spark.createDataFrame([(0, [0.1, 0.0, 0.0], 1), (1, None, 1), (2, [0.15, 0.02, 0.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("sdf_values", "sdf_step"):
        want = con.execute(gq.SQL[name]).fetchall()
        assert len(want) == 24 and sorted(map(tuple, gq.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
