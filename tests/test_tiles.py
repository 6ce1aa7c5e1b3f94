"""Work on parts of a molecule against the whole-molecule kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from molsurf.functions import kernels as kn
from molsurf.operators import tiles
from molsurf.plans import samplers as sm
from molsurf.plans import spread

EDGE, CELLS = 12.0, 20


def cloud(n, seed, density):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, (n / density) ** (1 / 3), (n, 3)).round(4), rng.choice([1.1, 1.52, 1.7, 1.8], n)


CAGE = 3.0 * np.vstack((np.eye(3), -np.eye(3), np.eye(3) * 3, -np.eye(3) * 3))
MOLECULES = {"cloud": cloud(140, 1, 0.03), "dense": cloud(50, 2, 0.06), "cage": (CAGE, np.full(12, 1.1)), "three": (np.array([(0, 0, 0), (2.8, 0, 0), (1.4, 2.3, 0)], float), np.full(3, 1.5))}


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(m, 10 * k, *map(float, p), float(r)) for m, (xyz, radii) in MOLECULES.items() for k, (p, r) in enumerate(zip(xyz, radii))]
    return spark.createDataFrame(rows, "mol_id string, atom_idx int, x double, y double, z double, radius double")


def same_rows(one, two, keys):
    one, two = (f.sort_values(keys).reset_index(drop=True) for f in (one, two))
    plain = lambda x: [tuple(i) if isinstance(i, tuple) else i for i in x]
    one["supports"], two["supports"] = one["supports"].map(plain), two["supports"].map(plain)
    pd.testing.assert_frame_equal(one, two, check_exact=True)


SMALL = sm.Blocks(atom_filter=32, pair_filter=8)
GRID = 60_000


def test_analytic_points_are_those_of_the_whole_molecule(atoms):
    density = sm.Density(point_area=5.0)
    whole = sm.analytic(atoms, density, 1.4, SMALL, max_grid=GRID).toPandas()
    parts = spread.analytic(atoms, density, 1.4, SMALL, None, GRID, EDGE, CELLS).toPandas()
    assert set(whole.block_type) == {1, 2, 3} and set(whole.mol_id) == set(MOLECULES)
    same_rows(whole, parts, ["mol_id", "point_id"])


def test_blocks_are_those_of_the_whole_molecule(atoms):
    whole = sm.analytic_blocks(atoms, 1.4, SMALL, max_grid=GRID).toPandas()
    parts = spread.analytic_blocks(atoms, 1.4, SMALL, None, GRID, EDGE, CELLS).toPandas()
    same_rows(whole, parts, ["mol_id", "block_type", "block_id"])


@pytest.mark.parametrize("exact", [False, True])
def test_tiled_points_are_those_of_one_task(atoms, exact):
    density = sm.Density(point_area=5.0, oversample=1.0)
    given = dict(tile_size=9.0, exact_accessibility=exact, max_grid=GRID)
    whole = sm.tiled(atoms, density, **given).toPandas()
    parts = spread.tiled(atoms, density, 1.4, 9.0, 4.0, 0.05, exact, None, GRID, sm.Blocks(), EDGE, CELLS).toPandas()
    assert whole[whole.mol_id == "cloud"].tile_id.nunique() > 4
    same_rows(whole, parts, ["mol_id", "point_id"])


def test_large_molecules_are_dealt(atoms, monkeypatch):
    asked = []
    monkeypatch.setattr(spread, "analytic", lambda large, *_: asked.extend(r["mol_id"] for r in large.select("mol_id").distinct().collect()) or sm.analytic(large, *_[:3], *_[3:]))
    out = sm.analytic(atoms, sm.Density(point_area=40.0), 1.4, SMALL, max_grid=GRID, spread=100)
    assert asked == ["cloud"] and {r["mol_id"] for r in out.select("mol_id").distinct().collect()} == set(MOLECULES)


def test_flood_by_blocks_is_the_flood(spark, atoms):
    for block in (7, CELLS, 1000):
        frame = tiles.frames(atoms, 1.4, None, GRID)
        got = tiles.reached_cells(tiles.flood_by_blocks(atoms, frame, 1.4, block), frame, block).toPandas()
        for m, (xyz, radii) in MOLECULES.items():
            reached, _, _ = kn.Surface(xyz, radii, 1.4, None, GRID).grid
            own = got[got.mol_id == m][["ix", "iy", "iz"]].to_numpy()
            assert len(own) == reached.sum() and reached[tuple(own.T)].all()
            assert m != "cage" or reached.sum() < (kn.free_cells(xyz, radii + 1.4, *[tiles_frame(frame, m)[k] for k in ("corner", "h")], np.zeros(3, int), np.array(reached.shape))).sum()


def tiles_frame(frame, m):
    r = frame.where(F.col("mol_id") == m).first()
    return {"corner": np.array([r["gx"], r["gy"], r["gz"]]), "h": r["h"]}


def test_components_are_floods():
    rng = np.random.default_rng(0)
    for shape in ((1, 1, 1), (3, 4, 5), (20, 7, 13)):
        for share in (0.0, 0.3, 0.5, 0.7, 1.0):
            free = rng.random(shape) < share
            label = kn.components(free)
            assert ((label > 0) == free).all()
            left = free.copy()
            for c in np.argwhere(free)[:40]:
                if not left[tuple(c)]:
                    continue
                seen, todo = np.zeros(shape, bool), [tuple(map(int, c))]
                while todo:
                    x = todo.pop()
                    if all(0 <= v < n for v, n in zip(x, shape)) and free[x] and not seen[x]:
                        seen[x] = True
                        todo += [x[:k] + (x[k] + d,) + x[k + 1 :] for k in range(3) for d in (-1, 1)]
                assert (seen == (label == label[tuple(c)])).all()
                left &= ~seen


def test_blocked_rays_are_those_of_all_atoms(spark, atoms):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for m, (xyz, radii) in MOLECULES.items():
        a = rng.uniform(xyz.min(0) - 6, xyz.max(0) + 6, (60, 3))
        b = a + rng.normal(0, 12, a.shape)
        rows += [(m, k, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(a, b))]
        want |= {(m, int(k)) for k in np.flatnonzero(~kn.Surface(xyz, radii, 1.4).clear(a, b))}
    rays = spark.createDataFrame(rows, "mol_id string, k long, " + ", ".join(f"{c} double" for c in tiles.RAY))
    frame = tiles.frames(atoms, 1.4, None, GRID, 7.0)
    near = tiles.halo(atoms, frame, 2 * F.col("rmax"))
    got = {tuple(r) for r in tiles.blocked(rays, near, frame, ["k"], 1.4).collect()}
    assert 0 < len(want) < len(rows) and got == want


def test_triangles_in_order():
    xyz, radii = cloud(120, 3, 0.05)
    s = kn.Surface(xyz, radii, 1.4)
    up = [set() for _ in radii]
    for a, b in s.pairs:
        up[a].add(int(b))
    assert s.triangles.tolist() == [[a, b, c] for a in range(len(radii)) for b in sorted(up[a]) for c in sorted(up[a] & up[b])]


def test_numbers_are_ranks(spark):
    rows = [(m, k * 7 % 1000, 0.0) for m in ("a", "b") for k in range(1, 900)]
    df = spark.createDataFrame(rows, "mol_id string, at long, x double")
    got = tiles.numbered(df, ["at"], "k", F.floor(F.col("at") / 64).cast("long")).toPandas()
    for _, own in got.groupby("mol_id"):
        assert own.sort_values("at")["k"].tolist() == list(range(899))


def test_no_atoms(atoms):
    assert sm.analytic(atoms.where("false"), spread=0).count() == 0
