import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from molsurf.operators import graph
from molsurf.operators.graph import GraphOptions, once, surface_edges
from molsurf.operators.points import in_frames, spatial_key

SCHEMA = "mol_id string, point_id long, x double, y double, z double, nx double, ny double, nz double, supports array<int>, block_type int, block_id long"


def test_square_has_sides_only(spark):
    p = spark.createDataFrame([("m", k, *map(float, xy), 0.0, 0.0, 0.0, 1.0) for k, xy in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], SCHEMA.split(", supports")[0])
    e = surface_edges(p, GraphOptions(2, 3, max_tangent_component=0.1)).toPandas()
    assert {(a, b) for a, b in zip(e.src, e.dst)} == {(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 0), (0, 3)}
    assert set(e.weight) == {1.0}


def test_quarter_arc(spark):
    p = spark.createDataFrame([("m", 0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("m", 1, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0)], SCHEMA.split(", supports")[0])
    for mode, want in (("euclidean", math.sqrt(2)), ("geodesic", math.pi / 2)):
        e = surface_edges(p, GraphOptions(1, min_normal_cosine=0.0, weight_mode=mode)).collect()
        assert len(e) == 2 and all(abs(r["weight"] - want) < 1e-12 for r in e)


def typed(spark, rows):
    return spark.createDataFrame([("m", k, float(k), 0.0, 0.0, 0.0, 0.0, 1.0, s, t, b) for k, (s, t, b) in enumerate(rows)], SCHEMA)


def test_topology(spark):
    nested = surface_edges(typed(spark, [([0], 1, 0), ([0, 1, 2], 3, 0), ([0, 1], 2, 0)]), GraphOptions(2)).count()
    assert nested == 6
    apart = typed(spark, [([0], 1, 0), ([1], 1, 1)])
    assert surface_edges(apart, GraphOptions(1)).count() == 0
    assert surface_edges(apart, GraphOptions(1, allow_disjoint_single_support_edges=True)).count() == 2


@pytest.mark.parametrize("bad, error", [({"neighbors": True}, TypeError), ({"neighbors": 0}, ValueError), ({"candidate_neighbors": 1}, ValueError), ({"weight_mode": "x"}, ValueError), ({"min_normal_cosine": 2}, ValueError), ({"max_tangent_component": -1}, ValueError), ({"max_distance": 0}, ValueError), ({"search": "x"}, ValueError)])
def test_bad_options(bad, error):
    with pytest.raises(error):
        GraphOptions(**bad)


def sphere(spark, n, seed=1):
    """Points on a sphere, with patches around eight atoms: each point is supported by its one, two or three nearest."""
    rng = np.random.default_rng(seed)
    p = rng.standard_normal((n, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    corners = np.array([(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]) / math.sqrt(3)
    near = np.argsort(np.linalg.norm(p[:, None] - corners, axis=2), axis=1)
    size = rng.integers(1, 4, n)
    rows = []
    for k in range(n):
        own = sorted(near[k, : size[k]].tolist())
        rows.append(("m" if k % 2 else "w", k, *map(float, p[k]), *map(float, p[k]), own, int(size[k]), int(sum(10**i * a for i, a in enumerate(own)))))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("mode", ["euclidean", "geodesic"])
def test_prefiltered_search_is_exact(spark, monkeypatch, mode):
    """Also where the pool is so small that many points come out short."""
    p = sphere(spark, 260)
    exact = {tuple(r) for r in surface_edges(p, GraphOptions(4, 6, weight_mode=mode, max_tangent_component=1.0)).collect()}
    for fewest, times in ((64, 8), (7, 1)):
        monkeypatch.setattr(graph, "FEWEST", fewest)
        monkeypatch.setattr(graph, "TIMES", times)
        got = surface_edges(p, GraphOptions(4, 6, weight_mode=mode, max_tangent_component=1.0, search="prefiltered"))
        assert {tuple(r) for r in got.collect()} == exact


def test_windowed_search_finds_most(spark):
    """Linear work, and most of the exact edges; every candidate is allowed by the topology."""
    p = sphere(spark, 1200)
    exact = {(r["src"], r["dst"]) for r in surface_edges(p, GraphOptions(4, 6, max_tangent_component=1.0)).collect()}
    found = {(r["src"], r["dst"]) for r in surface_edges(p, GraphOptions(4, 6, max_tangent_component=1.0, search="windowed")).collect()}
    recall = len(exact & found) / len(exact)
    assert recall > 0.5, recall
    of = {r["point_id"]: (set(r["supports"]), r["block_type"], r["block_id"]) for r in p.collect()}
    for a, b in found:
        (sa, *ka), (sb, *kb) = of[a], of[b]
        assert ka == kb or sa <= sb or sb <= sa


def test_frames_of_places(spark):
    """All pairs within the reach by place in each group, whatever the stretches and the buckets of the ranking."""
    p = spatial_key(sphere(spark, 300).withColumn("g", F.col("point_id") % 3))
    rows = p.select("mol_id", "g", "point_id", "key").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["point_id"])):
        groups.setdefault((r["mol_id"], r["g"]), []).append(r["point_id"])
    want = {(a, b) for own in groups.values() for i, a in enumerate(own) for j, b in enumerate(own) if 0 < abs(i - j) <= 5}
    got = [(r["src"], r["dst"]) for r in in_frames(p, ["g"], 5, []).collect()]
    assert len(got) == len(want) and set(got) == want


def test_windows_are_joins_on_stretches(spark):
    plan = surface_edges(sphere(spark, 50), GraphOptions(4, search="windowed"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_supports_or_blocks_alone(spark):
    p = typed(spark, [([0], 1, 0), ([0, 1], 2, 0), ([5], 1, 0), ([7], 4, 9)])
    pairs = lambda df: {(r["src"], r["dst"]) for r in once(surface_edges(df, GraphOptions(3, max_tangent_component=1.0))).collect()}
    assert pairs(p.drop("block_type", "block_id")) == {(0, 1)}
    assert pairs(p.drop("supports")) == {(0, 2)}
    assert pairs(p) == {(0, 1), (0, 2)}
    for bad in (p.drop("block_id"), p.withColumn("supports", F.lit("0")), p.drop("nx")):
        with pytest.raises(ValueError):
            surface_edges(bad)


@pytest.mark.parametrize("mode", ["euclidean", "geodesic"])
def test_allowed_pairs_are_joined_by_topology(spark, monkeypatch, mode):
    """The same edges as by cells, without them; supports that are empty, or too many allowed pairs, are left to the cells."""
    p = sphere(spark, 260)
    repeated = p.withColumns({"supports": F.when(F.col("point_id") % 9 == 0, F.concat("supports", "supports")).when(F.col("point_id") % 9 != 1, F.col("supports")), "block_id": F.when(F.col("point_id") % 5 != 0, F.col("block_id"))})
    empty = p.withColumn("supports", F.when(F.col("point_id") % 9 == 0, F.array().cast("array<int>")).otherwise(F.col("supports")))
    calls, cells = [], graph.nearest_in_cells
    monkeypatch.setattr(graph, "nearest_in_cells", lambda *a: calls.append(1) or cells(*a))
    for points, by_cells in ((p, 0), (repeated, 0), (p.drop("supports"), 0), (p.drop("block_type", "block_id"), 0), (empty, 1)):
        found = []
        for most in (500, 0):
            monkeypatch.setattr(graph, "MOST_ALLOWED", most)
            calls.clear()
            found.append(sorted(map(tuple, surface_edges(points, GraphOptions(4, 6, weight_mode=mode, max_tangent_component=1.0, max_distance=0.7)).collect())))
            assert len(calls) == (by_cells if most else 1)
        assert found[0] == found[1] and found[0]
