import duckdb
import numpy as np
from pyspark.sql import functions as F

from molsurf.operators.points import apportioned, even_picks, farthest_points, shape, windowed_neighbours
from molsurf.plans.geometry_queries import apportion_counts, apportion_sql
from molsurf.sources.proxy import atoms_proxy


def cloud(spark, xyz):
    return spark.createDataFrame([("m", k, *map(float, p)) for k, p in enumerate(xyz)], "mol_id string, point_id long, x double, y double, z double")


def test_windows_that_hold_all_points_are_exact(spark):
    xyz = np.random.default_rng(0).standard_normal((30, 3))
    got = windowed_neighbours(cloud(spark, xyz), 3).toPandas()
    d = np.linalg.norm(xyz[:, None] - xyz, axis=2) + 99 * np.eye(30)
    for src, g in got.groupby("src"):
        assert g.sort_values("rank").dst.tolist() == np.argsort(d[src])[:3].tolist()


def test_picks(spark):
    line = cloud(spark, [(k, 0, 0) for k in range(11)])
    assert sorted(r["point_id"] for r in even_picks(line, 3).collect()) == [0, 5, 10]
    assert [r["point_id"] for r in farthest_points(line, 3).orderBy("pick").collect()] == [0, 10, 5]
    assert even_picks(line.where("false"), 3).count() == 0


def test_shape(spark):
    xyz = np.random.default_rng(1).standard_normal((50, 3)) * [1, 2, 3]
    assert np.allclose(shape(cloud(spark, xyz)).first()["eigenvalues"], np.linalg.eigvalsh(np.cov(xyz.T, bias=True)))


def brute_counts(total, weights):
    """The reference's rule; of equal remainders, the first atom."""
    if total <= 0:
        return [0] * len(weights)
    if max(weights) <= 0:
        return [total] + [0] * (len(weights) - 1)
    share = [round(w / sum(weights) * total, 9) for w in weights]
    out = [max(int(x), int(w > 0)) for x, w in zip(share, weights)]
    rest = [x - int(x) for x in share]
    gap = total - sum(out)
    for k in sorted(range(len(out)), key=lambda k: -rest[k])[: max(gap, 0)]:
        out[k] += 1
    for k in sorted(range(len(out)), key=lambda k: rest[k]):
        take = max(0, min(out[k] - int(weights[k] > 0), -gap))
        out[k] -= take
        gap += take
    return out


def test_counts_follow_the_rule_in_both_engines(spark):
    cases = [(10, [1.0, 1.0, 1.0]), (4, [100.0, 1.0, 1.0, 0.0]), (12, [50.0, 30.0, *[0.1] * 8]), (2, [1.0] * 5), (7, [0.0, 0.0]), (0, [1.0, 2.0])]
    rng = np.random.default_rng(4)
    cases += [(int(rng.integers(5, 60)), (rng.random(20) ** 9).tolist()) for _ in range(20)]
    rows = [(m, k, w, total) for m, (total, weights) in enumerate(cases) for k, w in enumerate(weights)]
    want = [(m, k, n) for m, (total, weights) in enumerate(cases) for k, n in enumerate(brute_counts(total, weights))]
    assert any(sum(max(int(w / sum(ws) * t), int(w > 0)) for w in ws) > t > len(ws) for t, ws in cases if sum(ws))  # a surplus
    assert sorted(map(tuple, apportioned(spark.createDataFrame(rows, "mol_id long, atom_idx long, weight double, total long")).collect())) == want
    values = ", ".join(f"({m}, {k}, {w!r}::DOUBLE, {t})" for m, k, w, t in rows)
    sql = apportion_sql(f"SELECT * FROM (VALUES {values}) AS t(mol_id, atom_idx, weight, total)")
    assert sorted(duckdb.sql("WITH " + sql.lstrip(", ")).fetchall()) == want


def test_every_atom_is_apportioned(spark, sf_dir):
    got, atoms = apportion_counts(spark, sf_dir).toPandas(), atoms_proxy(spark, sf_dir).toPandas()
    assert set(zip(got.mol_id, got.atom_idx)) == set(zip(atoms.mol_id, atoms.atom_idx))
    assert got["count"].min() == 1 and (got.groupby("mol_id")["count"].sum() == atoms.groupby("mol_id").size() * 5 // 4).all()


def test_percentiles_are_those_of_a_buffer(spark):
    """Hot values, one-row groups, nulls in keys and values, more parts than values."""
    import random

    from molsurf.operators.bench import percentiles

    rng = random.Random(4)
    rows = [("a", 1, float(rng.randint(0, 900))) for _ in range(2000)] + [("a", 1, 7.0)] * 1500 + [("b", 1, 3.5), (None, 2, 1.0), (None, 2, 2.0), (None, 2, None), ("c", 3, None)]
    df = spark.createDataFrame(rows, "k string, j long, v double").repartition(3)
    shares = {"low": 0.0, "q": 0.25, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = {(r["k"], r["j"]): tuple(r[s] for s in shares) for r in percentiles(df, ["k", "j"], "v", shares).collect()}
    want = {(r["k"], r["j"]): tuple(r[s] for s in shares) for r in df.groupBy("k", "j").agg(*[F.percentile("v", F.lit(q)).alias(s) for s, q in shares.items()]).collect()}
    assert got == want and len(got) == 4
    plan = percentiles(df, ["k", "j"], "v", shares)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
