"""Geometry operators over the proxy molecules, each with SQL that joins by brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CAP_STEPS, EPS, GOLDEN, MAX_SUPPORTS, PAIR_FILTER, PROBE, SIMPLEX_SHIFT
from ..functions import formulas as fm
from ..functions import kernels as kn
from ..functions.formulas import q6, with_steps
from ..operators import spatial as sp
from ..operators import tiles
from ..operators.bonds import bonds
from ..operators.outputs import crowded, limited, supports_of
from ..operators.points import apportioned
from ..operators.store import checkpointed, dealt
from ..sources import proxy
from ..sources.proxy import atoms_proxy

QUERIES, SQL = {}, {}
SEEDS = 192
ATOM_DIRECTIONS = 64
TAU = 6.283185307179586


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {proxy.SQL}{sql}"
        return f

    return add


def steps_sql(steps: fm.Steps) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in steps)


def rounded_sql(values: list[str]) -> str:
    return ", ".join(f"{q6(v)} AS {v}" for v in values)


# --- seeds ---------------------------------------------------------------


def seeds(atoms: DataFrame, n: int, radius: str) -> DataFrame:
    """n Fibonacci points on each atom's sphere; ids are sample-major, as k * atoms + atom."""
    count = Window.partitionBy("mol_id")
    each = atoms.withColumn("atoms", F.count("*").over(count)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = with_steps(each, fm.fibonacci("k", f"{n}e0"))
    return at.select("mol_id", "atom_idx", (F.col("k") * F.col("atoms") + F.col("atom_idx")).cast("long").alias("point_id"), *[(F.col(c) + F.col(radius) * F.col(f"d{c}")).alias(c) for c in "xyz"], "r", "radius")


def seeds_sql(n: int, radius: str) -> str:
    return f""", s AS (
  SELECT mol_id, atom_idx, (k * atoms + atom_idx)::BIGINT AS point_id, x + {radius} * dx AS x, y + {radius} * dy AS y, z + {radius} * dz AS z, r, radius
  FROM (SELECT *, {steps_sql(fm.fibonacci("k", f"{n}e0"))} FROM (SELECT e.*, count(*) OVER (PARTITION BY mol_id) AS atoms FROM e), (SELECT range AS k FROM range({n})))
)"""


def inside_sql(x: str = "s", r: str = "r", tolerance: int = 256) -> str:
    d2 = " + ".join(f"({x}.{c} - o.{c}) * ({x}.{c} - o.{c})" for c in "xyz")
    return f"EXISTS (SELECT 1 FROM e o WHERE o.mol_id = {x}.mol_id AND {fm.inside(f'({d2})', f'o.{r}', tolerance)})"


@query(seeds_sql(16, "radius") + f" SELECT mol_id, atom_idx, point_id, {rounded_sql(['x', 'y', 'z'])} FROM s")
def seed_fibonacci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.rounded(seeds(sp.expanded(atoms_proxy(spark, sf_dir)), 16, "radius"), ["mol_id", "atom_idx", "point_id"], ["x", "y", "z"])


def exposed(spark: SparkSession, sf_dir: str, n: int = SEEDS) -> DataFrame:
    e = sp.expanded(atoms_proxy(spark, sf_dir))
    return sp.outside(seeds(e, n, "r"), e, "r", sp.REACH)


@query(seeds_sql(SEEDS, "r") + f" SELECT mol_id, atom_idx, count(*) AS exposed FROM s WHERE NOT {inside_sql()} GROUP BY mol_id, atom_idx")
def seed_exposed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposed(spark, sf_dir).groupBy("mol_id", "atom_idx").agg(F.count("*").alias("exposed"))


@query(seeds_sql(SEEDS, "r") + f" SELECT mol_id, atom_idx, count(*) AS exposed, {q6(f'2e0 * {TAU} * max(r) * max(r) * count(*) / {SEEDS}e0')} AS area FROM s WHERE NOT {inside_sql()} GROUP BY mol_id, atom_idx")
def exposed_area_by_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exposed(spark, sf_dir).groupBy("mol_id", "atom_idx").agg(F.count("*").alias("exposed"), F.max("r").alias("r"))
    return got.select("mol_id", "atom_idx", "exposed", F.expr(q6(f"2e0 * {TAU} * r * r * exposed / {SEEDS}e0")).alias("area"))


@query(seeds_sql(24, "radius") + f" SELECT mol_id, point_id, {rounded_sql(['x', 'y', 'z'])} FROM s WHERE NOT {inside_sql(r='radius')}")
def inside_outside_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sp.expanded(atoms_proxy(spark, sf_dir))
    return sp.rounded(sp.outside(seeds(e, 24, "radius"), e, "radius", sp.REACH), ["mol_id", "point_id"], ["x", "y", "z"])


@query(seeds_sql(ATOM_DIRECTIONS, "r") + f" SELECT DISTINCT mol_id, atom_idx FROM s WHERE NOT {inside_sql()}")
def atom_exterior_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposed(spark, sf_dir, ATOM_DIRECTIONS).select("mol_id", "atom_idx").distinct()


# --- pairs ---------------------------------------------------------------

PAIRS = """, pairs AS (
  SELECT a.mol_id, a.atom_idx AS a, b.atom_idx AS b, a.x AS x1, a.y AS y1, a.z AS z1, a.r AS r1, b.x AS x2, b.y AS y2, b.z AS z2, b.r AS r2
  FROM e a JOIN e b ON a.mol_id = b.mol_id AND a.atom_idx < b.atom_idx
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < (a.r + b.r) * (a.r + b.r)
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) > (a.r - b.r) * (a.r - b.r)
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.pair_graph(atoms_proxy(spark, sf_dir))


def open_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(sp.open_atoms(atoms_proxy(spark, sf_dir)))  # read by each side of the joins


@query(PAIRS + f" SELECT mol_id, a, b, {q6('sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))')} AS d FROM pairs")
def pair_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("mol_id", "a", "b", F.expr(q6("sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))")).alias("d"))


CIRCLE = ["cx", "cy", "cz", "rad", "ux", "uy", "uz", "vx", "vy", "vz"]


@query(PAIRS + f" SELECT mol_id, a, b, {rounded_sql(CIRCLE)} FROM (SELECT *, {steps_sql(fm.pair_circle())} FROM pairs)")
def pair_circle_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.rounded(with_steps(pairs(spark, sf_dir), fm.pair_circle()), ["mol_id", "a", "b"], CIRCLE)


ARC96 = fm.arc("((k + 0.5e0) / 96e0)", PROBE)


@query(PAIRS + f", f AS (SELECT *, {steps_sql(ARC96)} FROM (SELECT *, {steps_sql(fm.pair_circle())} FROM pairs), (SELECT range AS k FROM range(96))) SELECT mol_id, a, b, {q6(f'{TAU} * {PROBE}e0 * max(alpha) * avg(axial)')} AS area FROM f GROUP BY mol_id, a, b")
def pair_patch_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the torus patch of each pair: 96 midpoints of the arc."""
    got = sp.along_arcs(pairs(spark, sf_dir), (np.arange(96) + 0.5) / 96, "mean double", lambda axial: [axial.mean(1)])
    return got.select("mol_id", "a", "b", F.expr(q6(f"{TAU} * {PROBE}e0 * alpha * mean")).alias("area"))


ARC128 = fm.arc("(k / 128e0)", PROBE)
CDF_SQL = f"""{PAIRS}, f AS (SELECT *, {steps_sql(ARC128)} FROM (SELECT *, {steps_sql(fm.pair_circle())} FROM pairs), (SELECT range AS k FROM range(129))),
g AS (SELECT *, (axial + lag(axial) OVER (PARTITION BY mol_id, a, b ORDER BY k)) / 256e0 AS step FROM f),
h AS (SELECT *, sum(coalesce(step, 0e0)) OVER (PARTITION BY mol_id, a, b ORDER BY k) AS run, sum(coalesce(step, 0e0)) OVER (PARTITION BY mol_id, a, b) AS total FROM g)
SELECT mol_id, a, b, k::INT AS k, {q6(f'run / greatest(total, {EPS})')} AS cdf FROM h"""


@query(CDF_SQL)
def pair_arc_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """129 knots of the arc's cumulative area, by trapezoids."""
    def shares(axial: np.ndarray) -> list[np.ndarray]:
        run = np.cumsum(np.pad((axial[:, 1:] + axial[:, :-1]) / 256.0, ((0, 0), (1, 0))), axis=1)
        return [run / np.maximum(run[:, -1:], EPS)]

    got = sp.along_arcs(pairs(spark, sf_dir), np.arange(129) / 128, "cdf array<double>", shares)
    return got.select("mol_id", "a", "b", F.posexplode("cdf").alias("k", "cdf")).withColumn("cdf", F.expr(q6("cdf")))


ANGLE = f"({TAU} * (k + 0.5e0) / {PAIR_FILTER}e0)"
ON_CIRCLE = fm.pair_circle() + fm.circle_point(ANGLE)


@query(PAIRS + f", s AS (SELECT mol_id, a, b, px AS x, py AS y, pz AS z FROM (SELECT *, {steps_sql(ON_CIRCLE)} FROM pairs, (SELECT range AS k FROM range({PAIR_FILTER}))) WHERE rad > 1e-8) SELECT DISTINCT mol_id, a, b FROM s WHERE NOT {inside_sql()}")
def pair_exterior_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with any of 24 probe centres on their circle outside all expanded spheres."""
    at = with_steps(sp.pair_graph(open_atoms(spark, sf_dir)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PAIR_FILTER - 1)))), ON_CIRCLE).where("rad > 1e-8")
    points = at.select("mol_id", "a", "b", *[F.col(f"p{c}").alias(c) for c in "xyz"])
    return sp.outside(points, sp.expanded(atoms_proxy(spark, sf_dir)), "r", sp.REACH).select("mol_id", "a", "b").distinct()


# --- triples -------------------------------------------------------------

TRIANGLES = PAIRS + """, tri AS (
  SELECT p.mol_id, p.a, p.b, q.b AS c FROM pairs p JOIN pairs q ON p.mol_id = q.mol_id AND p.a = q.a AND p.b < q.b
  JOIN pairs w ON w.mol_id = p.mol_id AND w.a = p.b AND w.b = q.b
)"""


@query(TRIANGLES + " SELECT mol_id, a, b, c FROM tri")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.triangles_by_cell(atoms_proxy(spark, sf_dir))


def capped(tri: DataFrame, most: int) -> DataFrame:
    """The first ``most`` triangles of each molecule in lexicographic order; the cap is the operator's feature."""
    w = Window.partitionBy("mol_id").orderBy("a", "b", "c")
    return tri.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= most)


@query(TRIANGLES + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY a, b, c)::INT AS ordinal FROM tri) WHERE ordinal <= 100")
def triangles_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a molecule's first ones are among the first ones of its cells
    return capped(sp.triangles_by_cell(atoms_proxy(spark, sf_dir), most=100), 100)


CENTERS = TRIANGLES + f""", base AS (
  SELECT t.*, a.x AS x1, a.y AS y1, a.z AS z1, a.r AS r1, b.x AS x2, b.y AS y2, b.z AS z2, b.r AS r2, c.x AS x3, c.y AS y3, c.z AS z3, c.r AS r3
  FROM tri t JOIN e a ON a.mol_id = t.mol_id AND a.atom_idx = t.a JOIN e b ON b.mol_id = t.mol_id AND b.atom_idx = t.b JOIN e c ON c.mol_id = t.mol_id AND c.atom_idx = t.c
), two AS (
  SELECT mol_id, a, b, c, sign, mx + sign_f * h * hx AS x, my + sign_f * h * hy AS y, mz + sign_f * h * hz AS z
  FROM (SELECT *, {steps_sql(fm.triple_centers())} FROM base), (SELECT 0::BIGINT AS sign, 1e0 AS sign_f UNION ALL SELECT 1, -1e0) WHERE ok
)"""


def centers_of(tri: DataFrame, atoms: DataFrame) -> DataFrame:
    """(mol_id, a, b, c, sign, x, y, z): the probe centres that touch three spheres; sign 0 is along the normal of a, b, c."""
    e = sp.expanded(atoms)
    at = tri
    for n, ident in ((1, "a"), (2, "b"), (3, "c")):
        at = at.join(sp.side(e, n, ident), ["mol_id", ident])
    return centers_at(at)


def centers_at(at: DataFrame) -> DataFrame:
    """The same for triples that have their spheres."""
    place = lambda sign, flip: F.struct("ok", F.lit(sign).cast("long").alias("sign"), *[(F.col(f"m{c}") + F.lit(flip) * F.col("h") * F.col(f"h{c}")).alias(c) for c in "xyz"])
    both = F.inline(F.array(place(0, 1.0), place(1, -1.0)))  # its columns are plain, so filters and later expressions do not repeat the steps
    return with_steps(at, fm.triple_centers()).select("mol_id", "a", "b", "c", both).where("ok").drop("ok")


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centers_at(sp.triangles_by_cell(atoms_proxy(spark, sf_dir), places=True))


ID3 = ["mol_id", "a", "b", "c", "sign"]


@query(CENTERS + f" SELECT mol_id, a, b, c, sign, {rounded_sql(['x', 'y', 'z'])} FROM two")
def triple_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.rounded(centers(spark, sf_dir), ID3, ["x", "y", "z"])


FEASIBLE = CENTERS + f", ok AS (SELECT * FROM two s WHERE NOT {inside_sql(tolerance=100_000_000)})"


def feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres outside all expanded spheres; the three touched ones pass by the tolerance. Only open atoms have any."""
    some = open_atoms(spark, sf_dir)
    return sp.outside(centers_of(sp.triangles(sp.pair_graph(some)), some), sp.expanded(atoms_proxy(spark, sf_dir)), "r", sp.REACH, 100_000_000)


@query(FEASIBLE + f" SELECT mol_id, a, b, c, sign, {rounded_sql(['x', 'y', 'z'])} FROM ok")
def triple_centers_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.rounded(feasible(spark, sf_dir), ID3, ["x", "y", "z"])


TOLERANCE = 0.5
DEDUP = FEASIBLE + f""", keyed AS (
  SELECT *, round_even(x / {TOLERANCE}e0, 0)::BIGINT AS kx, round_even(y / {TOLERANCE}e0, 0)::BIGINT AS ky, round_even(z / {TOLERANCE}e0, 0)::BIGINT AS kz,
         ((a * 1000000 + b) * 1000000 + c) * 2 + sign AS ordinal FROM ok
), kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY mol_id, kx, ky, kz ORDER BY ordinal) = 1)"""


def deduplicated(found: DataFrame, tolerance: float) -> DataFrame:
    """Of centres with equal rounded coordinates, the first by (a, b, c, sign)."""
    keyed = sp.rounded_keys(found, tolerance).withColumn("ordinal", ((F.col("a") * 1000000 + F.col("b")) * 1000000 + F.col("c")) * 2 + F.col("sign"))
    return sp.first_seen(keyed, ["mol_id", "kx", "ky", "kz"], "ordinal")


@query(DEDUP + f" SELECT mol_id, a, b, c, sign, kx, ky, kz, {rounded_sql(['x', 'y', 'z'])} FROM kept")
def center_dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.rounded(deduplicated(feasible(spark, sf_dir), TOLERANCE), [*ID3, "kx", "ky", "kz"], ["x", "y", "z"])


SUPPORT_TOLERANCE = 0.05


@query(
    DEDUP
    + f""", touch AS (
  SELECT k.mol_id, k.a, k.b, k.c, k.sign, o.atom_idx, abs(sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) + (k.z - o.z) * (k.z - o.z)) - o.r) AS off,
         o.atom_idx IN (k.a, k.b, k.c) AS seed FROM kept k JOIN e o ON o.mol_id = k.mol_id
), top AS (SELECT *, row_number() OVER (PARTITION BY mol_id, a, b, c, sign ORDER BY CASE WHEN seed THEN 0 ELSE 1 END, floor(off * 1e9), atom_idx) AS rank FROM touch WHERE seed OR off <= {SUPPORT_TOLERANCE}e0)
SELECT mol_id, a, b, c, sign, atom_idx FROM top WHERE rank <= {MAX_SUPPORTS}"""
)
def center_supports_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms that a centre touches: its three seeds, then by residual, at most 16."""
    kept = deduplicated(feasible(spark, sf_dir), TOLERANCE).select(*ID3, *[F.col(c).alias(f"{c}a") for c in "xyz"])
    e = sp.expanded(atoms_proxy(spark, sf_dir)).select("mol_id", "atom_idx", F.col("r").alias("rb"), *[F.col(c).alias(f"{c}b") for c in "xyz"])
    touch = sp.near(kept, e, sp.REACH + SUPPORT_TOLERANCE).withColumn("off", F.abs(F.sqrt(F.expr(fm.dist2("a", "b"))) - F.col("rb")))
    touch = touch.withColumn("seed", F.col("atom_idx").isin(F.col("a"), F.col("b"), F.col("c"))).where(f"seed OR off <= {SUPPORT_TOLERANCE}")
    w = Window.partitionBy(*ID3).orderBy(F.when(F.col("seed"), 0).otherwise(1), F.floor(F.col("off") * 1e9), "atom_idx")
    return touch.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MAX_SUPPORTS).select(*ID3, "atom_idx")


# --- accessibility -------------------------------------------------------

SPACING = 2.0
SPHERE = "SELECT mol_id, (min(x) + max(x)) / 2e0 AS mx, (min(y) + max(y)) / 2e0 AS my, (min(z) + max(z)) / 2e0 AS mz, max(r) AS mr FROM e GROUP BY mol_id"


@query(
    FEASIBLE
    + f""", mid AS ({SPHERE}), far AS (
  SELECT m.*, max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) OVER (PARTITION BY m.mol_id) + mr + 1e0 AS out_r FROM mid m JOIN e USING (mol_id)
), ray AS (
  SELECT ok.*, ok.x AS px, ok.y AS py, ok.z AS pz, mx + out_r * (x - mx) / n AS ex, my + out_r * (y - my) / n AS ey, mz + out_r * (z - mz) / n AS ez
  FROM (SELECT DISTINCT mol_id, mx, my, mz, out_r FROM far) f JOIN ok USING (mol_id), LATERAL (SELECT sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS n)
), hit AS (
  SELECT DISTINCT ray.mol_id, a, b, c, sign FROM ray JOIN (SELECT mol_id, x AS x2, y AS y2, z AS z2, r AS r2 FROM e) o USING (mol_id),
  LATERAL (SELECT {steps_sql(fm.segment_distance2())}) WHERE {fm.inside("dd", "r2", 100_000_000)}
)
SELECT mol_id, a, b, c, sign, NOT EXISTS (SELECT 1 FROM hit h WHERE (h.mol_id, h.a, h.b, h.c, h.sign) = (ok.mol_id, ok.a, ok.b, ok.c, ok.sign)) AS clear FROM ok"""
)
def segment_clearance_radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the segment from a centre straight away from the molecule's middle leaves it without crossing an expanded sphere."""
    e = sp.expanded(atoms_proxy(spark, sf_dir))
    mid = e.groupBy("mol_id").agg(*[((F.min(c) + F.max(c)) / 2.0).alias(f"m{c}") for c in "xyz"], F.max("r").alias("mr"))
    reach = e.join(mid, "mol_id").groupBy("mol_id", "mx", "my", "mz", "mr").agg(F.max(F.expr("sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))")).alias("far"))
    reach = reach.withColumn("out_r", F.col("far") + F.col("mr") + 1.0)
    ok = checkpointed(feasible(spark, sf_dir))  # read twice; and expressions that reach back to the triples would be too long for generated code
    ray = ok.join(reach, "mol_id").withColumn("n", F.expr("sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))"))
    ray = ray.select(*ID3, *[F.col(c).alias(f"p{c}") for c in "xyz"], *[(F.col(f"m{c}") + F.col("out_r") * (F.col(c) - F.col(f"m{c}")) / F.col("n")).alias(f"e{c}") for c in "xyz"])
    clear = tiles.clear_segments(ray, e, tiles.frames(atoms_proxy(spark, sf_dir), PROBE, SPACING, 1 << 62, 2 * sp.REACH), fm.segment_distance2(), fm.inside("dd", "r2", 100_000_000))
    return ok.select(*ID3).join(clear.select(*ID3).withColumn("clear", F.lit(True)), ID3, "left").select(*ID3, F.col("clear").isNotNull().alias("clear"))


VOXELS = f""", box AS (
  SELECT mol_id, min(x) - pad AS lx, min(y) - pad AS ly, min(z) - pad AS lz, ceil((max(x) - min(x) + 2 * pad) / {SPACING}e0)::BIGINT + 1 AS nx,
         ceil((max(y) - min(y) + 2 * pad) / {SPACING}e0)::BIGINT + 1 AS ny, ceil((max(z) - min(z) + 2 * pad) / {SPACING}e0)::BIGINT + 1 AS nz
  FROM (SELECT *, greatest({2 * SPACING}e0, max(r) OVER (PARTITION BY mol_id) + {SPACING}e0) AS pad FROM e) GROUP BY mol_id, pad
), vox AS (
  SELECT mol_id, ix, iy, iz, nx, ny, nz, lx + ix * {SPACING}e0 AS x, ly + iy * {SPACING}e0 AS y, lz + iz * {SPACING}e0 AS z
  FROM box, LATERAL (SELECT unnest(range(nx)) AS ix), LATERAL (SELECT unnest(range(ny)) AS iy), LATERAL (SELECT unnest(range(nz)) AS iz)
), free AS (
  SELECT * FROM vox v WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.mol_id = v.mol_id AND (v.x - o.x) * (v.x - o.x) + (v.y - o.y) * (v.y - o.y) + (v.z - o.z) * (v.z - o.z) < o.r * o.r)
)"""


def voxels(e: DataFrame, spacing: float) -> DataFrame:
    """(mol_id, ix, iy, iz, nx, ny, nz, x, y, z): the grid around each molecule."""
    box = e.groupBy("mol_id").agg(*[F.min(c).alias(f"min{c}") for c in "xyz"], *[F.max(c).alias(f"max{c}") for c in "xyz"], F.greatest(F.lit(2 * spacing), F.max("r") + spacing).alias("pad"))
    for c in "xyz":
        box = box.withColumn(f"l{c}", F.col(f"min{c}") - F.col("pad")).withColumn(f"n{c}", F.ceil((F.col(f"max{c}") - F.col(f"min{c}") + 2 * F.col("pad")) / F.lit(spacing)).cast("long") + 1)
    for c in "xyz":
        box = box.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{c}") - 1))).withColumn(c, F.col(f"l{c}") + F.col(f"i{c}") * F.lit(spacing))
    return box.select("mol_id", "ix", "iy", "iz", "nx", "ny", "nz", "x", "y", "z")


def free_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels inside no expanded sphere: strictly, without tolerance."""
    e = sp.expanded(atoms_proxy(spark, sf_dir))
    return sp.outside(voxels(e, SPACING), e, "r", sp.REACH, 0)


@query(VOXELS + " SELECT mol_id, ix, iy, iz FROM free")
def voxel_free_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return free_voxels(spark, sf_dir).select("mol_id", "ix", "iy", "iz")


@query(
    VOXELS
    + """, reach AS (
  SELECT mol_id, ix, iy, iz FROM free WHERE ix IN (0, nx - 1) OR iy IN (0, ny - 1) OR iz IN (0, nz - 1)
  UNION
  SELECT f.mol_id, f.ix, f.iy, f.iz FROM reach r JOIN free f ON f.mol_id = r.mol_id AND abs(f.ix - r.ix) + abs(f.iy - r.iy) + abs(f.iz - r.iz) = 1
) SELECT mol_id, ix, iy, iz FROM reach"""
)
def flood_fill_exterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free voxels that a probe reaches from the grid's faces: one grid per task, bounded by its number of cells; larger ones go by ``flood_fill_by_blocks``."""
    from ..functions.kernels import flood_group

    return free_voxels(spark, sf_dir).select("mol_id", "ix", "iy", "iz", "nx", "ny", "nz").groupBy("mol_id").applyInPandas(flood_group, "mol_id long, ix long, iy long, iz long")


@query(SQL["flood_fill_exterior"].removeprefix(f"WITH RECURSIVE {proxy.SQL}"))
def flood_fill_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for grids of any size: components inside blocks of the grid, then links between neighbours."""
    atoms = atoms_proxy(spark, sf_dir)
    frame = tiles.frames(atoms, PROBE, SPACING, 1 << 62)
    return tiles.reached_cells(tiles.flood_by_blocks(atoms, frame, PROBE), frame)


# --- smooth distance -----------------------------------------------------

SMOOTH, SDF_SEEDS, FEATURE = 0.3, 8, 0.1
SDF_SQL = seeds_sql(SDF_SEEDS, "r") + f""", terms AS (
  SELECT s.mol_id, s.point_id, s.x, s.y, s.z, o.atom_idx, o.x AS ox, o.y AS oy, o.z AS oz, dist, (o.r - dist) / {SMOOTH}e0 AS v
  FROM s JOIN e o ON o.mol_id = s.mol_id, LATERAL (SELECT sqrt((s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y) + (s.z - o.z) * (s.z - o.z)) AS dist)
), shifted AS (SELECT *, exp(v - vmax) AS w FROM (SELECT *, max(v) OVER (PARTITION BY mol_id, point_id) AS vmax FROM terms)
), sums AS (
  SELECT mol_id, point_id, max(x) AS x, max(y) AS y, max(z) AS z, max(vmax) AS vmax, sum(w) AS w, sum(w * (x - ox) / dist) AS gx, sum(w * (y - oy) / dist) AS gy, sum(w * (z - oz) / dist) AS gz
  FROM shifted GROUP BY mol_id, point_id
), sdf AS (SELECT *, -{SMOOTH}e0 * (vmax + ln(w)) AS value, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM sums)"""


#: Beyond this many smoothing lengths below the largest term, terms add less than 5e-18 each: a billion atoms stay under 1e-8.
SDF_TERMS = 40
#: Terms of a weight of ``FEATURE`` are less than this below the largest one.
SDF_HEAVY = 2.5


def sdf_terms(points: DataFrame, e: DataFrame, terms: float = SDF_TERMS) -> DataFrame:
    """Each row of points (mol_id, point_id, x, y, z and more) with the atoms (atom_idx, ox, oy, oz) of its molecule whose exponent v is at least -terms.

    Points must lie on or inside some expanded sphere, as seeds do, so the largest
    exponent is not negative, and atoms farther than their radius and ``SDF_TERMS``
    smoothing lengths do not count: an equi-join on cells finds the others.
    """
    ball = e.select("mol_id", "atom_idx", *[F.col(c).alias(f"{c}b") for c in "xyzr"])
    at = points.withColumnsRenamed({c: f"{c}a" for c in "xyz"})
    t = sp.near(at, ball, sp.REACH + terms * SMOOTH)
    t = t.withColumnsRenamed({f"{c}a": c for c in "xyz"} | {f"{c}b": f"o{c}" for c in "xyzr"})
    return with_steps(t, [("dist", "sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz))"), ("v", f"(`or` - dist) / {SMOOTH}e0")]).where(F.col("v") >= -float(terms))


#: A place and an atom whose term may count are at most so far apart.
SDF_REACH = sp.REACH + SDF_TERMS * SMOOTH


def sdf_of(points: DataFrame, e: DataFrame) -> DataFrame:
    """value, gradient g and its length gn at each point, its sum w and largest exponent vmax: a smooth minimum of the distances to the expanded spheres.

    Points must lie on or inside some expanded sphere, as for ``sdf_terms``. Space is cut
    into cells of twice ``SDF_REACH``; an atom goes to the cells within that reach of it,
    eight at most, and a cell's task sums its points' terms cube by cube. Pairs of points
    and atoms are never rows. Points without a place have no value (null).
    """
    edge, keys = 2 * SDF_REACH, ["mol_id", "_cx", "_cy", "_cz"]
    at = points.select("mol_id", "point_id", *"xyz").withColumns({f"_c{c}": F.floor(F.col(c) / F.lit(edge)).cast("int") for c in "xyz"})
    ball = e.where("x is not null and y is not null and z is not null").select("mol_id", *"xyzr")
    for c in "xyz":
        first, last = [F.floor((F.col(c) + F.lit(s * (SDF_REACH + 1e-6))) / F.lit(edge)).cast("int") for s in (-1, 1)]
        ball = ball.withColumn(f"_c{c}", F.explode(F.sequence(first, last)))
    names = ["vmax", "total", "gx", "gy", "gz"]

    def run(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        got = kn.smooth_sums(own[list("xyz")].to_numpy(float), near[list("xyz")].to_numpy(float), near["r"].to_numpy(float), SMOOTH, SDF_TERMS)
        return pd.concat([own[["mol_id", "point_id", *"xyz"]].reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

    kinds = dict(points.dtypes)
    schema = f"mol_id {kinds['mol_id']}, point_id {kinds['point_id']}, " + ", ".join(f"{c} double" for c in [*"xyz", *names])
    sums = dealt(at, *keys).groupBy(*keys).cogroup(dealt(ball, *keys).groupBy(*keys)).applyInPandas(run, schema)
    sums = sums.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in names})
    return with_steps(sums, [("w", "total * exp(vmax)"), ("value", f"-{SMOOTH}e0 * (vmax + ln(total))"), ("gn", "sqrt(gx * gx + gy * gy + gz * gz)")])


def sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sp.expanded(atoms_proxy(spark, sf_dir))
    return sdf_of(seeds(e, SDF_SEEDS, "r"), e)


@query(SDF_SQL + f" SELECT mol_id, point_id, {rounded_sql(['value'])} FROM sdf")
def sdf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.rounded(sdf(spark, sf_dir), ["mol_id", "point_id"], ["value"])


@query(SDF_SQL + f" SELECT mol_id, point_id, {', '.join(f'{q6(f"g{c} / gn")} AS n{c}' for c in 'xyz')} FROM sdf")
def sdf_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf(spark, sf_dir).select("mol_id", "point_id", *[F.expr(q6(f"g{c} / gn")).alias(f"n{c}") for c in "xyz"])


@query(SDF_SQL + f" SELECT mol_id, point_id, {', '.join(f'{q6(f"{c} - value * g{c} / gn")} AS {c}' for c in 'xyz')} FROM sdf")
def sdf_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf(spark, sf_dir).select("mol_id", "point_id", *[F.expr(q6(f"{c} - value * g{c} / gn")).alias(c) for c in "xyz"])


@query(SDF_SQL + f", wt AS (SELECT mol_id, point_id, atom_idx, w / sum(w) OVER (PARTITION BY mol_id, point_id) AS weight, w = 1e0 AS top FROM shifted) SELECT mol_id, point_id, atom_idx, {rounded_sql(['weight'])} FROM wt WHERE weight >= {FEATURE}e0 OR top")
def sdf_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of softmax weight at least 0.1, or of the largest weight, at each point."""
    e = sp.expanded(atoms_proxy(spark, sf_dir))
    sums = sdf_of(seeds(e, SDF_SEEDS, "r"), e).select("mol_id", "point_id", *"xyz", "vmax", F.col("w").alias("total"))
    # a weight of 0.1 is an exponent at most ln(10) below the largest one, which is not negative
    w = sdf_terms(sums, e, SDF_HEAVY).withColumn("w", F.exp(F.col("v") - F.col("vmax"))).withColumn("weight", F.exp("v") / F.col("total"))
    return sp.rounded(w.where(f"weight >= {FEATURE} OR w = 1.0"), ["mol_id", "point_id", "atom_idx"], ["weight"])


@query(
    """, low AS (SELECT *, min(x) OVER w AS lx, min(y) OVER w AS ly, min(z) OVER w AS lz FROM e WINDOW w AS (PARTITION BY mol_id))
SELECT mol_id, cx, cy, cz, count(*) AS n, """
    + ", ".join(f"{q6(f'avg({c})')} AS {c}" for c in "xyz")
    + " FROM (SELECT *, floor((x - lx) / 2.5e0)::BIGINT AS cx, floor((y - ly) / 2.5e0)::BIGINT AS cy, floor((z - lz) / 2.5e0)::BIGINT AS cz FROM low) GROUP BY mol_id, cx, cy, cz"
)
def grid_subsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.rounded(sp.grid_mean(atoms_proxy(spark, sf_dir), 2.5), ["mol_id", "cx", "cy", "cz", "n"], ["x", "y", "z"])


# --- tiles ---------------------------------------------------------------

TILE, OVERLAP = 6.0, 4.0
TILES = f""", tb AS (
  SELECT mol_id, min(x) - max(r) AS lx, min(y) - max(r) AS ly, min(z) - max(r) AS lz, greatest(1, ceil((max(x) - min(x) + 2 * max(r)) / {TILE}e0))::BIGINT AS nx,
         greatest(1, ceil((max(y) - min(y) + 2 * max(r)) / {TILE}e0))::BIGINT AS ny, greatest(1, ceil((max(z) - min(z) + 2 * max(r)) / {TILE}e0))::BIGINT AS nz FROM e GROUP BY mol_id
), grid AS (
  SELECT mol_id, (ix * ny + iy) * nz + iz AS tile_id, lx + ix * {TILE}e0 AS x0, ly + iy * {TILE}e0 AS y0, lz + iz * {TILE}e0 AS z0
  FROM tb, LATERAL (SELECT unnest(range(nx)) AS ix), LATERAL (SELECT unnest(range(ny)) AS iy), LATERAL (SELECT unnest(range(nz)) AS iz)
), ta AS (
  SELECT g.mol_id, g.tile_id, e.atom_idx FROM grid g JOIN e USING (mol_id)
  WHERE {" AND ".join(f"e.{c} + e.r >= g.{c}0 - {OVERLAP}e0 AND e.{c} - e.r <= g.{c}0 + {TILE + OVERLAP}e0" for c in "xyz")}
)"""


def tiles_of(e: DataFrame, size: float) -> DataFrame:
    """Bounds and tile counts of each molecule."""
    b = e.groupBy("mol_id").agg(*[(F.min(c) - F.max("r")).alias(f"l{c}") for c in "xyz"], *[(F.max(c) - F.min(c) + 2 * F.max("r")).alias(f"span{c}") for c in "xyz"])
    return b.select("mol_id", *[f"l{c}" for c in "xyz"], *[F.greatest(F.lit(1), F.ceil(F.col(f"span{c}") / F.lit(size))).cast("long").alias(f"n{c}") for c in "xyz"])


def tile_span(c: str, size: float, overlap: float) -> tuple[Column, Column]:
    """First and last tile on an axis that an expanded sphere may reach, and perhaps one more at each end."""
    first = F.greatest(F.lit(0), F.ceil((F.col(c) - F.col("r") - F.lit(size + overlap) - F.col(f"l{c}")) / F.lit(size)) - 1)
    last = F.least(F.col(f"n{c}") - 1, F.floor((F.col(c) + F.col("r") + F.lit(overlap) - F.col(f"l{c}")) / F.lit(size)) + 1)
    return first.cast("long"), last.cast("long")


def tile_fits(c: str, start: Column, size: float, overlap: float) -> Column:
    return (F.col(c) + F.col("r") >= start - overlap) & (F.col(c) - F.col("r") <= start + F.lit(size + overlap))


def tile_atoms(e: DataFrame, size: float, overlap: float) -> DataFrame:
    """(mol_id, tile_id, atom_idx): each atom with the tiles whose widened box its expanded sphere's box meets; the atom computes its tiles, so there is no range join."""
    at = e.join(tiles_of(e, size), "mol_id")
    for c in "xyz":
        at = at.withColumn(f"i{c}", F.explode(F.sequence(*tile_span(c, size, overlap)))).withColumn(f"{c}0", F.col(f"l{c}") + F.col(f"i{c}") * F.lit(size))
        at = at.where(tile_fits(c, F.col(f"{c}0"), size, overlap))
    return at.select("mol_id", ((F.col("ix") * F.col("ny") + F.col("iy")) * F.col("nz") + F.col("iz")).alias("tile_id"), "atom_idx")


@query(TILES + f" SELECT mol_id, {rounded_sql(['lx', 'ly', 'lz'])}, nx, ny, nz FROM tb")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tiles_of(sp.expanded(atoms_proxy(spark, sf_dir)), TILE)
    return b.select("mol_id", *[F.expr(q6(f"l{c}")).alias(f"l{c}") for c in "xyz"], "nx", "ny", "nz")


@query(TILES + " SELECT mol_id, tile_id, atom_idx FROM ta")
def tile_atom_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_atoms(sp.expanded(atoms_proxy(spark, sf_dir)), TILE, OVERLAP)


@query(PAIRS + TILES + " SELECT p.mol_id, x.tile_id, p.a, p.b FROM pairs p JOIN ta x ON x.mol_id = p.mol_id AND x.atom_idx = p.a JOIN ta y ON y.mol_id = p.mol_id AND y.tile_id = x.tile_id AND y.atom_idx = p.b")
def tile_pair_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crossing pair with the tiles that both atoms reach: an atom's tiles are a range on each axis, so a pair computes its own from the two."""
    atoms = atoms_proxy(spark, sf_dir)
    at = sp.expanded(atoms).join(tiles_of(sp.expanded(atoms), TILE), "mol_id")
    for c in "xyz":
        first, last = tile_span(c, TILE, OVERLAP)
        fits = lambda i: tile_fits(c, F.col(f"l{c}") + i * F.lit(TILE), TILE, OVERLAP)  # noqa: B023, E731
        at = at.withColumn("_i", F.filter(F.sequence(first, last), fits)).withColumns({f"f{c}": F.array_min("_i"), f"g{c}": F.array_max("_i")}).drop("_i")
    at = at.select(*atoms.columns, *[f"{s}{c}" for s in "fg" for c in "xyz"], "ny", "nz")
    p = sp.pair_graph(at, keep=[f"{s}{c}" for s in "fg" for c in "xyz"], keep_first=["ny", "nz"])
    low, high = {c: F.greatest(f"f{c}1", f"f{c}2") for c in "xyz"}, {c: F.least(f"g{c}1", f"g{c}2") for c in "xyz"}
    p = p.where((low["x"] <= high["x"]) & (low["y"] <= high["y"]) & (low["z"] <= high["z"]))
    p = p.select("mol_id", "a", "b", "ny", "nz", *[v.alias(f"l{c}") for c, v in low.items()], *[v.alias(f"h{c}") for c, v in high.items()])
    for c in "xyz":
        p = p.withColumn(f"i{c}", F.explode(F.sequence(f"l{c}", f"h{c}")))
    return p.select("mol_id", ((F.col("ix") * F.col("ny") + F.col("iy")) * F.col("nz") + F.col("iz")).alias("tile_id"), "a", "b")


OWNER = "".join(f"least(n{c} - 1, greatest(0, floor(({c} - l{c}) / {TILE}e0)))|" for c in "xyz").split("|")


@query(seeds_sql(12, "r") + TILES + f" SELECT mol_id, point_id, (({OWNER[0]} * ny + {OWNER[1]}) * nz + {OWNER[2]})::BIGINT AS tile_id FROM s JOIN tb USING (mol_id)")
def tile_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sp.expanded(atoms_proxy(spark, sf_dir))
    return seeds(e, 12, "r").join(tiles_of(e, TILE), "mol_id").select("mol_id", "point_id", F.expr(f"cast(({OWNER[0]} * ny + {OWNER[1]}) * nz + {OWNER[2]} as bigint)").alias("tile_id"))


@query(seeds_sql(48, "radius") + f" SELECT mol_id, min(point_id) AS point_id, kx, ky, kz FROM (SELECT *, round_even(x / {TOLERANCE}e0, 0)::BIGINT AS kx, round_even(y / {TOLERANCE}e0, 0)::BIGINT AS ky, round_even(z / {TOLERANCE}e0, 0)::BIGINT AS kz FROM s) GROUP BY mol_id, kx, ky, kz")
def tile_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of equal rounded place are one: the first by id."""
    points = seeds(sp.expanded(atoms_proxy(spark, sf_dir)), 48, "radius")
    return sp.first_seen(sp.rounded_keys(points, TOLERANCE), ["mol_id", "kx", "ky", "kz"], "point_id").select("mol_id", "point_id", "kx", "ky", "kz")


TILE_CENTERS = FEASIBLE + TILES + f""", first AS (
  SELECT * FROM (SELECT *, round_even(x / 1e-4, 0)::BIGINT AS kx, round_even(y / 1e-4, 0)::BIGINT AS ky, round_even(z / 1e-4, 0)::BIGINT AS kz FROM ok)
  QUALIFY row_number() OVER (PARTITION BY mol_id, kx, ky, kz ORDER BY ((a * 1000000 + b) * 1000000 + c) * 2 + sign) = 1
) SELECT mol_id, a, b, c, sign, kx, ky, kz,
  (({" * ny + ".join(f"least(n{c} - 1, greatest(0, floor((k{c} * 1e-4 - l{c}) / {TILE}e0)))" for c in "xy")}) * nz + least(nz - 1, greatest(0, floor((kz * 1e-4 - lz) / {TILE}e0))))::BIGINT AS tile_id
FROM first JOIN tb USING (mol_id)"""


@query(TILE_CENTERS)
def tile_triple_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feasible probe centres of triples found inside tiles, each by the tile that owns its rounded place; of equal places, the first."""
    from . import samplers, spread

    blocks = samplers.Blocks()
    _, frame, near = spread.prepared(atoms_proxy(spark, sf_dir), PROBE, blocks, SPACING, 1 << 62, TILE)
    found = spread.found_in_tiles(near, frame, PROBE, None, blocks, False, True, sample=False)
    kept = sp.first_seen(found.where("kind = 0"), ["mol_id", "kx", "ky", "kz"], "block_id").join(frame.select("mol_id", "n"), "mol_id")
    triple = F.floor(F.col("block_id") / 2).cast("long")
    a, b, c = F.floor(triple / (F.col("n") * F.col("n"))).cast("long"), F.floor(triple / F.col("n")).cast("long") % F.col("n"), triple % F.col("n")
    return kept.select("mol_id", a.alias("a"), b.alias("b"), c.alias("c"), F.col("sign").cast("long").alias("sign"), "kx", "ky", "kz", F.col("part").alias("tile_id"))


# --- generators ----------------------------------------------------------


def apportion_sql(weights: str) -> str:
    """Counts for a query's (mol_id, atom_idx, weight, total), by the rule of ``apportioned``."""
    return f""", w AS ({weights}),
v AS (SELECT *, sum(weight) OVER (PARTITION BY mol_id) AS mass, row_number() OVER (PARTITION BY mol_id ORDER BY atom_idx) AS place FROM w),
q AS (SELECT *, CASE WHEN mass > 0 THEN round(weight / mass * total, 9) WHEN place = 1 THEN total::DOUBLE ELSE 0e0 END AS share FROM v),
f AS (SELECT *, share - floor(share) AS rest, CASE WHEN total <= 0 THEN 0 ELSE greatest(floor(share)::BIGINT, CASE WHEN weight > 0 THEN 1 ELSE 0 END) END AS base FROM q),
g AS (SELECT *, greatest(total, 0) - sum(base) OVER (PARTITION BY mol_id) AS gap, row_number() OVER (PARTITION BY mol_id ORDER BY rest DESC, atom_idx) AS rank,
  base - CASE WHEN weight > 0 AND base > 0 THEN 1 ELSE 0 END AS spare FROM f),
h AS (SELECT *, sum(spare) OVER (PARTITION BY mol_id ORDER BY rest, atom_idx ROWS UNBOUNDED PRECEDING) - spare AS before FROM g)
SELECT mol_id, atom_idx, (base + CASE WHEN gap > 0 AND rank <= gap THEN 1 WHEN gap < 0 THEN -least(spare, greatest(-gap - before, 0)) ELSE 0 END)::BIGINT AS count FROM h"""


@query(apportion_sql("SELECT mol_id, atom_idx, radius AS weight, count(*) OVER (PARTITION BY mol_id) * 5 // 4 AS total FROM atoms"))
def apportion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points for every four atoms of a molecule among all its atoms, in proportion to radius."""
    total = F.floor(F.count("*").over(Window.partitionBy("mol_id")) * 5 / 4).cast("long")
    return apportioned(atoms_proxy(spark, sf_dir).select("mol_id", "atom_idx", F.col("radius").alias("weight"), total.alias("total")))


#: Points of a triangle: at least so many, by its atoms.
WANTED = "(1 + (a + b + c) % 12)"
LEVEL = f"cast(ceil((sqrt(8e0 * {WANTED} + 1e0) - 3e0) / 2e0) as bigint)"


@query(
    TRIANGLES
    + f""", levels AS (SELECT *, {LEVEL} AS level FROM tri), grid AS (SELECT *, level - i - j AS k FROM levels, LATERAL (SELECT unnest(range(level + 1)) AS i), LATERAL (SELECT unnest(range(level + 1 - i)) AS j))
SELECT g.mol_id, g.a, g.b, g.c, i, j, k, {', '.join(f"{q6(f'(i * p.{c} + j * q.{c} + k * r.{c}) / greatest(level, 1)')} AS {c}" for c in 'xyz')}
FROM grid g JOIN e p ON p.mol_id = g.mol_id AND p.atom_idx = g.a JOIN e q ON q.mol_id = g.mol_id AND q.atom_idx = g.b JOIN e r ON r.mol_id = g.mol_id AND r.atom_idx = g.c"""
)
def barycentric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on every triangle of atoms: the grid of the least level L with (L + 1)(L + 2) / 2 >= the points wanted; weights are (i, j, k) / L."""
    at = sp.triangles_by_cell(atoms_proxy(spark, sf_dir), places=True)
    at = at.withColumn("level", F.expr(LEVEL)).withColumn("i", F.explode(F.expr("sequence(0L, level)")))
    at = at.withColumn("j", F.explode(F.expr("sequence(0L, level - i)"))).withColumn("k", F.expr("level - i - j"))
    return at.select("mol_id", "a", "b", "c", "i", "j", "k", *[F.expr(q6(f"(i * {c}1 + j * {c}2 + k * {c}3) / greatest(level, 1)")).alias(c) for c in "xyz"])


SIMPLEX = f"(atom_idx + 1) * (slot * {GOLDEN}e0 + {SIMPLEX_SHIFT}e0)"


@query(f", raw AS (SELECT mol_id, atom_idx, j.range AS slot FROM e, range(1, 8) j WHERE j.range <= 4 + atom_idx % 4), w AS (SELECT *, {SIMPLEX} - floor({SIMPLEX}) + 0.05e0 AS w FROM raw) SELECT mol_id, atom_idx, slot, {q6('w / sum(w) OVER (PARTITION BY mol_id, atom_idx)')} AS weight FROM w")
def simplex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every atom a low-discrepancy row of weights over 4 to 7 supports."""
    weight = lambda slot: f"(atom_idx + 1) * ({slot} * {GOLDEN}e0 + {SIMPLEX_SHIFT}e0)"
    rows = F.expr(f"transform(sequence(1L, 4L + atom_idx % 4), slot -> {weight('slot')} - floor({weight('slot')}) + 0.05e0)")
    w = atoms_proxy(spark, sf_dir).select("mol_id", "atom_idx", rows.alias("w")).withColumn("total", F.expr("aggregate(w, 0e0, (s, x) -> s + x)"))
    return w.select("mol_id", "atom_idx", "total", F.posexplode("w").alias("slot", "v")).select("mol_id", "atom_idx", (F.col("slot") + 1).cast("long").alias("slot"), F.expr(q6("v / total")).alias("weight"))


CAP = [
    ("s", "atom_idx + 0.5e0"),
    ("h", f"s * {CAP_STEPS[0]}e0 - floor(s * {CAP_STEPS[0]}e0)"),
    ("phi", f"{TAU} * (s * {CAP_STEPS[1]}e0 + {CAP_STEPS[2]}e0 - floor(s * {CAP_STEPS[1]}e0 + {CAP_STEPS[2]}e0))"),
    ("cosine", "1e0 - h * (1e0 - 0.25e0)"),
    ("sine", "sqrt(greatest(1e0 - cosine * cosine, 0e0))"),
    ("px", "x + r * sine * cos(phi)"),
    ("py", "y + r * sine * sin(phi)"),
    ("pz", "z + r * cosine"),
]


@query(f" SELECT mol_id, atom_idx, {rounded_sql(['px', 'py', 'pz'])} FROM (SELECT *, {steps_sql(CAP)} FROM e)")
def cap_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every atom a point of its expanded sphere, on the cap of cosine 0.25 around z, by a low-discrepancy sequence."""
    return sp.rounded(with_steps(sp.expanded(atoms_proxy(spark, sf_dir)), CAP), ["mol_id", "atom_idx"], ["px", "py", "pz"])


# --- molecules -----------------------------------------------------------


BOND_RADIUS = "CASE atom_idx % 6 WHEN 0 THEN 0.76e0 WHEN 1 THEN 0.31e0 WHEN 2 THEN 0.66e0 WHEN 3 THEN 0.71e0 WHEN 4 THEN 1.05e0 END"


@query(
    f""", k AS (SELECT *, {BOND_RADIUS} AS cr FROM atoms) SELECT a.mol_id, a.atom_idx AS a, b.atom_idx AS b FROM k a JOIN k b ON a.mol_id = b.mol_id AND a.atom_idx < b.atom_idx
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 1.25e0 * (a.cr + b.cr)"""
)
def bond_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within 1.25 times the sum of their covalent radii; the sixth element has none and bonds with nothing."""
    return bonds(atoms_proxy(spark, sf_dir).withColumn("element", F.expr(ELEMENT)))


@query(TILES + " SELECT mol_id, tile_id, count(*) AS members, count(*) >= 3 AS triples FROM ta GROUP BY mol_id, tile_id")
def tile_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that atoms reach, with their number, and whether a triple fits."""
    members = tile_atoms(sp.expanded(atoms_proxy(spark, sf_dir)), TILE, OVERLAP)
    return crowded(members, ["mol_id", "tile_id"]).withColumn("triples", F.col("members") >= 3)


@query(" SELECT vec_id, array_to_string(list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0), ',') AS supports FROM embeddings WHERE embedding IS NOT NULL")
def dense_to_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each vector's positive components, comma-joined: dense rows as supports."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    return e.select("vec_id", F.array_join(supports_of(F.col("embedding")), ",").alias("supports"))


@query(
    """, o AS (SELECT mol_id, atom_idx AS point_id, row_number() OVER (PARTITION BY mol_id ORDER BY atom_idx) - 1 AS i, count(*) OVER (PARTITION BY mol_id) AS n FROM atoms)
SELECT mol_id, point_id FROM o WHERE n <= 20 OR i IN (SELECT k * (o.n - 1) // 19 FROM (SELECT unnest(range(20)) AS k))"""
)
def limited_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 points of each molecule, for display."""
    return limited(atoms_proxy(spark, sf_dir).select("mol_id", F.col("atom_idx").alias("point_id")), 20)


MOMENTS = {f"c{p}{q}": f"avg({p} * {q}) - avg({p}) * avg({q})" for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")}


@query(f" SELECT mol_id, {', '.join(f'{q6(e)} AS {n}' for n, e in MOMENTS.items())} FROM atoms GROUP BY mol_id")
def covariance_shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms_proxy(spark, sf_dir).groupBy("mol_id").agg(*[F.expr(q6(e)).alias(n) for n, e in MOMENTS.items()])


STATS = {"atoms": "count(*)"} | {f"span_{c}": q6(f"max({c}) - min({c})") for c in "xyz"} | {"volume": q6("(max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))"), "radius_mean": q6("avg(radius)"), "radius_min": "min(radius)", "radius_max": "max(radius)"}


@query(f" SELECT mol_id, {', '.join(f'{e} AS {n}' for n, e in STATS.items())} FROM atoms GROUP BY mol_id")
def molecule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms_proxy(spark, sf_dir).groupBy("mol_id").agg(*[F.expr(e).alias(n) for n, e in STATS.items()])


@query(f" SELECT mol_id, atom_idx, {', '.join(f'{q6(f"{c} - avg({c}) OVER (PARTITION BY mol_id)")} AS {c}' for c in 'xyz')} FROM atoms")
def center_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.avg(c).over(Window.partitionBy("mol_id")).alias(f"m{c}") for c in "xyz"]
    return atoms_proxy(spark, sf_dir).select("*", *means).select("mol_id", "atom_idx", *[F.expr(q6(f"{c} - m{c}")).alias(c) for c in "xyz"])


ELEMENT = "CASE atom_idx % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'H' WHEN 2 THEN 'O' WHEN 3 THEN 'N' WHEN 4 THEN 'S' ELSE 'SE' END"


@query(f" SELECT mol_id, atom_idx, element, CASE element WHEN 'C' THEN 1.7e0 WHEN 'H' THEN 1.1e0 WHEN 'O' THEN 1.52e0 WHEN 'N' THEN 1.55e0 WHEN 'S' THEN 1.8e0 ELSE 1.9e0 END AS radius FROM (SELECT mol_id, atom_idx, {ELEMENT} AS element FROM atoms)")
def element_radius_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension join; the table of elements has six rows, so it is broadcast."""
    from ..sources.structures import element_table

    named = atoms_proxy(spark, sf_dir).select("mol_id", "atom_idx", F.expr(ELEMENT).alias("element"))
    return named.join(F.broadcast(element_table(spark).select("element", "radius")), "element").select("mol_id", "atom_idx", "element", "radius")


@query(f" SELECT mol_id, atom_idx, {', '.join(f"CASE WHEN element = '{x}' THEN 1 ELSE 0 END AS is_{x.lower()}" for x in ('C', 'H', 'O', 'N', 'S', 'SE'))} FROM (SELECT mol_id, atom_idx, {ELEMENT} AS element FROM atoms)")
def onehot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = atoms_proxy(spark, sf_dir).select("mol_id", "atom_idx", F.expr(ELEMENT).alias("element"))
    return named.select("mol_id", "atom_idx", *[F.when(F.col("element") == x, 1).otherwise(0).alias(f"is_{x.lower()}") for x in ("C", "H", "O", "N", "S", "SE")])


@query(
    """, d AS (SELECT a.mol_id, a.atom_idx % 2 AS half, a.atom_idx, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d
  FROM e a JOIN e b ON a.mol_id = b.mol_id AND a.atom_idx % 2 <> b.atom_idx % 2 GROUP BY ALL)
SELECT mol_id, """
    + ", ".join([f"{q6('(avg(d) FILTER (half = 0) + avg(d) FILTER (half = 1)) / 2e0')} AS symmetric_mean", *[f"{q6(f'quantile_cont(d, {p})')} AS p{int(100 * p)}" for p in (0.5, 0.9, 0.95)], f"{q6('max(d)')} AS longest"])
    + " FROM d GROUP BY mol_id"
)
def nn_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest distances between a molecule's even and odd atoms, both ways: the mean of the two means, percentiles and the largest."""
    p = atoms_proxy(spark, sf_dir).select("mol_id", F.col("atom_idx").alias("point_id"), "x", "y", "z")
    d = sp.nearest_k(p, 1, "src % 2 <> dst % 2").select("mol_id", F.col("src").alias("atom_idx"), "d")
    half = lambda h: F.avg(F.when(F.col("atom_idx") % 2 == h, F.col("d")))
    got = d.groupBy("mol_id").agg(((half(0) + half(1)) / 2.0).alias("symmetric_mean"), *[F.percentile("d", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.95)], F.max("d").alias("longest"))
    return sp.rounded(got, ["mol_id"], ["symmetric_mean", "p50", "p90", "p95", "longest"])


@query(" SELECT DISTINCT mol_id, atom_idx FROM (SELECT mol_id, atom_idx, n, least(n, 16) AS m FROM (SELECT *, count(*) OVER (PARTITION BY mol_id) AS n FROM atoms)), range(16) p WHERE p.range < m AND atom_idx = round_even(p.range * (n - 1)::DOUBLE / greatest(m - 1, 1), 0)::BIGINT")
def deterministic_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 evenly spaced atoms of each molecule: the picks are computed, then joined by index."""
    atoms = atoms_proxy(spark, sf_dir).select("mol_id", "atom_idx")
    picks = atoms.groupBy("mol_id").agg(F.count("*").alias("n")).withColumn("m", F.least("n", F.lit(16)))
    picks = picks.withColumn("p", F.explode(F.expr("sequence(0L, m - 1)"))).select("mol_id", F.expr("cast(rint(p * cast(n - 1 as double) / greatest(m - 1, 1)) as bigint)").alias("atom_idx")).distinct()
    return atoms.join(picks, ["mol_id", "atom_idx"], "left_semi")
