"""Surface-graph operators over proxy points: atoms as points, with made-up normals, supports and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SQRT_EPS
from ..functions.formulas import q6, with_steps
from ..operators.graph import GraphOptions, surface_edges
from ..operators.outputs import output_stats as stats_of
from ..operators.points import even_picks, farthest_points, shape, windowed_neighbours
from ..operators.spatial import nearest_k
from ..sources.proxy import SQL as ATOMS
from ..sources.proxy import atoms_proxy

QUERIES, SQL = {}, {}
K, POOL = 6, 12

POINTS = f"""WITH {ATOMS}, pts AS (
  SELECT mol_id, atom_idx AS point_id, x, y, z, x / n AS nx, y / n AS ny, z / n AS nz, list_sort(list_distinct([atom_idx % 5, 5 + atom_idx % 3])) AS supports, atom_idx % 3 + 1 AS block_type, atom_idx % 7 AS block_id
  FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM atoms)
), cand AS (
  SELECT a.mol_id, a.point_id AS src, b.point_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d,
         a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS cosine, (b.x - a.x) AS tx, (b.y - a.y) AS ty, (b.z - a.z) AS tz, a.nx AS nxa, a.ny AS nya, a.nz AS nza, b.nx AS nxb, b.ny AS nyb, b.nz AS nzb,
         (a.block_type = b.block_type AND a.block_id = b.block_id) OR list_has_all(a.supports, b.supports) OR list_has_all(b.supports, a.supports) AS allowed
  FROM pts a JOIN pts b ON a.mol_id = b.mol_id AND a.point_id <> b.point_id
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_steps(atoms_proxy(spark, sf_dir), [("n", "sqrt(x * x + y * y + z * z)")])
    supports = F.array_sort(F.array_distinct(F.array(F.col("atom_idx") % 5, 5 + F.col("atom_idx") % 3)))
    return p.select("mol_id", F.col("atom_idx").alias("point_id"), "x", "y", "z", *[(F.col(c) / F.col("n")).alias(f"n{c}") for c in "xyz"], supports.alias("supports"), (F.col("atom_idx") % 3 + 1).alias("block_type"), (F.col("atom_idx") % 7).alias("block_id"))


def query(sql: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (POINTS.replace("WITH", "WITH RECURSIVE", 1) if recursive else POINTS) + sql
        return f

    return add


@query(f" SELECT mol_id, src, dst, rank::INT AS rank, {q6('d')} AS d FROM (SELECT *, row_number() OVER (PARTITION BY mol_id, src ORDER BY d, dst) AS rank FROM cand) WHERE rank <= {K}")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_k(points(spark, sf_dir), K).select("mol_id", "src", "dst", "rank", F.expr(q6("d")).alias("d"))


TOPOLOGY = "(block_typea = block_typeb AND block_ida = block_idb) OR size(array_except(supportsa, supportsb)) = 0 OR size(array_except(supportsb, supportsa)) = 0"


@query(f" SELECT mol_id, src, dst, rank::INT AS rank, {q6('d')} AS d FROM (SELECT *, row_number() OVER (PARTITION BY mol_id, src ORDER BY d, dst) AS rank FROM cand WHERE allowed) WHERE rank <= {K}")
def knn_topology_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_k(points(spark, sf_dir), K, TOPOLOGY).select("mol_id", "src", "dst", "rank", F.expr(q6("d")).alias("d"))


PICKED = f""", pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mol_id, src ORDER BY d, dst) AS rank FROM cand WHERE allowed) WHERE rank <= {POOL}),
valid AS (
  SELECT * FROM pool WHERE d > 1e-12 AND cosine >= -0.25e0 AND abs((tx * nxa + ty * nya + tz * nza) / d) <= 0.8e0 AND abs((tx * nxb + ty * nyb + tz * nzb) / d) <= 0.8e0
), picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mol_id, src ORDER BY d, dst) AS pick FROM valid) WHERE pick <= {K}),
und AS (SELECT mol_id, least(src, dst) AS lo, greatest(src, dst) AS hi, max(d) AS d, max(least(1e0, greatest(-1e0, cosine))) AS cosine FROM picked GROUP BY ALL),
wt AS (SELECT *, acos(cosine) AS theta FROM und)"""
GEODESIC = f"CASE WHEN theta <= {SQRT_EPS} THEN d ELSE d * theta / (2e0 * sin(theta / 2e0)) END"
BOTH = "FROM (SELECT mol_id, lo AS src, hi AS dst, weight FROM w UNION ALL SELECT mol_id, hi, lo, weight FROM w)"


def edges(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    e = surface_edges(points(spark, sf_dir), GraphOptions(neighbors=K, candidate_neighbors=POOL, **options))
    return e.select("mol_id", "src", "dst", F.expr(q6("weight")).alias("weight"))


@query(PICKED + f", w AS (SELECT mol_id, lo, hi, {q6('d')} AS weight FROM wt) SELECT mol_id, src, dst, weight {BOTH}")
def graph_edges_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


#: Under the geodesic mode the ranking uses the arc, so the picks differ from the euclidean ones.
PICKED_ARC = PICKED.replace("ORDER BY d, dst", f"ORDER BY {GEODESIC.replace('theta', 'acos(least(1e0, greatest(-1e0, cosine)))')}, dst")


@query(PICKED_ARC + f", w AS (SELECT mol_id, lo, hi, {q6(GEODESIC)} AS weight FROM wt) SELECT mol_id, src, dst, weight {BOTH}")
def graph_edges_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir, weight_mode="geodesic")


PI = "3.141592653589793e0"
SECTORS = f""", f1 AS (SELECT *, CASE WHEN abs(nxa) < 0.9e0 THEN 0e0 ELSE -nza END AS ux, CASE WHEN abs(nxa) < 0.9e0 THEN nza ELSE 0e0 END AS uy, CASE WHEN abs(nxa) < 0.9e0 THEN -nya ELSE nxa END AS uz FROM valid),
f2 AS (SELECT *, nya * uz - nza * uy AS vx, nza * ux - nxa * uz AS vy, nxa * uy - nya * ux AS vz FROM f1),
f3 AS (SELECT *, least({K - 1}, floor((atan2(tx * vx + ty * vy + tz * vz, tx * ux + ty * uy + tz * uz) + {PI}) * {K}e0 / (2e0 * {PI}))) AS sector FROM f2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mol_id, src, sector ORDER BY d, dst) AS pick FROM f3) WHERE pick = 1),
w AS (SELECT mol_id, least(src, dst) AS lo, greatest(src, dst) AS hi, {q6('max(d)')} AS weight FROM one GROUP BY mol_id, lo, hi)"""


@query(PICKED.split("picked AS")[0].rstrip().rstrip(",") + SECTORS + f" SELECT mol_id, src, dst, weight {BOTH}")
def graph_edges_angular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest valid candidate of each of six sectors of the tangent plane."""
    return edges(spark, sf_dir, prune_redundant=True)


@query(PICKED + f", w AS (SELECT mol_id, lo, hi, d AS weight FROM wt), deg AS (SELECT p.mol_id, p.point_id, count(e.dst) AS degree FROM pts p LEFT JOIN (SELECT mol_id, src, dst {BOTH}) e ON e.mol_id = p.mol_id AND e.src = p.point_id GROUP BY ALL) SELECT mol_id, count(*) AS points, sum(degree)::BIGINT AS nnz, {q6('avg(degree)')} AS mean_degree, max(degree) AS max_degree FROM deg GROUP BY mol_id")
def graph_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = edges(spark, sf_dir).groupBy("mol_id", F.col("src").alias("point_id")).agg(F.count("*").alias("degree"))
    each = points(spark, sf_dir).select("mol_id", "point_id").join(degree, ["mol_id", "point_id"], "left").fillna(0, ["degree"])
    return each.groupBy("mol_id").agg(F.count("*").alias("points"), F.sum("degree").alias("nnz"), F.expr(q6("avg(degree)")).alias("mean_degree"), F.max("degree").alias("max_degree"))


@query(" SELECT a.mol_id, a.point_id AS a, b.point_id AS b, list_has_all(a.supports, b.supports) AND list_has_all(b.supports, a.supports) AS same FROM pts a JOIN pts b ON a.mol_id = b.mol_id AND a.point_id < b.point_id WHERE list_has_all(a.supports, b.supports) OR list_has_all(b.supports, a.supports)")
def support_subset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points one of whose supports hold the other's. Distinct supports are compared once, by an equi-join on a shared one; then points meet by their supports, so no pair that is none is ever made twice or tested again."""
    p = points(spark, sf_dir).select("mol_id", "point_id", "supports")
    sets = p.select("mol_id", "supports").distinct()
    side = lambda s: sets.select("mol_id", F.col("supports").alias(f"s{s}"), F.explode("supports").alias("atom"))
    # sets that meet on several atoms count once, on the least shared one
    met = side("a").join(side("b"), ["mol_id", "atom"]).where("atom = array_min(array_intersect(sa, sb))")
    met = met.withColumns({"in_b": F.size(F.array_except("sa", "sb")) == 0, "in_a": F.size(F.array_except("sb", "sa")) == 0})
    met = met.where("in_a OR in_b").select("mol_id", "sa", "sb", (F.col("in_a") & F.col("in_b")).alias("same"))
    of = lambda s: p.select("mol_id", F.col("point_id").alias(s), F.col("supports").alias(f"s{s}"))
    return of("a").join(met, ["mol_id", "sa"]).join(of("b"), ["mol_id", "sb"]).where("a < b").select("mol_id", "a", "b", "same")


KEYED = """, k AS (
  SELECT *, (floor((x - lx) / greatest(hx - lx, 1e-12) * 1023e0)::BIGINT * 1024 + floor((y - ly) / greatest(hy - ly, 1e-12) * 1023e0)::BIGINT) * 1024 + floor((z - lz) / greatest(hz - lz, 1e-12) * 1023e0)::BIGINT AS key
  FROM (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy, min(z) OVER w AS lz, max(z) OVER w AS hz FROM pts WINDOW w AS (PARTITION BY mol_id))
)"""
#: Candidates of the windowed search: by places in the order of a point's block, and of each of its supports.
WINDOWED = KEYED + f""", ob AS (SELECT mol_id, point_id, block_type, block_id, row_number() OVER (PARTITION BY mol_id, block_type, block_id ORDER BY key, point_id) AS place FROM k
), os AS (SELECT *, row_number() OVER (PARTITION BY mol_id, atom ORDER BY key, point_id) AS place FROM (SELECT DISTINCT mol_id, point_id, key, unnest(supports) AS atom FROM k)
), near AS (
  SELECT a.mol_id, a.point_id AS src, b.point_id AS dst FROM ob a JOIN ob b USING (mol_id, block_type, block_id) WHERE a.place <> b.place AND abs(a.place - b.place) <= {max(8, 2 * POOL)}
  UNION
  SELECT a.mol_id, a.point_id, b.point_id FROM os a JOIN os b USING (mol_id, atom) WHERE a.place <> b.place AND abs(a.place - b.place) <= {max(8, POOL)}
)"""


@query(PICKED.replace("FROM cand WHERE allowed)", "FROM cand JOIN near USING (mol_id, src, dst) WHERE allowed)").replace(", pool AS", WINDOWED + ", pool AS") + f", w AS (SELECT mol_id, lo, hi, {q6('d')} AS weight FROM wt) SELECT mol_id, src, dst, weight {BOTH}")
def graph_edges_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by places in spatial order, inside blocks and inside supports."""
    return edges(spark, sf_dir, search="windowed")


@query(SQL["graph_edges_euclidean"].removeprefix(POINTS))
def graph_edges_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact graph by way of a geometric pool; points that come out short are searched again."""
    return edges(spark, sf_dir, search="prefiltered")


REACH = 8


@query(
    f""", k AS (
  SELECT *, (floor((x - lx) / greatest(hx - lx, 1e-12) * 1023e0)::BIGINT * 1024 + floor((y - ly) / greatest(hy - ly, 1e-12) * 1023e0)::BIGINT) * 1024 + floor((z - lz) / greatest(hz - lz, 1e-12) * 1023e0)::BIGINT AS key
  FROM (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy, min(z) OVER w AS lz, max(z) OVER w AS hz FROM pts WINDOW w AS (PARTITION BY mol_id))
), o AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY key, point_id) AS place FROM k)
SELECT mol_id, src, dst, rank::INT AS rank, {q6('d')} AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY mol_id, src ORDER BY d, dst) AS rank FROM (
    SELECT a.mol_id, a.point_id AS src, b.point_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
    FROM o a JOIN o b ON a.mol_id = b.mol_id AND a.place <> b.place AND abs(a.place - b.place) <= {REACH})
) WHERE rank <= {K}"""
)
def knn_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_neighbours(points(spark, sf_dir), K, REACH).select("mol_id", "src", "dst", "rank", F.expr(q6("d")).alias("d"))


@query(" SELECT mol_id, point_id FROM (SELECT mol_id, point_id, count(*) OVER (PARTITION BY mol_id) AS n FROM pts) JOIN range(12) p ON p.range < least(n, 12) AND point_id = round_even(p.range * (n - 1)::DOUBLE / greatest(least(n, 12) - 1, 1), 0)::BIGINT GROUP BY ALL")
def even_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return even_picks(points(spark, sf_dir), 12).select("mol_id", "point_id")


@query(
    """, fp(mol_id, pick, point_id, chosen) AS (
  SELECT mol_id, 0, min(point_id), [min(point_id)] FROM pts GROUP BY mol_id
  UNION ALL
  SELECT mol_id, pick + 1, best, list_append(chosen, best) FROM (
    SELECT f.mol_id, f.pick, f.chosen, (
      SELECT p.point_id FROM pts p WHERE p.mol_id = f.mol_id
      ORDER BY (SELECT min((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)) FROM pts c WHERE c.mol_id = f.mol_id AND list_contains(f.chosen, c.point_id)) DESC, p.point_id LIMIT 1) AS best
    FROM fp f WHERE f.pick < 9 AND f.pick + 1 < (SELECT count(*) FROM pts n WHERE n.mol_id = f.mol_id)))
SELECT mol_id, point_id, pick::INT AS pick FROM fp""",
    recursive=True,
)
def farthest_point_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return farthest_points(points(spark, sf_dir), 10)


@query(
    f""", m AS (SELECT mol_id, {', '.join(f"avg({p} * {q}) - avg({p}) * avg({q}) AS {p}{q}" for p, q in ("xx", "yy", "zz", "xy", "xz", "yz"))} FROM atoms GROUP BY mol_id),
t AS (SELECT *, (xx + yy + zz) / 3e0 AS q FROM m), u AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2e0 * (xy * xy + xz * xz + yz * yz)) / 6e0) AS p FROM t),
v AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1e0, least(1e0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2e0 * p * p * p)))) / 3e0 ELSE 0e0 END AS phi FROM u),
w AS (SELECT mol_id, q, q + 2e0 * p * cos(phi) AS high, q + 2e0 * p * cos(phi + 2e0 * pi() / 3e0) AS low FROM v)
SELECT mol_id, round(low, 6) AS e1, round(3e0 * q - high - low, 6) AS e2, round(high, 6) AS e3 FROM w"""
)
def shape_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shape(atoms_proxy(spark, sf_dir))
    return got.select("mol_id", *[F.round(F.col("eigenvalues")[k], 6).alias(f"e{k + 1}") for k in range(3)])


@query(
    PICKED
    + f""", w AS (SELECT mol_id, lo, hi FROM wt), n AS (SELECT mol_id, 2 * count(*) AS edges FROM w GROUP BY mol_id),
p AS (SELECT mol_id, count(*) AS point_count, avg(len(supports)) AS supports_mean, max(len(supports)) AS supports_max, avg(abs(sqrt(nx * nx + ny * ny + nz * nz) - 1e0)) AS e, max(abs(sqrt(nx * nx + ny * ny + nz * nz) - 1e0)) AS m FROM pts GROUP BY mol_id)
SELECT mol_id, point_count, {q6('supports_mean')} AS supports_mean, supports_max, {q6('e')} AS normal_error_mean, {q6('m')} AS normal_error_max, true AS finite_normals, coalesce(edges, 0)::BIGINT AS edge_count, true AS finite_weights,
{q6('coalesce(edges, 0) / (point_count::DOUBLE * point_count)')} AS density, {q6('coalesce(edges, 0)::DOUBLE / point_count')} AS mean_degree FROM p LEFT JOIN n USING (mol_id)"""
)
def output_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the points and their euclidean graph amount to."""
    p = points(spark, sf_dir)
    got = stats_of(p, surface_edges(p, GraphOptions(neighbors=K, candidate_neighbors=POOL)))
    return got.withColumns({c: F.expr(q6(c)) for c in ("supports_mean", "normal_error_mean", "normal_error_max", "density", "mean_degree")})
