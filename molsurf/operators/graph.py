"""A topology-aware nearest-neighbour graph over surface points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SQRT_EPS
from ..functions.formulas import dist2, with_steps
from .points import in_frames, spatial_key
from .spatial import nearest_in_cells, operand
from .store import checkpointed


@dataclass(frozen=True)
class GraphOptions:
    """neighbors: picks a point; candidate_neighbors: pool the picks come from (k + 2 by default, where supports have several slots, else max(2k, k + 4))."""

    neighbors: int = 6
    candidate_neighbors: int | None = None
    weight_mode: str = "euclidean"
    min_normal_cosine: float = -0.25
    max_tangent_component: float = 0.8
    max_distance: float | None = None
    prune_redundant: bool = False
    allow_disjoint_single_support_edges: bool = False
    topology: bool = True
    #: How candidates are found: "exact"; "prefiltered", the same rows by way of a geometric pool; "windowed", by places in spatial order, which may miss some.
    search: str = "exact"

    def __post_init__(self):
        if self.search not in ("exact", "prefiltered", "windowed"):
            raise ValueError("search must be 'exact', 'prefiltered' or 'windowed'")
        for name in ("neighbors", "candidate_neighbors"):
            v = getattr(self, name)
            if v is None and name == "candidate_neighbors":
                continue
            if isinstance(v, bool) or not isinstance(v, int):
                raise TypeError(f"{name} must be an integer")
            if v < 1:
                raise ValueError(f"{name} must be positive")
        if self.candidate_neighbors is not None and self.candidate_neighbors < self.neighbors:
            raise ValueError("candidate_neighbors must be at least neighbors")
        if self.weight_mode not in ("euclidean", "geodesic"):
            raise ValueError("weight_mode must be 'euclidean' or 'geodesic'")
        if not -1 <= self.min_normal_cosine <= 1:
            raise ValueError("min_normal_cosine must lie in [-1, 1]")
        if not 0 <= self.max_tangent_component <= 1:
            raise ValueError("max_tangent_component must lie in [0, 1]")
        if self.max_distance is not None and self.max_distance <= 0:
            raise ValueError("max_distance must be positive")


def typed_by(points: DataFrame) -> tuple[bool, bool]:
    """Whether points have supports, and whether they have blocks; half of a block is an error, and so are supports that are no array of atoms."""
    kinds = dict(points.dtypes)
    if ("block_type" in kinds) != ("block_id" in kinds):
        raise ValueError("block_type and block_id come together")
    if "supports" in kinds and kinds["supports"] not in ("array<int>", "array<bigint>", "array<smallint>"):
        raise ValueError(f"supports must be an array of atom numbers, not {kinds['supports']}")
    missing = {"mol_id", "point_id", "x", "y", "z", "nx", "ny", "nz"} - set(kinds)
    if missing:
        raise ValueError(f"points need {', '.join(sorted(missing))}")
    return "supports" in kinds, "block_type" in kinds


def topology(disjoint: bool, supports: bool = True, blocks: bool = True) -> Column:
    """Same block, or supports one of which hold the other; single disjoint supports only if asked for."""
    ok = F.lit(False) if supports or blocks else F.lit(True)
    if blocks:
        ok = ok | ((F.col("block_typea") == F.col("block_typeb")) & (F.col("block_ida") == F.col("block_idb")))
    if supports:
        ok = ok | subset("supportsa", "supportsb") | subset("supportsb", "supportsa")
        if disjoint:
            ok = ok | ((F.size("supportsa") == 1) & (F.size("supportsb") == 1))
    return ok


METRIC = f"CASE WHEN theta <= {SQRT_EPS} THEN d ELSE d * theta / (2e0 * sin(theta / 2e0)) END"
THETA = ("theta", "acos(least(1e0, greatest(-1e0, nxa * nxb + nya * nyb + nza * nzb)))")


#: Nearest points that a prefiltered search looks at, at least and by candidates.
FEWEST, TIMES = 64, 8
#: Places to each side that a window reaches at least.
NARROWEST = 8
#: Allowed pairs a point, on average, up to which an exact search makes them all.
MOST_ALLOWED = 500


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("mol_id", "src").orderBy("metric", "dst"))).where(F.col("rank") <= k)


def prefiltered(points: DataFrame, k: int, steps: list[tuple[str, str]], allowed: Column, limit: float | None) -> DataFrame:
    """The k nearest allowed points of each, by way of the nearest of all.

    Most points find enough allowed ones among their nearest, whatever the topology.
    Those that come out short while there are more points are searched again by the topology.
    """
    most = max(FEWEST, TIMES * k)
    nearest = nearest_in_cells(operand(points, "src", "a"), operand(points, "dst", "b"), most, steps, "metric", F.lit(True), limit)  # its parts are checkpoints
    best = ranked(nearest.where(allowed), k)
    found = nearest.groupBy("mol_id", "src").agg(F.count("*").alias("_all"), F.count(F.when(allowed, 1)).alias("_fit"))
    short = found.where((F.col("_all") >= most) & (F.col("_fit") < k)).select("mol_id", "src")
    again = checkpointed(operand(points, "src", "a").join(short, ["mol_id", "src"], "left_semi"))
    if again.isEmpty():
        return best
    more = nearest_in_cells(again, operand(points, "dst", "b"), k, steps, "metric", allowed, limit)
    return best.join(short, ["mol_id", "src"], "left_anti").unionByName(more.select(*best.columns))


def subset(a: str, b: str) -> Column:
    return F.size(F.array_except(a, b)) == 0


def allowed_pairs(points: DataFrame, supports: bool, blocks: bool) -> DataFrame | None:
    """All pairs that the topology allows, by equi-joins on blocks and on supports one of which hold the other; None where they are more than ``MOST_ALLOWED`` a point.

    Of a surface's points few pairs are allowed, near or far, so these joins are
    short where cells would have to grow until they span the molecule. Distinct
    supports are compared once, on their least shared atom. Supports without atoms,
    which all others hold, or with a null are left to the cells.
    """
    a, b, parts, total = operand(points, "src", "a"), operand(points, "dst", "b"), [], 0
    if supports:
        odd = points.where((F.size("supports") == 0) | F.exists("supports", lambda x: x.isNull()))
        if not odd.isEmpty():
            return None
        sets = points.groupBy("mol_id", "supports").agg(F.count("*").alias("_n"))
        side = lambda s: sets.select("mol_id", F.col("supports").alias(f"_s{s}"), F.col("_n").alias(f"_n{s}"), F.explode(F.array_distinct("supports")).alias("_atom"))
        met = side("a").join(side("b"), ["mol_id", "_atom"]).where("_atom = array_min(array_intersect(_sa, _sb))").where(subset("_sa", "_sb") | subset("_sb", "_sa"))
        met = checkpointed(met.select("mol_id", "_sa", "_sb", "_na", "_nb"))
        total += met.agg(F.sum(F.col("_na") * F.col("_nb"))).first()[0] or 0
        parts.append(a.join(met.select("mol_id", F.col("_sa").alias("supportsa"), F.col("_sb").alias("_s")), ["mol_id", "supportsa"]).join(b.withColumn("_s", F.col("supportsb")), ["mol_id", "_s"]).drop("_s"))
    if blocks:
        total += points.where("block_type is not null and block_id is not null").groupBy("mol_id", "block_type", "block_id").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        own = a.withColumns({"_t": F.col("block_typea"), "_i": F.col("block_ida")}).join(b.withColumns({"_t": F.col("block_typeb"), "_i": F.col("block_idb")}), ["mol_id", "_t", "_i"]).drop("_t", "_i")
        if supports:
            own = own.where(~F.coalesce(subset("supportsa", "supportsb") | subset("supportsb", "supportsa"), F.lit(False)))
        parts.append(own)
    if total > MOST_ALLOWED * points.count():
        return None
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return pairs.where("src <> dst")


def windowed(points: DataFrame, k: int, steps: list[tuple[str, str]], allowed: Column, limit: float | None) -> DataFrame:
    """Up to k near allowed points of each: of its block those a few places away in spatial order, and so for each of its supports.

    Linear in the points. A near point that stands far away in every such order is missed.
    """
    keep = [c for c in points.columns if c not in ("mol_id", "point_id")]
    keyed = checkpointed(spatial_key(points))
    by_block = in_frames(keyed.withColumns({"_t": F.col("block_type"), "_i": F.col("block_id")}), ["_t", "_i"], max(NARROWEST, 2 * k), keep)
    by_atom = in_frames(keyed.withColumn("_s", F.explode(F.array_distinct("supports"))), ["_s"], max(NARROWEST, k), keep)
    pairs = by_block.unionByName(by_atom.where(allowed))
    for name, expression in steps:
        pairs = pairs.withColumn(name, F.expr(expression))
    if limit is not None:
        pairs = pairs.where(F.col("metric") <= limit)
    return ranked(pairs.dropDuplicates(["mol_id", "src", "dst"]), k)


def surface_edges(points: DataFrame, options: GraphOptions = GraphOptions()) -> DataFrame:
    """(mol_id, src, dst, weight) in both directions, for points (mol_id, point_id, x, y, z, nx, ny, nz[, supports][, block_type, block_id]).

    Candidates are the nearest allowed points (ties to the smaller id); of the
    valid ones the nearest k, or the nearest of each sector, are picked. The
    graph is the union of all picks, so a point's degree can exceed k.
    """
    o = options
    supports, blocks = typed_by(points)
    typed = o.topology and (supports or blocks)
    length = F.expr("greatest(sqrt(nx * nx + ny * ny + nz * nz), 1e-300)")
    unit = points.select(*[c for c in points.columns if c not in ("nx", "ny", "nz")], *[F.when(length > 1e-16, F.col(c) / length).otherwise(1.0 if c == "nx" else 0.0).alias(c) for c in ("nx", "ny", "nz")])
    k = o.neighbors
    pool = o.candidate_neighbors or (k + 2 if typed else max(2 * k, k + 4))
    # an arc is never shorter than its chord, so both metrics suit growing cells
    steps = [("d", f"sqrt({dist2('a', 'b')})"), THETA, ("metric", METRIC if o.weight_mode == "geodesic" else "d")]
    allowed = topology(o.allow_disjoint_single_support_edges, supports, blocks) if typed else F.lit(True)
    if typed and o.search == "prefiltered":
        pairs = prefiltered(unit, pool, steps, allowed, o.max_distance)
    elif typed and supports and blocks and o.search == "windowed" and not o.allow_disjoint_single_support_edges:
        pairs = windowed(unit, pool, steps, allowed, o.max_distance)
    else:
        made = allowed_pairs(unit, supports, blocks) if typed and not o.allow_disjoint_single_support_edges else None
        if made is None:
            pairs = nearest_in_cells(operand(unit, "src", "a"), operand(unit, "dst", "b"), pool, steps, "metric", allowed, o.max_distance)
        else:
            for name, expression in steps:
                made = made.withColumn(name, F.expr(expression))
            pairs = ranked(made if o.max_distance is None else made.where(F.col("d") <= o.max_distance), pool)
    nearest = Window.partitionBy("mol_id", "src").orderBy("metric", "dst")
    along = lambda s: f"abs(((xb - xa) * nx{s} + (yb - ya) * ny{s} + (zb - za) * nz{s}) / d) <= {o.max_tangent_component}e0"
    valid = pairs.where("d > 1e-12").where(f"cos(theta) >= {o.min_normal_cosine - 1e-15} AND {along('a')} AND {along('b')}")
    if o.prune_redundant and k >= 3:
        sectors = min(k, 6)
        basis = [
            ("ux", "CASE WHEN abs(nxa) < 0.9e0 THEN 0e0 ELSE -nza END"),
            ("uy", "CASE WHEN abs(nxa) < 0.9e0 THEN nza ELSE 0e0 END"),
            ("uz", "CASE WHEN abs(nxa) < 0.9e0 THEN -nya ELSE nxa END"),
            ("vx", "nya * uz - nza * uy"),
            ("vy", "nza * ux - nxa * uz"),
            ("vz", "nxa * uy - nya * ux"),
            ("turn", "atan2((xb - xa) * vx + (yb - ya) * vy + (zb - za) * vz, (xb - xa) * ux + (yb - ya) * uy + (zb - za) * uz)"),
            ("sector", f"least({sectors - 1}, floor((turn + 3.141592653589793e0) * {sectors}e0 / (2e0 * 3.141592653589793e0)))"),
        ]
        w = Window.partitionBy("mol_id", "src", "sector").orderBy("metric", "dst")
        picked = with_steps(valid, basis).withColumn("_pick", F.row_number().over(w)).where("_pick = 1")
    else:
        picked = valid.withColumn("_pick", F.row_number().over(nearest)).where(F.col("_pick") <= k)
    lo, hi = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    once = picked.groupBy("mol_id", lo, hi).agg(F.max("metric").alias("weight"))
    forth, back = once.select("mol_id", F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight"), once.select("mol_id", F.col("hi").alias("src"), F.col("lo").alias("dst"), "weight")
    return forth.unionByName(back)


def once(edges: DataFrame) -> DataFrame:
    """Each undirected edge as one row (mol_id, src, dst, weight), src < dst."""
    return edges.where("src < dst").select("mol_id", "src", "dst", "weight")
