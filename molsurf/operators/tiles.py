"""Work on parts of a molecule: tiles with a halo of atoms, rays through tiles, and a voxel grid in blocks.

A molecule's frame (one row) says how its space is cut. Everything else is keyed by
(mol_id, tile) or (mol_id, block), so a molecule of any size spreads over tasks,
and what a task holds follows from the edges, not from the molecule.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as kn
from .store import checkpointed, dealt

XYZ = ("x", "y", "z")
#: Atoms that a tile is to hold on average, and voxels along the edge of a block of the grid.
TILE_ATOMS, BLOCK = 3_000, 96
#: Rows of one bucket, where rows are numbered in a molecule.
BUCKET = 1 << 16
FRAME = (
    "mol_id {mol}, n long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, rmax double, far double, edge double, tx long, ty long, tz long, "
    "gx double, gy double, gz double, nx long, ny long, nz long, h double"
)


def numbered(df: DataFrame, order: list[str], out: str, coarse: Column, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """Add each row's 0-based place among the rows of its keys by ``order``, which must tell rows apart.

    coarse: a long that never falls along the order; rows of one value are ranked together, and the values' sizes summed up.
    """
    dealt = df.withColumn("_b", coarse)
    names = [*keys, "_b"]
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*names).agg(F.count("*").alias("_n"))
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_o"))
    met = dealt.join(sizes, reduce(and_, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(names)]))
    within = Window.partitionBy(*names).orderBy(*order)
    return met.withColumn(out, (F.row_number().over(within) - 1 + F.col("_o")).cast("long")).drop("_b", "_o", *[f"_k{i}" for i in range(len(names))])


def frames(atoms: DataFrame, probe: float, spacing: float | None, max_grid: int, edge: float | None = None) -> DataFrame:
    """A row for each molecule: atoms, box, greatest expanded radius, distance of the farthest atom, tiles (edge and counts) and voxel grid (corner, cells and spacing)."""
    low, high = [F.min(c).alias(f"{c}0") for c in XYZ], [F.max(c).alias(f"{c}1") for c in XYZ]
    box = atoms.groupBy("mol_id").agg(F.count("*").alias("n"), *low, *high, F.max(F.col("radius") + F.lit(float(probe))).alias("rmax"))
    d2 = sum((F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2.0) ** 2 for c in XYZ)
    far = atoms.select("mol_id", *XYZ).join(box, "mol_id").groupBy("mol_id").agg(F.sqrt(F.max(d2)).alias("far"))
    names = [c.split()[0] for c in FRAME.split(", ")]
    h = spacing or kn.fine_spacing(probe)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                lo, hi = np.array([r[f"{c}0"] for c in XYZ]), np.array([r[f"{c}1"] for c in XYZ])
                span = hi - lo + 2 * r["rmax"]
                own = edge or max(2 * r["rmax"], float((span.prod() * min(1.0, TILE_ATOMS / r["n"])) ** (1 / 3)))
                tiles = np.maximum(1, np.ceil(span / own)).astype(int)
                corner, cells, step = kn.grid_frame(lo, hi, r["rmax"], h, max_grid)
                far = r["far"] + r["rmax"] + 4 * h
                rows.append((r["mol_id"], r["n"], *lo, *hi, r["rmax"], far, own, *tiles, *corner, *cells, step))
            yield pd.DataFrame(rows, columns=names)

    return checkpointed(box.join(far, "mol_id").mapInPandas(run, FRAME.format(mol=dict(atoms.dtypes)["mol_id"])))


def tile_at(values: dict[str, Column]) -> Column:
    """The number of the tile that holds a place, by a frame's columns; places outside count to the nearest tile."""
    at = {c: F.least(F.greatest(F.floor((values[c] - (F.col(f"{c}0") - F.col("rmax"))) / F.col("edge")), F.lit(0)), F.col(f"t{c}") - 1) for c in XYZ}
    return ((at["x"] * F.col("ty") + at["y"]) * F.col("tz") + at["z"]).cast("long")


def halo(atoms: DataFrame, frame: DataFrame, reach: Column) -> DataFrame:
    """Atoms copied to every tile within ``reach`` of them along each axis, as (mol_id, tile, own, ...): own in the one that holds the centre."""
    met = atoms.join(frame, "mol_id").withColumn("_reach", reach).withColumn("_home", tile_at({c: F.col(c) for c in XYZ}))
    for c in XYZ:
        at = lambda s, c=c: F.floor((F.col(c) + s * F.col("_reach") - (F.col(f"{c}0") - F.col("rmax"))) / F.col("edge"))
        low, high = F.greatest(at(-1), F.lit(0)), F.least(at(1), F.col(f"t{c}") - 1)
        met = met.withColumn(f"_i{c}", F.explode(F.sequence(low, F.greatest(low, high))))
    tile = ((F.col("_ix") * F.col("ty") + F.col("_iy")) * F.col("tz") + F.col("_iz")).cast("long")
    return met.select(*atoms.columns, tile.alias("tile"), (tile == F.col("_home")).alias("own"))


# --- rays ----------------------------------------------------------------

RAY = ("sx", "sy", "sz", "ex", "ey", "ez")


def rays_by_tile(rays: DataFrame, frame: DataFrame) -> DataFrame:
    """Segments (mol_id, ..., sx, sy, sz, ex, ey, ez), a row for each tile that they pass, or that a stop lies in.

    Stops are a greatest radius apart, so no place of the segment is farther than half of it from a stop.
    """
    met = rays.join(frame.select("mol_id", *[f"{c}{k}" for c in XYZ for k in (0, 1)], "rmax", "edge", "tx", "ty", "tz"), "mol_id")
    length = F.sqrt(sum((F.col(f"e{c}") - F.col(f"s{c}")) ** 2 for c in XYZ))
    stops = F.greatest(F.ceil(length / F.col("rmax")), F.lit(1))
    place = lambda i: {c: F.col(f"s{c}") + (F.col(f"e{c}") - F.col(f"s{c}")) * (i / F.col("_stops")) for c in XYZ}
    within = lambda c, v: (v >= F.col(f"{c}0") - 2 * F.col("rmax")) & (v <= F.col(f"{c}1") + 2 * F.col("rmax"))
    inside = lambda i: reduce(and_, [within(c, v) for c, v in place(i).items()])
    steps = F.filter(F.sequence(F.lit(0), F.col("_stops").cast("int")), inside)
    passed = F.array_distinct(F.transform(steps, lambda i: tile_at(place(i))))
    return met.withColumn("_stops", stops).withColumn("tile", F.explode(passed)).select(*rays.columns, "tile")


def blocked(rays: DataFrame, near: DataFrame, frame: DataFrame, ids: list[str], probe: float) -> DataFrame:
    """The ids of segments that cross an expanded sphere. near: atoms by tile, with a halo of twice the greatest radius or more."""
    passing = rays_by_tile(rays.select("mol_id", *ids, *RAY), frame)
    kinds = dict(rays.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("mol_id", *ids))

    def run(segments: pd.DataFrame, atoms: pd.DataFrame) -> pd.DataFrame:
        if not len(atoms) or not len(segments):
            return segments.iloc[:0][["mol_id", *ids]]
        s = kn.Surface(atoms[list(XYZ)].to_numpy(), atoms["radius"].to_numpy(), probe)
        clear = s.clear(segments[list(RAY[:3])].to_numpy(), segments[list(RAY[3:])].to_numpy())
        return segments.loc[~clear, ["mol_id", *ids]]

    keys = ["mol_id", "tile"]
    hit = dealt(passing, *keys).groupBy(*keys).cogroup(dealt(near.select(*keys, *XYZ, "radius"), *keys).groupBy(*keys)).applyInPandas(run, schema)
    return hit.distinct()


def clear_segments(rays: DataFrame, atoms: DataFrame, frame: DataFrame, steps: list[tuple[str, str]], crosses: str) -> DataFrame:
    """The segments (mol_id, ..., px, py, pz, ex, ey, ez) that cross no expanded sphere (x, y, z, r), in column expressions only.

    Each segment goes to the cells it passes, each sphere to the cells it may be met from: an equi-join on cells, then an anti join.
    steps are columns of a segment and a sphere (x2, y2, z2, r2), crosses the test on them.
    """
    ids = [c for c in rays.columns if c not in ("px", "py", "pz", "ex", "ey", "ez")]
    passing = rays_by_tile(rays.withColumnsRenamed({f"p{c}": f"s{c}" for c in XYZ}), frame).withColumnsRenamed({f"s{c}": f"p{c}" for c in XYZ})
    ball = halo(atoms.select("mol_id", *XYZ, "r"), frame, 1.5 * F.col("rmax"))
    met = passing.join(ball.select("mol_id", "tile", *[F.col(c).alias(f"{c}2") for c in (*XYZ, "r")]), ["mol_id", "tile"])
    for name, expression in steps:
        met = met.withColumn(name, F.expr(expression))
    hit = met.where(crosses).select(*ids).distinct()
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ids]
    return rays.alias("p").join(hit.alias("q"), same, "left_anti")


# --- the voxel grid ------------------------------------------------------


def grid_blocks(frame: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mol_id, bx, by, bz) of all blocks of the grids."""
    out = frame
    for c in XYZ:
        out = out.withColumn(f"b{c}", F.explode(F.sequence(F.lit(0), F.floor((F.col(f"n{c}") - 1) / F.lit(block)).cast("long"))))
    return out.select("mol_id", "bx", "by", "bz")


def atoms_by_block(atoms: DataFrame, frame: DataFrame, probe: float, block: int) -> DataFrame:
    """Atoms copied to every block whose cells their expanded sphere may hold; a block has one cell more at its upper ends, which the next one has too."""
    out = atoms.select("mol_id", *XYZ, "radius").join(frame.select("mol_id", "gx", "gy", "gz", "nx", "ny", "nz", "h"), "mol_id").withColumn("_r", F.col("radius") + F.lit(float(probe)))
    for c in XYZ:
        low = F.greatest(F.floor((F.col(c) - F.col("_r") - F.col(f"g{c}")) / F.col("h")) - 1, F.lit(0))
        high = F.least(F.ceil((F.col(c) + F.col("_r") - F.col(f"g{c}")) / F.col("h")) + 1, F.col(f"n{c}") - 1)
        first = F.floor(F.greatest(low - 1, F.lit(0)) / F.lit(block)).cast("long")
        out = out.withColumn(f"b{c}", F.explode(F.sequence(first, F.greatest(first, F.floor(high / F.lit(block)).cast("long")))))
    return out.select("mol_id", "bx", "by", "bz", *XYZ, "radius")


def packed(labels: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(labels, "<i4").tobytes(), 1)


def unpacked(data: bytes, shape) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i4").reshape(shape)


def flood_by_blocks(atoms: DataFrame, frame: DataFrame, probe: float, block: int = BLOCK) -> DataFrame:
    """(mol_id, bx, by, bz, labels, reached, places, radii): of each block, its cells' components, those that the outside reaches, and its atoms.

    Two levels: components inside blocks first; the cells that two neighbours share say which components are one.
    Only these links, a few for each block, come together by molecule.
    """
    mol = dict(atoms.dtypes)["mol_id"]
    grids = frame.select("mol_id", "gx", "gy", "gz", "nx", "ny", "nz", "h")
    head = grid_blocks(frame, block).join(grids, "mol_id")
    near = atoms_by_block(atoms, frame, probe, block)
    schema = f"mol_id {mol}, bx long, by long, bz long, labels binary, border array<int>, faces array<struct<axis:int,upper:boolean,labels:binary>>, places binary, radii binary"

    def label(heads: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(heads):
            return pd.DataFrame({c: [] for c in ("mol_id", "bx", "by", "bz", "labels", "border", "faces", "places", "radii")})
        r = heads.iloc[0]
        dims, at = r[["nx", "ny", "nz"]].to_numpy(int), r[["bx", "by", "bz"]].to_numpy(int)
        first, last = at * block, np.minimum((at + 1) * block + 1, dims)
        xyz, radii = own[list(XYZ)].to_numpy(float), own["radius"].to_numpy(float)
        labels = kn.components(kn.free_cells(xyz, radii + probe, r[["gx", "gy", "gz"]].to_numpy(float), float(r["h"]), first, last))
        border, faces = set(), []
        for axis in range(3):
            low, high = np.take(labels, 0, axis), np.take(labels, -1, axis)
            if first[axis] == 0:
                border.update(np.unique(low).tolist())
            else:
                faces.append({"axis": axis, "upper": False, "labels": packed(low)})
            if last[axis] == dims[axis]:
                border.update(np.unique(high).tolist())
            if last[axis] == first[axis] + block + 1:  # its last layer is the next block's first
                faces.append({"axis": axis, "upper": True, "labels": packed(high)})
        border.discard(0)
        return pd.DataFrame([(r["mol_id"], *at.tolist(), packed(labels), sorted(border), faces, xyz.astype("<f8").tobytes(), radii.astype("<f8").tobytes())], columns=["mol_id", "bx", "by", "bz", "labels", "border", "faces", "places", "radii"])

    keys = ["mol_id", "bx", "by", "bz"]
    done = checkpointed(dealt(head, *keys).groupBy(*keys).cogroup(dealt(near, *keys).groupBy(*keys)).applyInPandas(label, schema))
    face = done.select(*keys, F.explode("faces").alias("f")).select(*keys, "f.axis", "f.upper", "f.labels")
    meet = [F.when((F.col("axis") == k) & F.col("upper"), F.col(f"b{c}") + 1).otherwise(F.col(f"b{c}")).alias(f"f{c}") for k, c in enumerate(XYZ)]
    side = face.select("mol_id", "axis", "upper", "labels", *meet)
    up = side.where("upper").select("mol_id", "axis", "fx", "fy", "fz", F.col("labels").alias("a"))
    down = side.where("not upper").select("mol_id", "axis", "fx", "fy", "fz", F.col("labels").alias("b"))

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                a, b = unpacked(r["a"], -1).astype(np.int64), unpacked(r["b"], -1).astype(np.int64)
                pairs = np.unique(a << 32 | b)
                low = [r["fx"], r["fy"], r["fz"]]
                low[r["axis"]] -= 1
                rows += [(r["mol_id"], *low, int(p >> 32), r["fx"], r["fy"], r["fz"], int(p & 0xFFFFFFFF)) for p in pairs if p >> 32]
            yield pd.DataFrame(rows, columns=["mol_id", "ax", "ay", "az", "a", "bx", "by", "bz", "b"])

    linked = up.join(down, ["mol_id", "axis", "fx", "fy", "fz"]).mapInPandas(links, f"mol_id {mol}, ax long, ay long, az long, a int, bx long, by long, bz long, b int")
    outer = done.select(*keys, F.explode("border").alias("b"))
    all_ = linked.unionByName(outer.select("mol_id", *[F.lit(-1).cast("long").alias(c) for c in ("ax", "ay", "az")], F.lit(0).alias("a"), "bx", "by", "bz", "b"))

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate((pdf[["ax", "ay", "az", "a"]].to_numpy(), pdf[["bx", "by", "bz", "b"]].to_numpy())), axis=0, return_inverse=True)
        i, j = at.ravel()[: len(pdf)], at.ravel()[len(pdf) :]
        label = kn.least_linked(len(nodes), i, j)
        own = nodes[(label == label[0]) & (nodes[:, 0] >= 0)] if nodes[0, 0] < 0 else nodes[:0]
        out = pd.DataFrame(own, columns=["bx", "by", "bz", "label"])
        return out.assign(mol_id=pdf["mol_id"].iloc[0])[["mol_id", "bx", "by", "bz", "label"]]

    got = all_.groupBy("mol_id").applyInPandas(reach, f"mol_id {mol}, bx long, by long, bz long, label int")
    got = got.groupBy(*keys).agg(F.collect_list("label").alias("reached"))
    return done.drop("border", "faces").join(got, keys, "left")


def reached_cells(blocks: DataFrame, frame: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mol_id, ix, iy, iz): the free cells that the outside reaches, each from the block that holds it."""
    mol = dict(blocks.dtypes)["mol_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.to_dict("records"):
                dims, first = np.array([r["nx"], r["ny"], r["nz"]]), np.array([r["bx"], r["by"], r["bz"]]) * block
                labels = unpacked(r["labels"], tuple(np.minimum(first + block + 1, dims) - first))[:block, :block, :block]
                some = np.zeros(max(int(labels.max()), max(r["reached"], default=0)) + 1, bool)
                some[list(r["reached"])] = True
                at = np.argwhere(some[labels]) + first
                yield pd.DataFrame({"mol_id": r["mol_id"], "ix": at[:, 0], "iy": at[:, 1], "iz": at[:, 2]})

    there = blocks.where("reached is not null").select("mol_id", "bx", "by", "bz", "labels", "reached").join(frame.select("mol_id", "nx", "ny", "nz"), "mol_id")
    return there.mapInPandas(run, f"mol_id {mol}, ix long, iy long, iz long")


def reached_by_grid(points: DataFrame, blocks: DataFrame, frame: DataFrame, ids: list[str], probe: float, block: int = BLOCK) -> DataFrame:
    """The ids of places (sx, sy, sz) from which a straight step to a corner of their grid cell that the outside reaches is clear."""
    kinds = dict(points.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("mol_id", *ids))
    met = points.select("mol_id", *ids, *RAY[:3]).join(frame.select("mol_id", "gx", "gy", "gz", "nx", "ny", "nz", "h"), "mol_id")
    for c in XYZ:
        base = F.floor((F.col(f"s{c}") - F.col(f"g{c}")) / F.col("h"))
        met = met.withColumn(f"b{c}", F.floor(F.least(F.greatest(base, F.lit(0)), F.col(f"n{c}") - 1) / F.lit(block)).cast("long"))
    keys = ["mol_id", "bx", "by", "bz"]

    def run(own: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(tables):
            return own.iloc[:0][["mol_id", *ids]]
        r, t = own.iloc[0], tables.iloc[0]
        corner, h = r[["gx", "gy", "gz"]].to_numpy(float), float(r["h"])
        dims, at = r[["nx", "ny", "nz"]].to_numpy(int), r[["bx", "by", "bz"]].to_numpy(int)
        first = at * block
        labels = unpacked(t["labels"], tuple(np.minimum(first + block + 1, dims) - first))
        some = np.zeros(int(labels.max()) + 1, bool)
        some[list(t["reached"] if t["reached"] is not None else [])] = True
        s = kn.Surface(np.frombuffer(t["places"], "<f8").reshape(-1, 3), np.frombuffer(t["radii"], "<f8"), probe)
        c = own[list(RAY[:3])].to_numpy()
        base = np.floor((c - corner) / h).astype(int)
        got = np.zeros(len(c), bool)
        for step in np.ndindex(2, 2, 2):
            cell = np.clip(base + step, 0, dims - 1)
            near = some[labels[tuple((cell - first).T)]] & ~got
            if near.any():
                got[near] = s.clear(c[near], corner + cell[near] * h) if s.n else True
        return own.loc[got, ["mol_id", *ids]]

    return dealt(met, *keys).groupBy(*keys).cogroup(dealt(blocks, *keys).groupBy(*keys)).applyInPandas(run, schema)


def accessible(points: DataFrame, atoms: DataFrame, near: DataFrame, frame: DataFrame, ids: list[str], probe: float, block: int = BLOCK, grid: Column | None = None) -> DataFrame:
    """The ids of feasible places (mol_id, ..., sx, sy, sz) that a probe reaches from outside: by the grid, or straight away from the molecule's middle.

    grid: where it holds, the grid counts; elsewhere only the straight way. Molecules of fewer than four atoms hide nothing.
    """
    some = points.join(frame.select("mol_id", "n", "far", *[f"{c}{k}" for c in XYZ for k in (0, 1)]), "mol_id").withColumn("_g", F.lit(True) if grid is None else grid)
    some = some.select("mol_id", *ids, *RAY[:3], "n", "far", "_g", *[((F.col(f"{c}0") + F.col(f"{c}1")) / 2.0).alias(f"_m{c}") for c in XYZ])
    open_ = some.where("n < 4").select("mol_id", *ids)
    asked = some.where("n >= 4 and _g")
    by_grid = checkpointed(reached_by_grid(asked, flood_by_blocks(atoms, frame, probe, block), frame, ids, probe, block))
    same = lambda a, b: [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("mol_id", *ids)]
    rest = some.where("n >= 4").alias("p").join(by_grid.alias("q"), same("p", "q"), "left_anti")
    way = [F.col(f"s{c}") - F.col(f"_m{c}") for c in XYZ]
    length = F.sqrt(way[0] ** 2 + way[1] ** 2 + way[2] ** 2)
    unit = [F.when(length > 2.220446049250313e-16, w / length).otherwise(F.lit(1.0 if k == 0 else 0.0)) for k, w in enumerate(way)]
    rays = checkpointed(rest.select("mol_id", *ids, *RAY[:3], *[(F.col(f"_m{c}") + u * F.col("far")).alias(f"e{c}") for c, u in zip(XYZ, unit)]))
    stopped = blocked(rays, near, frame, ids, probe)
    free = rays.alias("p").join(stopped.alias("q"), same("p", "q"), "left_anti").select("mol_id", *ids)
    return open_.unionByName(by_grid).unionByName(free)
