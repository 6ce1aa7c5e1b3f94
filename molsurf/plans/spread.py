"""The patch samplers of large molecules, with (molecule, tile) as the unit of work.

A tile holds its own atoms and a halo of twice the greatest expanded radius. It
makes what belongs to its own: patches of its atoms, of pairs whose first atom is
its own, and of probe positions that lie in it. All atoms that can touch, cover or
support these are in the halo, so nothing is made twice and nothing needs the
molecule. Whether the probe gets there from outside does: that is asked of all
tiles' places at once (``tiles.accessible``). Equal probe positions have one
rounded place and so one tile; the first by its triple stands.

Ids are formulas of the whole molecule's atom numbers, and points are numbered in
the order (kind, block, place in its block), so rows do not depend on the tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ATOM_BLOCK, PAIR_BLOCK, PROBE_BLOCK, SQRT_EPS
from ..functions import kernels as kn
from ..operators import tiles
from ..operators.spatial import first_seen
from ..operators.store import checkpointed, dealt

IDS = ["part", "seq"]
#: What a tile finds. kind 0: a place to ask about, of a block; 1: a point of a block.
FOUND = (
    "mol_id {mol}, part long, seq long, kind int, block_type int, block_id long, x double, y double, z double, nx double, ny double, nz double, cx double, cy double, cz double, "
    "supports array<struct<atom_idx:int,weight:double>>, sign int, kx long, ky long, kz long"
)


def with_numbers(atoms: DataFrame) -> DataFrame:
    """(mol_id, k, x, y, z, radius): atoms numbered from 0 in each molecule, by atom_idx."""
    return tiles.numbered(atoms.select("mol_id", "atom_idx", "x", "y", "z", "radius"), ["atom_idx"], "k", F.floor(F.col("atom_idx") / F.lit(tiles.BUCKET)).cast("long")).drop("atom_idx")


def asked_atoms(s: kn.Surface, own: np.ndarray, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """(atom, place) of feasible probe positions around own atoms."""
    atom, place = [], []
    d = kn.fibonacci(directions)
    step = max(1, kn.PAIRS // (8 * directions))
    for i in range(0, len(own), step):
        k = np.repeat(own[i : i + step], directions)
        c = s.xyz[k] + s.r[k][:, None] * np.tile(d, (len(k) // directions, 1))
        ok = s.feasible(c)
        atom.append(k[ok])
        place.append(c[ok])
    return (np.concatenate(atom), np.concatenate(place)) if atom else (np.empty(0, int), np.empty((0, 3)))


def asked_pairs(s: kn.Surface, pairs: np.ndarray, angles: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in pairs, place) of feasible probe positions on the pairs' circles."""
    if not len(pairs):
        return np.empty(0, int), np.empty((0, 3))
    c, rad, u, v = s.circles(pairs)
    a = 2 * np.pi * (np.arange(angles) + 0.5) / angles
    at = (c[:, None] + rad[:, None, None] * (np.cos(a)[:, None] * u[:, None] + np.sin(a)[:, None] * v[:, None])).reshape(-1, 3)
    of = np.repeat(np.arange(len(pairs)), angles)
    keep = np.repeat(rad > SQRT_EPS, angles)
    keep[keep] = s.feasible(at[keep])
    return of[keep], at[keep]


def found_in_tiles(near: DataFrame, frame: DataFrame, probe: float, density, blocks, filtered: bool, uniform: bool, sample: bool = True) -> DataFrame:
    """What each tile makes of its own atoms, pairs and probe positions. filtered: only blocks with a feasible place among their directions."""
    from .samplers import Samples, sample_atoms, sample_pairs, sample_probes

    names = [c.split()[0] for c in FOUND.split(", ")]
    blank = {c: np.nan for c in ("x", "y", "z", "nx", "ny", "nz")}

    def places(kind: int, block: np.ndarray, c: np.ndarray, **more) -> pd.DataFrame:
        return pd.DataFrame({**blank, "kind": 0, "block_type": kind, "block_id": block, "cx": c[:, 0], "cy": c[:, 1], "cz": c[:, 2], "sign": 0, **more}, index=range(len(c)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, tile = pdf.iloc[0], int(pdf["tile"].iloc[0])
        pdf = pdf.sort_values("k")
        s = kn.Surface(pdf[["x", "y", "z"]].to_numpy(), pdf["radius"].to_numpy(), probe, ids=pdf["k"].to_numpy(), total=int(f["n"]))
        own = pdf["own"].to_numpy()
        low, dims = f[["x0", "y0", "z0"]].to_numpy(float) - float(f["rmax"]), f[["tx", "ty", "tz"]].to_numpy(int)

        def home(p: np.ndarray) -> np.ndarray:
            at = np.clip(np.floor((p - low) / float(f["edge"])).astype(int), 0, dims - 1)
            return (at[:, 0] * dims[1] + at[:, 1]) * dims[2] + at[:, 2]

        # the three atoms of a place in the tile are within a radius of it, so nearer to the tile than the halo goes
        cell = np.array([tile // (dims[1] * dims[2]), tile // dims[2] % dims[1], tile % dims[2]])
        corner = low + cell * float(f["edge"])
        reach = float(f["rmax"]) + 0.01 + blocks.dedup
        lower, upper = np.where(cell == 0, -np.inf, corner - reach), np.where(cell == dims - 1, np.inf, corner + float(f["edge"]) + reach)
        inner = np.flatnonzero(((s.xyz >= lower) & (s.xyz <= upper)).all(1))
        # atoms that the halo does not show to be covered stay open; of atoms outside that is not asked
        s.open = np.ones(s.n, bool)
        s.open[inner] = kn.open_spheres(s.xyz[inner], s.r[inner], s.xyz, s.r)
        inner = inner[s.open[inner]]
        parts: list[pd.DataFrame] = []
        atoms, pairs = np.flatnonzero(own & s.open), s.open_pairs[own[s.open_pairs[:, 0]]] if filtered or sample else None
        if filtered:
            of, c = asked_atoms(s, atoms, blocks.atom_filter)
            parts.append(places(ATOM_BLOCK, s.ids[of], c))
            atoms = np.unique(of)
            of, c = asked_pairs(s, pairs, blocks.pair_filter)
            parts.append(places(PAIR_BLOCK, s.ids[pairs[of, 0]] * s.total + s.ids[pairs[of, 1]], c))
            pairs = pairs[np.unique(of)]
        abc = inner[s.among(inner).triangles]
        both, ok = s.triple_centers(abc) if len(abc) else (np.empty((0, 2, 3)), np.empty(0, bool))
        c = both.reshape(-1, 3)
        key = np.rint(np.nan_to_num(c) / blocks.dedup).astype(np.int64)
        at = np.flatnonzero(np.repeat(ok, 2) & (home(key * blocks.dedup) == tile)) if len(c) else np.empty(0, int)
        at = at[s.feasible(c[at])]
        held = [x for x in zip(at, s.supports(c[at], abc[at // 2], blocks.max_supports, blocks.support_tolerance)) if len(x[1]) >= 3] if len(at) else []
        probes = [(c[k], int(k % 2), sup) for k, sup in held]
        if probes:
            k = np.array([k for k, _ in held])
            a, b, e = s.ids[abc[k // 2]].T
            seeds = [[(int(s.ids[i]), 1.0) for i in sup] for _, _, sup in probes]
            parts.append(places(PROBE_BLOCK, ((a * s.total + b) * s.total + e) * 2 + k % 2, c[k], supports=seeds, sign=k % 2, kx=key[k, 0], ky=key[k, 1], kz=key[k, 2]))
        if sample:
            out = Samples([])
            sample_atoms(s, atoms, density, out, s.feasible)
            sample_pairs(s, pairs, density, out, s.feasible, uniform=uniform)
            sample_probes(s, probes, density, out)
            parts += [p.assign(kind=1, sign=0) for p in out.parts]
        got = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in names})
        got = got.assign(mol_id=f["mol_id"], part=tile, seq=np.arange(len(got)))
        for c_ in ("kx", "ky", "kz"):
            got[c_] = got[c_].astype("Int64") if c_ in got else pd.array([pd.NA] * len(got), "Int64")
        held = got["supports"] if "supports" in got else [None] * len(got)
        got["supports"] = pd.Series([x if isinstance(x, list) else None for x in held], index=got.index, dtype=object)
        return got[names]

    met = near.join(frame, "mol_id")
    return checkpointed(dealt(met, "mol_id", "tile").groupBy("mol_id", "tile").applyInPandas(run, FOUND.format(mol=dict(near.dtypes)["mol_id"])))


def reach_of(blocks) -> Column:
    """How far a halo goes: what touches a place at a radius from an own centre, and the tolerances."""
    return 2 * F.col("rmax") + F.lit(float(blocks.support_tolerance + blocks.dedup + 0.01))


def flagged(found: DataFrame, atoms: DataFrame, near: DataFrame, frame: DataFrame, probe: float, block: int, asked: Column, grid: Column | None = None) -> DataFrame:
    """found with ok: whether the probe reaches its place from outside, of the rows that ``asked`` names; null of others."""
    places = found.where(asked).select("mol_id", *IDS, F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("cz").alias("sz"), "block_type")
    got = tiles.accessible(places, atoms, near, frame, IDS, probe, block, grid).withColumn("ok", F.lit(True))
    return found.join(got, ["mol_id", *IDS], "left")


def standing(marked: DataFrame) -> DataFrame:
    """(mol_id, block_type, block_id) of blocks that the outside reaches, of rows with ok; of equal probe positions, the first."""
    there = marked.where("kind = 0 and ok")
    plain = there.where(F.col("block_type") != PROBE_BLOCK).select("mol_id", "block_type", "block_id").distinct()
    probes = first_seen(there.where(F.col("block_type") == PROBE_BLOCK).select("mol_id", "block_type", "block_id", "kx", "ky", "kz"), ["mol_id", "kx", "ky", "kz"], "block_id")
    return plain.unionByName(probes.select("mol_id", "block_type", "block_id"))


def prepared(atoms: DataFrame, probe: float, blocks, spacing: float | None, max_grid: int, edge: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered atoms, frames and the tiles' atoms with their halo."""
    own = checkpointed(with_numbers(atoms))
    frame = tiles.frames(own, probe, spacing, max_grid, edge)
    return own, frame, checkpointed(tiles.halo(own, frame, reach_of(blocks)))


def finished(points: DataFrame) -> DataFrame:
    """Points numbered by kind, block and place in it."""
    from .samplers import NAMES

    per = F.when(F.col("block_type") == ATOM_BLOCK, 1).when(F.col("block_type") == PAIR_BLOCK, F.col("n")).otherwise(2 * F.col("n") * F.col("n"))
    # blocks of 64 neighbouring first atoms are ranked together
    bucket = F.shiftleft(F.col("block_type").cast("long"), 40) + F.floor(F.col("block_id") / per / 64).cast("long")
    placed = tiles.numbered(points, ["block_type", "block_id", "seq"], "point_id", bucket)
    return placed.select(F.col("mol_id").cast("string").alias("mol_id"), *NAMES[1:])


def analytic(atoms: DataFrame, density, probe: float, blocks, spacing: float | None, max_grid: int, edge: float | None = None, block: int = tiles.BLOCK) -> DataFrame:
    """The analytic sampler by tiles: the rows of the whole-molecule form."""
    own, frame, near = prepared(atoms, probe, blocks, spacing, max_grid, edge)
    found = found_in_tiles(near, frame, probe, density, blocks, True, False)
    marked = checkpointed(flagged(found, own, near, frame, probe, block, (F.col("kind") == 0) | (F.col("block_type") != PROBE_BLOCK)))
    points = marked.where((F.col("kind") == 1) & (F.col("ok") | (F.col("block_type") == PROBE_BLOCK)))
    kept = points.join(standing(marked), ["mol_id", "block_type", "block_id"], "left_semi").join(frame.select("mol_id", "n"), "mol_id")
    return finished(kept.withColumn("tile_id", F.lit(-1).cast("long")))


def analytic_blocks(atoms: DataFrame, probe: float, blocks, spacing: float | None, max_grid: int, edge: float | None = None, block: int = tiles.BLOCK) -> DataFrame:
    """The reusable topology by tiles: the rows of the whole-molecule form."""
    own, frame, near = prepared(atoms, probe, blocks, spacing, max_grid, edge)
    found = found_in_tiles(near, frame, probe, None, blocks, True, False, sample=False)
    marked = checkpointed(flagged(found, own, near, frame, probe, block, F.lit(True)))
    kept = marked.where("kind = 0 and ok").join(standing(marked), ["mol_id", "block_type", "block_id"], "left_semi").join(frame.select("mol_id", "n"), "mol_id")
    one = kept.groupBy("mol_id", "block_type", "block_id").agg(*[F.first(c).alias(c) for c in ("n", "cx", "cy", "cz", "sign", "supports")])
    atom, probe_ = F.col("block_type") == ATOM_BLOCK, F.col("block_type") == PROBE_BLOCK
    pair = F.array(F.floor(F.col("block_id") / F.col("n")), F.col("block_id") % F.col("n"))
    members = F.when(atom, F.array("block_id")).when(probe_, F.transform("supports", lambda x: x["atom_idx"].cast("long"))).otherwise(pair)
    place = [F.when(probe_, F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in ("cx", "cy", "cz")]
    return one.select(F.col("mol_id").cast("string").alias("mol_id"), "block_type", "block_id", *place, "sign", members.cast("array<int>").alias("supports"))


def pairs_by_molecule(near: DataFrame, probe: float) -> DataFrame:
    """(mol_id, pairs): crossing pairs, each counted by the tile that holds its first atom."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        s = kn.Surface(pdf[["x", "y", "z"]].to_numpy(), pdf["radius"].to_numpy(), probe)
        return pd.DataFrame({"mol_id": pdf["mol_id"].iloc[:1], "pairs": [int(pdf["own"].to_numpy()[s.pairs[:, 0]].sum())]})

    counts = dealt(near, "mol_id", "tile").groupBy("mol_id", "tile").applyInPandas(run, f"mol_id {dict(near.dtypes)['mol_id']}, pairs long")
    return counts.groupBy("mol_id").agg(F.sum("pairs").alias("pairs"))


def sized(frame: DataFrame, near: DataFrame, own: DataFrame, density, probe: float, size: float | None) -> DataFrame:
    """frame with the sampler's own tile edge: given, or the whole extent where pairs and samples fit a task, or a share of it."""
    from .samplers import PAIR_BYTES, SAMPLE_BYTES, TASK_BYTES

    if size is not None:
        return frame.withColumn("size", F.lit(size))
    area = own.groupBy("mol_id").agg(F.sum(4 * np.pi * F.col("radius") ** 2).alias("area"))
    met = frame.join(area, "mol_id").join(pairs_by_molecule(near, probe), "mol_id")
    need = F.col("pairs") * F.lit(PAIR_BYTES) + F.col("area") * F.lit(density.oversample / density.point_area * 3) * F.lit(SAMPLE_BYTES)
    extent = F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]) + 2 * F.col("rmax") + 1.0
    own_size = F.when(need <= F.lit(TASK_BYTES), extent).otherwise(extent / F.ceil(F.pow(need / F.lit(TASK_BYTES), F.lit(1 / 3))))
    return met.withColumn("size", own_size).drop("area", "pairs")


def tiled(atoms: DataFrame, density, probe: float, size: float | None, overlap: float, dedup: float, exact: bool, spacing: float | None, max_grid: int, blocks, edge: float | None = None, block: int = tiles.BLOCK) -> DataFrame:
    """The tiled sampler's rows; a molecule that is one tile of its size gets the analytic sampler's. Tiles of work are those of the frame."""
    own, frame, near = prepared(atoms, probe, blocks, spacing, max_grid, edge)
    frame = checkpointed(sized(frame, near, own, density, probe, size))
    cells = {c: F.greatest(F.ceil((F.col(f"{c}1") + F.col("rmax") - (F.col(f"{c}0") - F.col("rmax"))) / F.col("size")), F.lit(1)) for c in "xyz"}
    alone = cells["x"] * cells["y"] * cells["z"] == 1
    one = frame.where(alone).select("mol_id")
    parts = []
    if not one.isEmpty():
        parts.append(analytic(atoms.join(one, "mol_id", "left_semi"), density, probe, blocks, spacing, max_grid, edge, block))
    many = frame.where(~alone)
    if parts and many.isEmpty():
        return parts[0]
    rest = lambda df: df.join(many.select("mol_id"), "mol_id", "left_semi")
    own, near = rest(own), checkpointed(rest(near))
    found = found_in_tiles(near, many.drop("size"), probe, density, blocks, False, True)
    probes = F.col("block_type") == PROBE_BLOCK
    grid = probes if not exact else F.lit(True)
    marked = checkpointed(flagged(found, own, near, many, probe, block, (F.col("kind") == 0) | ~probes, grid))
    points = marked.where((F.col("kind") == 1) & (F.col("ok") | probes))
    shut = points.where(probes).select("mol_id", "block_type", "block_id").distinct().join(standing(marked), ["mol_id", "block_type", "block_id"], "left_anti")
    points = points.join(shut, ["mol_id", "block_type", "block_id"], "left_anti").join(many.drop("nx", "ny", "nz"), "mol_id")
    at = {c: F.least(F.greatest(F.floor((F.col(c) - (F.col(f"{c}0") - F.col("rmax"))) / F.col("size")), F.lit(0)), cells[c] - 1) for c in "xyz"}
    points = points.withColumns({f"_t{c}": v for c, v in at.items()}).withColumn("tile_id", ((at["x"] * cells["y"] + at["y"]) * cells["z"] + at["z"]).cast("long"))
    # the tile that owns a point must hold all its supports
    place = ["mol_id", *IDS, "rmax", "size", *[f"_t{c}" for c in "xyz"], *[f"{c}0" for c in "xyz"]]
    held = points.select(*place, F.explode("supports").alias("s")).select(*place, F.col("s.atom_idx").cast("long").alias("k"))
    ball = own.select("mol_id", "k", *[F.col(c).alias(f"_a{c}") for c in "xyz"], (F.col("radius") + F.lit(float(probe)) + F.lit(float(overlap))).alias("_ra"))
    within = F.lit(True)
    for c in "xyz":
        cell = lambda v, c=c: F.floor((v - (F.col(f"{c}0") - F.col("rmax"))) / F.col("size"))
        within = within & F.col(f"_t{c}").between(cell(F.col(f"_a{c}") - F.col("_ra")), cell(F.col(f"_a{c}") + F.col("_ra")))
    strange = held.join(ball, ["mol_id", "k"]).where(~within).select("mol_id", *IDS).distinct()
    keyed = points.join(strange, ["mol_id", *IDS], "left_anti")
    keyed = keyed.withColumns({f"_k{c}": F.rint(F.col(c) / F.lit(dedup)).cast("long") for c in "xyz"}).withColumn("_order", F.struct("block_type", "block_id", "seq"))
    out = finished(first_seen(keyed, ["mol_id", "_kx", "_ky", "_kz"], "_order"))
    return out if not parts else out.unionByName(parts[0])
