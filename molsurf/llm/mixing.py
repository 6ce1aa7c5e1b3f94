"""Mixing sources to target weights by Pfair scheduling.

A source's documents are dealt, in the order of a hash, into blocks of
``block`` documents. With weight w, its block j (from 0) is released at slot
floor(j / w) and due by slot ceil((j + 1) / w); earliest deadline first (ties:
the smaller window first, then the source) fills the slots, so up to any slot
t a source has had more than w * t - 1 and fewer than w * t + 1 blocks.

Weights are taken exactly as given, as ratios of whole numbers, so this holds for
the target weights themselves, however many blocks there are. It holds until a
source has no block left; then the others go on with their weights in proportion,
in a phase of its own whose slots t count from its start. Every document is placed once.

The driver plans from a count per source, with a step and twelve bytes for each
block: a billion documents are 16 million blocks. The slots of the blocks, ``CHUNK``
to a row, are broadcast up to ``BROADCAST`` bytes and shuffled beyond. Its time per
phase also grows with the number of sources: meant for up to about a thousand.

A given weight must be finite and not negative; a source of weight zero, or of none
where others have one, comes with a weight of 1e-9.

Without given weights, a source's target is the square root of its count: rarer
sources come earlier and denser. Null sources are one source of their own. An
empty table gives an empty result. Repeated rows are placed once each, rows
without doc_id like others. All columns stay but ``_block``, ``_phase`` and
``_slot``, which are the result's own.
"""

from __future__ import annotations

import heapq
import math
from array import array
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, ranked, table

BLOCK, CHUNK, BROADCAST = 64, 64, 64 << 20
PLACES = ("_block", "_phase", "_slot")


def shares(weights: dict[str, float], period: int | None = None) -> dict[str, int]:
    """Whole numbers in exact proportion to the weights; with a period, whole shares of it instead, at least 1 each, by largest remainders."""
    if period is None:
        exact = {s: Fraction(w) for s, w in weights.items()}
        unit = math.lcm(*(x.denominator for x in exact.values()))
        whole = {s: int(x * unit) for s, x in exact.items()}
        common = math.gcd(*whole.values())
        return {s: x // common for s, x in whole.items()}
    period = max(period, 2 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while (gap := period - sum(out.values())) != 0:
        for s in order if gap > 0 else sorted((s for s in out if out[s] > 1), key=lambda s: (exact[s] - out[s], s)):
            if not gap:
                break
            out[s] += 1 if gap > 0 else -1
            gap += -1 if gap > 0 else 1
    return out


def pfair(share: dict[str, int], left: dict[str, int] | None = None) -> dict[str, array]:
    """The slots of each source's blocks, earliest deadline first among the released: one period, or until a source has none left.

    A source's blocks are due one after another, so only its next one waits.
    """
    period = sum(share.values())
    left = left or share
    ready = [(-(-period // a), -(-period // a), s) for s, a in share.items()]  # due, window, source
    heapq.heapify(ready)
    later: list[tuple[int, int, str]] = []  # release, due, source
    slots: dict[str, array] = {s: array("q") for s in share}
    t = 0
    while True:
        while later and later[0][0] <= t:
            at, due, s = heapq.heappop(later)
            heapq.heappush(ready, (due, due - at, s))
        due, _, s = heapq.heappop(ready)
        assert t < due
        slots[s].append(t)
        t += 1
        j = len(slots[s])
        if left is share:
            if t == period:
                return slots
            if j == share[s]:
                continue
        elif j == left[s]:
            return slots
        at, due = j * period // share[s], -(-(j + 1) * period // share[s])
        heapq.heappush(later, (at, due, s))


@dataclass
class Phase:
    source: str
    phase: int
    first: int  # the source's first block of the phase
    start: int  # the phase's first slot
    share: int
    period: int
    slots: array


def phases(counts: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[Phase]:
    """Phases of the schedule for the sources' numbers of blocks; each ends with the last block of a source."""
    left, done, out = dict(counts), dict.fromkeys(counts, 0), []
    start, k = 0, 0
    while left := {s: n for s, n in left.items() if n}:
        share = shares({s: weights[s] for s in left}, period)
        slots = pfair(share, left)
        for s in left:
            out.append(Phase(s, k, done[s], start, share[s], sum(share.values()), slots[s]))
            done[s] += len(slots[s])
        left = {s: n - len(slots[s]) for s, n in left.items()}
        start += sum(map(len, slots.values()))
        k += 1
    return out


def chunks(plan: list[Phase], chunk: int = CHUNK) -> pa.Table:
    """(_s, _c, _slots, _phases): the slots and phases of a source's blocks _c * chunk and on."""
    slots: dict[str, array] = {}
    of: dict[str, array] = {}
    for p in plan:
        slots.setdefault(p.source, array("q")).extend(p.start + t for t in p.slots)
        of.setdefault(p.source, array("i")).extend([p.phase] * len(p.slots))
    rows = [(s, c // chunk, x[c : c + chunk], of[s][c : c + chunk]) for s, x in slots.items() for c in range(0, len(x), chunk)]
    names, kinds = ("_s", "_c", "_slots", "_phases"), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None) -> DataFrame:
    """All rows and columns of docs (doc_id, source among them), then _block, _phase and _slot: the place of the row's block in the mixture."""
    spark = docs.sparkSession
    if bad := [s for s, w in (weights or {}).items() if not (math.isfinite(w) and w >= 0)]:
        raise ValueError(f"weights must be finite and not negative: {', '.join(sorted(bad))}")
    # a row's own columns travel as one, so that none clashes with those of the plan
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), "doc_id", F.xxhash64(*docs.columns).alias("tie"))
    rows = {r["source"]: r["count"] for r in named.groupBy("source").count().collect()}  # a row per source
    own = {s: (weights or {}).get(s, 0) or (math.sqrt(n) if weights is None else 1e-9) for s, n in rows.items()}
    plan = spark.createDataFrame(chunks(phases({s: -(-n // block) for s, n in rows.items()}, own, period)), "_s string, _c long, _slots array<long>, _phases array<int>")
    placed = ranked(named, ["source"], ["doc_id", "tie"], "rank", 4 * partitions(spark)).withColumn("_block", F.floor(F.col("rank") / block).cast("long"))
    # a row per CHUNK blocks: an array of bounded size meets each document; a plan of more bytes than BROADCAST is shuffled
    small = 12 * sum(-(-n // block) for n in rows.values()) <= BROADCAST
    placed = placed.join(F.broadcast(plan) if small else plan, (F.col("source") == F.col("_s")) & (F.floor(F.col("_block") / CHUNK).cast("long") == F.col("_c")))
    at = F.pmod(F.col("_block"), F.lit(CHUNK)).cast("int") + 1
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c not in PLACES]
    return placed.select(*columns, "_block", F.element_at("_phases", at).alias("_phase"), F.element_at("_slots", at).alias("_slot"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "source")
    return mix(docs).select("doc_id", "source", F.col("_block").alias("block"), F.col("_phase").alias("phase"), F.col("_slot").alias("slot"))
