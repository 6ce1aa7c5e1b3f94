"""What several operators share: tables, checkpoints, ranks, sorted runs and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A list of at most so many keys is broadcast.
SMALL = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints_"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which outlives its task, gives freed memory back to the system."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fitted(sample: DataFrame, order: list[str], fit: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> bytes | None:
    """What fit makes of a bounded sample, read in order by one task of an executor; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(batches)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(lambda batches: released(run(batches)), "model binary").collect()
    return bytes(found[0]["model"]) if found and found[0]["model"] is not None else None


def words_by_slices(text: bytes, size: int, prepared: Callable[[bytes], bytes]) -> Iterator[list[bytes]]:
    """The words of a text between ASCII white space, of one prepared slice after another; a word that slices cut is put together once, however long."""
    held: list[bytes] = []
    for at in range(0, len(text), size):
        part = prepared(text[at : at + size])
        words = part.split()
        if held and words and not part[:1].isspace():
            held.append(words.pop(0))
            if words or part[-1:].isspace():
                words.insert(0, b"".join(held))
                held = []
        elif held:
            words.insert(0, b"".join(held))
            held = []
        if words and not part[-1:].isspace():
            held = [words.pop()]
        if words:
            yield words
    if held:
        yield [b"".join(held)]


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Add the 0-based rank of each row among the rows with its keys.

    Rows go to buckets by a hash of ``order``; a rank is the number of rows in
    the key's earlier buckets plus the rank within the bucket. So a key with a
    third of all rows is still dealt over ``buckets`` groups, and the sums of
    the earlier buckets come from one row per key and bucket. Keys must not be
    null: plain equality lets the join and the window share one shuffle.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    names = [*keys, "_b"]
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], "_o")
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    within = Window.partitionBy(*names).orderBy(*order)
    joined = dealt.join(offsets, same)
    return joined.withColumn(out, F.row_number().over(within) - 1 + F.col("_o")).drop("_b", "_o", *[f"_k{i}" for i in range(len(names))])


def in_runs(df: DataFrame, keys: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, order: list[str] | None = None) -> DataFrame:
    """Give fn every run of rows with equal keys, in sorted partitions."""
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(lambda batches: released(fn(batches)), schema)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that never cut a run of equal keys."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            cut = int(starts(t)[-1])
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut).combine_chunks()
            held, n = t.to_batches(), t.num_rows
            rows = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def split_hot(df: DataFrame, keys: list[str], ident: str, limit: int) -> DataFrame:
    """Add gi, gj and blk so that every pair of rows with equal keys meets in a group of about 2 * limit rows.

    Keys with more than ``limit`` rows are dealt into blocks; a group holds two
    blocks (or one, gi = gj), and each row goes to as many groups as there are
    blocks. Pairs within a block belong to the group gi = gj.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    hot = checkpointed(hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.ceil(F.col("_n") / limit).cast("int").alias("_nb")))
    many = hot.count()
    if not many:
        return df.withColumns({"blk": F.lit(0), "gi": F.lit(0), "gj": F.lit(0)})
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_h{i}"))
    # checked just now: a small list of hot keys spares the rows a shuffle
    dealt = df.join(F.broadcast(hot) if many <= SMALL else hot, same, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64(ident), F.col("_nb")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return dealt.withColumn("gi", F.least("blk", "_other")).withColumn("gj", F.greatest("blk", "_other")).drop("_nb", "_other", *[f"_h{i}" for i in range(len(keys))])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that the links i-j reach."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
        apart = label[i] != label[j]
        if not apart.any():
            while (label[label] != label).any():
                label = label[label]
            break
        i, j = label[i[apart]], label[j[apart]]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that the links in edges (a, b) reach, for nodes with links.

    Alternating large-star and small-star steps. A star's centre takes part as
    a minimum (partial aggregation) and a join of many rows with one, which
    skew joins can split; each round is checkpointed.
    """

    def stars(e: DataFrame, both: bool) -> DataFrame:
        if both:
            e = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # a table of its own: only then are both sides of the join plain shuffles, which is what Spark splits where a centre is hot
        low = checkpointed(e.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m")))
        j = e.join(low, F.col("a") == F.col("_a"))
        if both:
            out = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = j.select(F.explode(F.array("a", "b")).alias("a"), F.col("_m").alias("b"))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())  # a decimal sum has room for any number of links

    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(e)
    while was[0]:
        e = checkpointed(stars(stars(e, True), False))
        now = state(e)
        if now == was:
            break
        was = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
