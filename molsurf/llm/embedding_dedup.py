"""Embedding near-duplicates by Euclidean p-stable hashing.

Each table hashes a normalised vector by ``k`` quantised Gaussian projections,
floor((a . x + b) / WIDTH); vectors in one bucket are compared by exact cosine
in double precision. ``k`` grows with the logarithm of the number of distinct
vectors, so buckets stay small, and the number of tables follows from ``k`` so
that a pair at the threshold meets in some table with probability ``RECALL``
(closer pairs with more).

Buckets hold no vectors but a sketch of ``SIGNS`` signs of further projections.
Only where two sketches of a bucket differ in at most ``APART`` signs are the two
vectors sent there and compared: at the threshold 18.4 of 128 signs differ on
average, and more than 40 for one pair in ten million; of unlike vectors, almost
none come near. So vectors travel as often as they have likely partners.

Equal vectors are one node with a count. A pair counts in the first table that
it meets in. Large buckets are split into pairs of blocks, and pairs are counted
a strip at a time, so no task holds all pairs of a bucket. Vectors that are
null, empty, zero, or hold null or non-finite components link with nothing, nor
do vectors of different lengths with each other. Repeated vec_ids are kept as
rows, each a vector of its own; rows without vec_id are linked like any other,
and a component of such rows alone has a null component_id and keeps them all.
Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, forest, in_runs, released, split_hot, table, whole_runs

COSINE, WIDTH, RECALL, BUCKET, HOT, SEED = 0.9, 2.0, 0.998, 256, 2000, 11
SIGNS, APART, STRIP = 128, 40, 256


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def meet(distance: float, width: float) -> float:
    """The probability that one quantised projection agrees at the distance."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = meet(math.sqrt(2 - 2 * cosine), WIDTH), meet(math.sqrt(2), WIDTH)
    k = max(4, round(math.log(max(1, n / BUCKET)) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hashed(nodes: DataFrame, k: int, tables: int) -> DataFrame:
    """nodes with their bucket in each table (keys) and two longs of signs."""
    kind = nodes.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for b in batches:
            sizes = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                some = b.filter(pa.array(sizes == d))
                if int(d) not in by_size:
                    rng = np.random.default_rng([SEED, int(d)])
                    by_size[int(d)] = rng.standard_normal((int(d), k * tables)), rng.random(k * tables) * WIDTH, rng.integers(1, 1 << 62, (tables, k)) | 1, rng.standard_normal((int(d), SIGNS))
                a, shift, mix, signs = by_size[int(d)]
                for i in range(0, some.num_rows, 1024):
                    part = some.slice(i, 1024)
                    x = unit(matrix(part.column(3)))
                    cell = np.floor((x @ a + shift) / WIDTH).astype(np.int64).reshape(-1, tables, k)
                    key = (cell * mix).sum(2) + d
                    # 32 bits name a bucket: where they agree by chance, two vectors meet and are compared once more
                    key = (key ^ key >> 32).astype(np.int32)
                    keys = pa.FixedSizeListArray.from_arrays(pa.array(key.ravel()), tables).cast(pa.list_(pa.int32()))
                    sketch = np.packbits(x @ signs > 0, axis=1, bitorder="little").view("<i8")
                    yield pa.RecordBatch.from_arrays([*part.columns, keys, *[pa.array(np.ascontiguousarray(c)) for c in sketch.T]], names=[*part.schema.names, "keys", "s0", "s1"])

    return nodes.mapInArrow(lambda batches: released(run(batches)), f"node long, low long, copies long, vec {kind}, keys array<int>, s0 long, s1 long")


def likely(buckets: DataFrame) -> DataFrame:
    """The rows (t, key, gi, gj, blk, node) of buckets whose sketch is near another's in its run; in a run of two blocks, near one of the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "key", "gi", "gj", "blk", "node"]
        for whole in whole_runs(batches, ["t", "key", "gi", "gj"], 1 << 14):
            t, key, gi, gj, blk = (whole.column(c).to_numpy() for c in names[:5])
            s = np.stack([whole.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")])
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1]))))
            sizes = np.diff(np.append(new, len(key)))
            hit = np.zeros(len(key), bool)
            for at, size in zip(new[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                own, side = s[:, at : at + size], blk[at : at + size]
                for i in range(0, size, STRIP):
                    near = np.bitwise_count(own[0, i : i + STRIP, None] ^ own[0, None, i:]) + np.bitwise_count(own[1, i : i + STRIP, None] ^ own[1, None, i:]) <= APART
                    np.fill_diagonal(near, False)
                    if gi[at] != gj[at]:
                        near &= side[i : i + STRIP, None] != side[None, i:]
                    hit[at + i : at + min(size, i + STRIP)] |= near.any(1)
                    hit[at + i : at + size] |= near.any(0)
            if hit.any():
                yield from whole.select(names).filter(pa.array(hit)).combine_chunks().to_batches()

    return in_runs(buckets, ["t", "key", "gi", "gj"], run, "t int, key int, gi int, gj int, blk int, node long", ["node"])


def one_length(whole: pa.Table, starts: list[int], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Each run's start with its rows; where a hash met across lengths, those of one length at a time, as only they link."""
    for at, size in zip(starts, sizes):
        some = whole.slice(at, size).combine_chunks().to_batches()[0]
        lengths = some.column("vec").value_lengths().to_numpy()
        if (lengths == lengths[0]).all():
            yield at, np.arange(at, at + size), some
            continue
        for d in np.unique(lengths):
            k = np.flatnonzero(lengths == d)
            if len(k) > 1:
                yield at, at + k, some.take(pa.array(k))


def compared(buckets: DataFrame, cosine: float) -> DataFrame:
    """(node, other, links): other links node to a smaller node of its run; links counts the vectors it links with, each pair in its first table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, ["t", "key", "gi", "gj"], 1 << 12):
            t, key, gi, gj, blk, node, copies = (whole.column(c).to_numpy() for c in ("t", "key", "gi", "gj", "blk", "node", "copies"))
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1]))))
            sizes = np.diff(np.append(new, len(key)))
            for at, rows, some in one_length(whole, new[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                size = len(rows)
                x, keys = unit(matrix(some.column("vec"))), some.column("keys").flatten().to_numpy().reshape(size, -1)[:, : int(t[at])]
                own, many, side = node[rows], copies[rows], blk[rows]
                links, root = np.zeros(size, np.int64), np.arange(size)
                for i in range(0, size, STRIP):
                    a, b = np.nonzero(x[i : i + STRIP] @ x[i:].T >= cosine)
                    up = b > a
                    a, b = a[up] + i, b[up] + i
                    if gi[at] != gj[at]:
                        apart = side[a] != side[b]
                        a, b = a[apart], b[apart]
                    for j in range(0, len(a), 1 << 16):
                        p, q = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                        fresh = ~(keys[p] == keys[q]).any(1)
                        p, q = p[fresh], q[fresh]
                        links += np.bincount(p, many[q], size).astype(np.int64) + np.bincount(q, many[p], size).astype(np.int64)
                        root = forest(size, np.concatenate((np.arange(size), p)), np.concatenate((root, q)))
                k = np.flatnonzero(links)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(own[k]), pa.array(own[root[k]]), pa.array(links[k])], names=["node", "other", "links"])

    return in_runs(buckets, ["t", "key", "gi", "gj"], run, "node long, other long, links long", ["node"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vec = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")  # floats stay as narrow as they come
    own = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec"))
    takes_part = usable(F.col("vec"))
    good = own.where(takes_part)
    k, tables = shape(good.count(), cosine)
    # a node's number is free: the order of partitions and rows, fixed by the checkpoint
    distinct = good.groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    nodes = checkpointed(hashed(distinct.select(F.monotonically_increasing_id().alias("node"), "low", "copies", "vec"), k, tables))
    places = nodes.select(F.posexplode("keys").alias("t", "key"), "node", "s0", "s1")
    near = checkpointed(likely(split_hot(places, ["t", "key"], "node", HOT)))
    wide = near.join(nodes.select(F.col("node").alias("_n"), "copies", "vec", "keys"), F.col("node") == F.col("_n")).drop("_n")
    found = checkpointed(compared(wide, cosine))
    reached = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "_n")
    links = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "_m")
    told = nodes.select("node", "low", "copies", "vec").join(links, F.col("node") == F.col("_m"), "left").join(reached, F.col("node") == F.col("_n"), "left")
    told = checkpointed(told.select("vec", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = checkpointed(told.groupBy("component").agg(F.min("low").alias("component_id")).withColumnRenamed("component", "_c"))
    named = told.join(least, F.col("component") == F.col("_c")).select(F.col("vec").alias("_vec"), "n_links", "component_id")
    # many rows of one hot vector meet one row here: a skewed join that Spark can split
    linked = good.join(named, F.col("vec") == F.col("_vec")).select("vec_id", "n_links", "component_id")
    alone = own.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(id, node) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.node = l.a
), low AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
