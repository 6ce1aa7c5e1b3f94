"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. With at most 4 differing bits and 3 segments, one
segment differs by at most one bit; so each segment is indexed once for each of
its bits with that bit left out (64 variants a fingerprint in all), fingerprints
with an equal variant meet in a sorted run, and their Hamming distance decides.

Null or empty text has fingerprint zero and is linked like any other. Equal
fingerprints are one node, however many documents share them; keys with many
fingerprints are split into pairs of blocks. Ids may repeat or be null: rows are
kept. Columns other than doc_id and text are ignored, or kept by one_of_each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, forest, in_runs, partitions, released, split_hot, table, whole_runs, words_by_slices

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
HOT = 4096


#: Bytes of a text that are hashed at a time.
SLICE = 1 << 18


def sliced(text: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text, a slice of it at a time."""
    return words_by_slices(text, size or SLICE, bytes.lower)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    xx = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), 0
    held: list[bytes] = []
    for more in sliced(text or b""):
        words = held + more
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            new = len(words) - shingle + 1
            h = np.fromiter([xx(line[a:b], SEED) for a, b in zip(starts[:new].tolist(), ends[shingle - 1 :].tolist())], np.uint64, new)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += new
            held = words[new:]
        else:
            held = words
    if not n:
        return xx(b" ".join(held), SEED) if held else 0  # over half of one is all of it
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): fp holds the fingerprint's bits as a signed long; row is a hash of the text, by which rows of one id differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.empty(b.num_rows, np.uint64)
            for i in range(0, b.num_rows, 500):
                texts = b.column(2).slice(i, 500).cast(pa.binary()).to_pylist()
                fp[i : i + len(texts)] = [fingerprint(x, shingle) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(lambda batches: released(run(batches)), "doc_id long, row long, fp long")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, bits): as few segments as leave at most one differing bit in one of them."""
    k = max(2, distance // 2 + 1)  # two at least, so that a segment leaves room for its bit's number in a key
    cuts = [round(i * BITS / k) for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, fp): a key is a bit's number and its segment without that bit."""
    keys = []
    for first, width in segments(distance):
        for j in range(width):
            own = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)))
            keys.append(own.bitwiseOR(F.lit((first + j) << 56)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def close_pairs(key: np.ndarray, fp: np.ndarray, blk: np.ndarray, cross: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of rows of one run within the distance; in a run of two blocks, one of each."""
    first, second = [], []
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(new, len(key)))
    size_of = np.repeat(sizes, sizes)
    long = 64
    for s in range(1, min(long, int(sizes.max(initial=1)))):
        i = np.flatnonzero((key[s:] == key[:-s]) & (size_of[s:] <= long))
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= distance]
        first.append(i)
        second.append(i + s)
    for at, size in zip(new[sizes > long], sizes[sizes > long]):
        own = fp[at : at + size]
        for i in range(0, size, 512):
            a, b = np.nonzero(np.bitwise_count(own[i : i + 512, None] ^ own[None, i:]) <= distance)
            up = b > a
            first.append(at + i + a[up])
            second.append(at + i + b[up])
    i, j = np.concatenate([*first, np.empty(0, int)]).astype(int), np.concatenate([*second, np.empty(0, int)]).astype(int)
    keep = ~cross[i] | (blk[i] != blk[j])
    return i[keep], j[keep]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links of distinct fingerprints, as a forest of each run."""
    dealt = fps.repartition(partitions(fps.sparkSession), F.xxhash64("fp"))  # few bytes, so else few tasks would make all variants
    keyed = split_hot(variants(dealt, distance), ["key"], "fp", HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, ["key", "gi", "gj"]):
            key, gi, gj, blk = (t.column(c).to_numpy() for c in ("key", "gi", "gj", "blk"))
            fp = t.column("fp").to_numpy().view(np.uint64)
            run_id = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1]))))
            i, j = close_pairs(run_id, fp, blk, gi != gj, distance)
            if len(i):
                root = forest(len(fp), i, j)
                moved = np.flatnonzero(root != np.arange(len(fp)))
                a, b = fp[moved].view(np.int64), fp[root[moved]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return in_runs(keyed, ["key", "gi", "gj"], run, "a long, b long", ["fp"]).distinct()


def placed(fp: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, low, component) of each distinct fingerprint: its least doc_id, and the least fingerprint that links reach."""
    nodes = checkpointed(fp.groupBy("fp").agg(F.min("doc_id").alias("low")))
    reached = components(links(nodes.select("fp"), distance))
    return checkpointed(nodes.join(reached, nodes["fp"] == reached["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the least doc_id that links reach, itself included; null if no document there has an id."""
    fp = checkpointed(fingerprints(docs, shingle))
    # a component's least fingerprint stands for it until its least document is known
    nodes = placed(fp, distance)
    least = checkpointed(nodes.groupBy("component").agg(F.min("low").alias("component_id")).withColumnRenamed("component", "_c"))
    named = nodes.join(least, F.col("component") == F.col("_c")).select(F.col("fp").alias("_fp"), "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fp.join(named, F.col("fp") == F.col("_fp")).select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all their columns, less near-duplicates: of each group, one row of the least doc_id stays (ids before none; ties: the least hash of the text).

    Rows are told apart by id and text: texts of one id that are not near-duplicates all stay.
    """
    fp = checkpointed(fingerprints(docs, shingle))
    nodes = placed(fp, distance).select(F.col("fp").alias("_fp"), "component")
    rows = fp.groupBy("doc_id", "row", "fp").agg(F.count("*").alias("n"))  # equal rows are one
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    inside = checkpointed(rows.join(nodes, F.col("fp") == F.col("_fp")).select("component", own.alias("own"), "n"))
    best = checkpointed(inside.groupBy("component").agg(F.min("own").alias("best")).withColumnRenamed("component", "_c"))
    told = inside.join(best, F.col("component") == F.col("_c")).select(F.col("own.doc_id").alias("_id"), F.col("own.row").alias("_row"), F.when(F.col("own") != F.col("best"), 0).otherwise(F.least("n", F.lit(2))).alias("_n"))
    surplus = checkpointed(told.where("_n <> 1"))  # the fewer rows: those to go, and those that repeat
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_row"))
    left = docs.join(surplus.where("_n = 0"), same, "left_anti")
    again = surplus.where("_n = 2")
    if again.isEmpty():
        return left
    one = docs.join(again, same, "left_semi").withColumn("_row", F.xxhash64("text")).dropDuplicates(["doc_id", "_row"]).drop("_row")
    return left.join(again, same, "left_anti").unionByName(one)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
