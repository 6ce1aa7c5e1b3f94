"""Approximate nearest neighbours over low-dimensional stable projections and a kd-tree.

Vectors are projected by ``M`` Gaussians. For two vectors at distance d, their
squared projected distance over d^2 is chi-square with M degrees of freedom; so
once a query's next projected neighbour lies at delta with
chi2_M(delta^2 / d_k^2) >= CONFIDENCE, where d_k is the exact distance of its
k-th best so far, a nearer vector still unseen is unlikely, and the search stops.

The kd-tree has three levels. Its top is fit on a bounded sample of projections
(``SAMPLE`` rows) and has at most ``TOPS`` branches. In each branch, the medians
of all its rows' projections cut it into cells of at most ``CELL`` rows, however
uneven the sample was; each cell has a tree with leaves of ``LEAF`` rows. First,
a query searches its own cell, which bounds d_k. Then it goes down the tree: to
the branches, the cells in them and the leaves in those whose box is within its
stopping radius. Leaves' rows are verified in the order of their projected
distance, ``STEP`` at a time, until the test holds. A cell meets the queries that
visit it in blocks of ``BLOCK``, so no group grows with their number.

Of equal vectors only the ``k + 1`` smallest ids can be among the k nearest, as
ties go to the smaller id; the others are left out before the search, which
loses nothing. Vectors null, empty, zero or with null or non-finite components
take no part; neither do vectors of another length than the query's, nor rows
without vec_id. Repeated rows count once. Rows that share a vec_id but not their
vector are one item, as near as its nearest vector, and queries with each of
them. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, released, table
from .embedding_dedup import matrix, usable

K, EVERY, M, CONFIDENCE, CELL, LEAF, SAMPLE, SEED = 10, 100, 8, 0.98, 4096, 64, 20_000, 5
#: Branches of the top at most; rows of a branch that it is meant for; candidates verified at a time.
TOPS, BRANCH, STEP = 1024, 16 * 4096, 256
#: Queries that a cell searches at a time.
BLOCK = 4096
ROW = "vec_id long, vec array<double>, p array<double>, dim int"


def chi2_cdf(x: float, m: int = M) -> float:
    """For an even number of degrees of freedom."""
    h, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= h / (i + 1)
    return 1 - math.exp(-h) * total


def chi2_quantile(p: float, m: int = M) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def directions(d: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).standard_normal((d, M))


class KdTree:
    """Median splits of the widest axis; boxes of the leaves."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            own = stack.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            p = points[own]
            axis = int(np.argmax(p.max(0) - p.min(0)))
            half = len(own) // 2
            order = own[np.argpartition(p[:, axis], half)]
            stack += [order[half:], order[:half]]
        self.low = np.array([points[x].min(0) for x in self.leaves])
        self.high = np.array([points[x].max(0) for x in self.leaves])

    def within(self, q: np.ndarray, radius: float) -> np.ndarray:
        """The rows of leaves whose box is within the squared radius of q."""
        near = np.flatnonzero(box_gap(q, self.low, self.high) <= radius)
        return np.concatenate([self.leaves[k] for k in near]) if len(near) else np.empty(0, np.int64)


def box_gap(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from q to boxes."""
    gap = np.maximum(0, np.maximum(low - q, q - high))
    return (gap * gap).sum(-1)


def top_splits(sample: np.ndarray, branches: int) -> list[tuple[int, float]]:
    """(axis, cut) of a full binary tree in heap order, at 1, 2, 3, ...; branches is a power of two."""
    splits: list[tuple[int, float]] = [(0, 0.0)] * branches
    rows = {1: sample}
    for node in range(1, branches):
        p = rows.pop(node)
        axis = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
        at = float(np.median(p[:, axis])) if len(p) else 0.0
        splits[node] = (axis, at)
        rows[2 * node], rows[2 * node + 1] = p[p[:, axis] < at], p[p[:, axis] >= at]
    return splits


def branch_of(p: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.ones(len(p), np.int64)
    axis, at = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    while (inner := node < len(splits)).any():
        k = node[inner]
        node[inner] = 2 * k + (p[inner, axis[k]] >= at[k])
    return node - len(splits)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1]) if len(x) else np.empty(0)


def kept(d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids, each at its least distance."""
    order = np.lexsort((i, d))
    first = np.sort(np.unique(i[order], return_index=True)[1])[:k]
    return d[order][first], i[order][first]


def search(q: np.ndarray, qp: np.ndarray, own: int, tree: KdTree, points: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a cell, verified by projected distance; bound is a k-th distance known before."""
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    rows = tree.within(qp, bound * bound * ratio)
    rows = rows[ids[rows] != own]
    gap = ((points[rows] - qp) ** 2).sum(1)
    order = np.argsort(gap, kind="stable")
    rows, gap = rows[order], gap[order]
    at = 0
    while at < len(rows) and gap[at] <= bound * bound * ratio:
        some = rows[at : at + STEP]
        at += STEP
        rough = x[some] - q
        rough = np.einsum("ij,ij->i", rough, rough)
        if np.isfinite(bound):  # sums in another order differ by far less
            some = some[rough <= bound * bound * (1 + 1e-9)]
        elif len(some) > k:
            some = some[rough <= np.partition(rough, k - 1)[k - 1] * (1 + 1e-9)] if len(set(ids[some].tolist())) == len(some) else some
        best_d, best_i = kept(np.concatenate((best_d, exact(q, x[some]))), np.concatenate((best_i, ids[some])), k)
        if len(best_d) == k:
            bound = min(bound, float(best_d[-1]))
    return best_d, best_i


def visits(queries: DataFrame, rows: DataFrame, k: int, ratio: float) -> DataFrame:
    """(query_id, vec_id, score): the best of each cell for the queries (vec_id, vec, p, dim, cell, bound) sent to it."""

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id")
            x, points, ids = np.stack(left["vec"]), np.stack(left["p"]), left["vec_id"].to_numpy()
            tree = KdTree(points, LEAF)
            for q, vec, p, bound in zip(right["vec_id"], right["vec"], right["p"], right["bound"]):
                d, i = search(vec, p, q, tree, points, x, ids, k, bound, ratio)
                out.append((np.full(len(i), q), i, d))
        q, i, d = map(np.concatenate, zip(*out)) if out else (np.empty(0), np.empty(0), np.empty(0))
        return pd.DataFrame({"query_id": q.astype(np.int64), "vec_id": i.astype(np.int64), "score": d})

    blocks = checkpointed(queries.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("_nb")).withColumnsRenamed({"dim": "_d", "cell": "_c"}))
    met = (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c"))
    dealt = queries.join(blocks, met).withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("_nb")))
    every = rows.join(blocks, met).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    keys = ["dim", "cell", "blk"]
    # columns of their own: both sides may come from one table
    every, dealt = (df.select([F.col(c).alias(c) for c in (*keys, "vec_id", "vec", "p", *more)]) for df, more in ((every, ()), (dealt, ("bound",))))
    return every.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(visit, "query_id long, vec_id long, score double")


def projected(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                some = b.filter(pa.array(sizes == d))
                p = matrix(some.column(1)) @ directions(int(d))
                dim = pa.array(np.full(len(p), d, np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), M).cast(pa.list_(pa.float64())), dim], names=["vec_id", "vec", "p", "dim"])

    return rows.mapInArrow(lambda batches: released(run(batches)), ROW)


def dealt_to_branches(rows: DataFrame, splits: list[tuple[int, float]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            branch = branch_of(matrix(b.column(2)), splits) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(branch)], names=[*b.schema.names, "branch"])

    return rows.mapInArrow(run, ROW + ", branch long")


def split_branches(rows: DataFrame, cell: int) -> DataFrame:
    """(dim, branch, cell, vec_id, hash): medians cut each branch's projections into cells, numbered within the table."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["vec_id", "h"])
        points = np.stack(own["p"])
        number = np.empty(len(own), np.int64)
        for k, leaf in enumerate(KdTree(points, cell).leaves):
            number[leaf] = k
        return pd.DataFrame({"dim": own["dim"], "branch": own["branch"], "cell": (own["branch"].to_numpy() << 40) + number, "vec_id": own["vec_id"], "h": own["h"]})

    narrow = rows.select("dim", "branch", "vec_id", F.xxhash64("vec").alias("h"), "p")
    return narrow.groupBy("dim", "branch").applyInPandas(run, "dim int, branch long, cell long, vec_id long, h long")


def boxes_of(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.min(F.col("p")[i]) for i in range(M)]).alias("low"), F.array(*[F.max(F.col("p")[i]) for i in range(M)]).alias("high"))


def reached(queries: DataFrame, boxes: DataFrame, ratio: float) -> DataFrame:
    """(vec_id, h, dim, cell, bound): the cells, other than its own, whose box is within each query's stopping radius.

    Queries meet the boxes of the branches, of which there are at most ``TOPS`` for each length of vectors, then only
    the cells of the branches that they reach.
    """
    fits = F.aggregate(
        F.zip_with(F.zip_with("low", "p", lambda lo, x: lo - x), F.zip_with("p", "high", lambda x, hi: x - hi), lambda u, v: F.greatest(u, v, F.lit(0.0))),
        F.lit(0.0),
        lambda acc, g: acc + g * g,
    ) <= F.col("bound") * F.col("bound") * ratio
    low, high = ([F.min(F.col("low")[i]) for i in range(M)], [F.max(F.col("high")[i]) for i in range(M)])
    tops = boxes.groupBy("dim", "branch").agg(F.array(*low).alias("low"), F.array(*high).alias("high"))
    listed = tops.groupBy("dim").agg(F.collect_list(F.struct("branch", "low", "high")).alias("tops")).withColumnRenamed("dim", "_d")
    far = queries.select("vec_id", "h", "p", "dim", F.col("cell").alias("own"), "bound")
    to_top = far.join(listed, F.col("dim") == F.col("_d")).select(*far.columns, F.explode("tops").alias("t")).select(*far.columns, "t.branch", "t.low", "t.high").where(fits).drop("low", "high")
    cells = boxes.select(F.col("dim").alias("_d"), F.col("branch").alias("_b"), "cell", "low", "high")
    inside = to_top.join(cells, (F.col("dim") == F.col("_d")) & (F.col("branch") == F.col("_b")))
    return inside.where((F.col("cell") != F.col("own")) & fits).select("vec_id", "h", "dim", "cell", "bound")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, confidence: float = CONFIDENCE, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of each row whose vec_id is divisible by ``every``."""
    ratio = chi2_quantile(confidence)
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).where(usable(F.col("vec")) & F.col("vec_id").isNotNull()).distinct()
    least = Window.partitionBy("vec").orderBy("vec_id")
    # of equal vectors, the k + 1 smallest ids and the queries; Spark limits the groups before the shuffle
    first = own.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1).drop("_r")
    rows = checkpointed(projected(first))
    n = rows.count()
    branches = 1 << max(0, math.ceil(math.log2(min(TOPS, max(1, n / BRANCH)))))
    sample = rows.select("p").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["p"]
    splits = top_splits(np.array(sample.tolist()).reshape(-1, M), branches)
    rows = checkpointed(dealt_to_branches(rows, splits).withColumn("h", F.xxhash64("vec")))
    cells = split_branches(rows, cell).select(F.col("vec_id").alias("_i"), F.col("h").alias("_h"), "cell")
    rows = checkpointed(rows.join(cells, (F.col("vec_id") == F.col("_i")) & (F.col("h") == F.col("_h"))).drop("_i", "_h"))
    boxes = checkpointed(boxes_of(rows, "dim", "branch", "cell"))

    # a query starts in the cell of its vector, which a copy of it may stand for
    asked = own.where(F.col("vec_id") % every == 0).withColumn("h", F.xxhash64("vec"))
    homes = rows.groupBy("h", "dim").agg(F.min("cell").alias("cell"), F.first("p").alias("p")).withColumnRenamed("h", "_h")
    asked = checkpointed(asked.join(homes, (F.col("h") == F.col("_h")) & (F.size("vec") == F.col("dim"))).drop("_h"))
    home = checkpointed(visits(asked.withColumn("bound", F.lit(float("inf"))), rows, k, ratio))
    kth = home.groupBy("query_id").agg(F.max("score").alias("_d"), F.count("*").alias("_n"), F.count_distinct("vec_id").alias("_i"))
    # without k neighbours yet, or where an id asks with several vectors, nothing is bounded
    kth = kth.select("query_id", F.when((F.col("_n") == k) & (F.col("_i") == k), F.col("_d")).otherwise(float("inf")).alias("bound"))
    bounded = checkpointed(asked.join(kth, asked["vec_id"] == kth["query_id"], "left").drop("query_id").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    others = reached(bounded, boxes, ratio).withColumnsRenamed({"vec_id": "_i", "h": "_h"})
    sent = others.join(bounded.select("vec_id", "h", "vec", "p"), (F.col("vec_id") == F.col("_i")) & (F.col("h") == F.col("_h"))).drop("_i", "_h")
    away = visits(sent, rows, k, ratio)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = home.unionByName(away).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[2] - z[1]) * (z[2] - z[1])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
