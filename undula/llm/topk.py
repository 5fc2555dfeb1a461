"""Exact top-k by inner product over KD-trees, one per shard.

Vectors are cut into shards of a bounded number of rows and queries into blocks. A task holds one shard and
one block: it splits the shard at medians into leaves with tight bounding boxes, bounds each query's inner
product with each box, and visits leaves best first until no box can beat the query's kth score. A first
round searches the shard that a query lies in; its kth score goes with the query to all other shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.session import ship_package, stage

SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF = 256
SCALE = 64
LOWEST = -(2**63) + 1  # below any score, and still negatable


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Vectors that are null or hold null or non-finite
    components are left out, as are null ids; of rows with the same id, the smallest vector counts."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return d.groupBy(F.col(vec_id).alias("vec_id")).agg(F.min(v).alias("v"))


class Tree:
    """Median splits on the widest dimension down to leaves, with their bounding boxes."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        parts, stack = [], [np.arange(len(x))]
        while stack:
            i = stack.pop()
            if len(i) <= leaf:
                parts.append(i)
                continue
            width = x[i].max(0) - x[i].min(0) if x.shape[1] else np.zeros(1)
            half = len(i) // 2
            if width.max() > 0:
                i = i[np.argpartition(x[i, int(width.argmax())], half)]
            stack += [i[:half], i[half:]]
        self.leaves = parts
        self.low = np.stack([x[i].min(0) for i in parts])
        self.high = np.stack([x[i].max(0) for i in parts])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that a vector inside each box can have with each query."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, leaf: int = LEAF):
    """(query row, vec_id, score) of each query's k best in the shard among scores of ``kth`` or more.

    Round r visits each query's r-th best leaf, and queries that visit the same leaf share one product.
    Scores are exact: products of integers in float64 while they stay below 2**53, else in int64. A score that does
    not fit into 64 bits is an error; sums that only pass them on the way come out right.
    """
    most = np.abs(x.astype(np.float64)).max(0, initial=0)
    exact = float(most.max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, x.shape[1]) < 2**53
    real = q.astype(np.float64)
    tree = Tree(x.astype(np.float64), leaf)
    bound = tree.bounds(real)
    if exact:
        x, q = x.astype(np.float64), real
    else:
        bound += 1e-9 * (np.abs(real) @ most)[:, None]  # more than float64 can be off
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s = np.full((len(q), k), LOWEST, np.int64)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    floor = kth.copy()
    live = np.arange(len(q))
    for r in range(len(tree.leaves)):
        at = order[live, r]
        live = live[bound[live, at] >= floor[live]]  # a tie may bring a smaller id
        if not len(live):
            break
        at = order[live, r]
        by = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[by])) + 1
        for group in np.split(live[by], edges):
            rows = tree.leaves[order[group[0], r]]
            own = qids[group][:, None] == ids[rows][None, :]
            if not exact and ((np.abs(real[group] @ x[rows].T.astype(np.float64)) >= 2**63 * (1 - 1e-9)) & ~own).any():
                raise ValueError("a score does not fit into 64 bits")
            s = (q[group] @ x[rows].T).astype(np.int64)
            s[own] = LOWEST
            cs = np.concatenate([best_s[group], s], axis=1)
            ci = np.concatenate([best_i[group], np.broadcast_to(ids[rows], s.shape)], axis=1)
            if cs.shape[1] > 4 * k:  # keep all that reach the kth score, ties included
                least = np.partition(cs, cs.shape[1] - k, axis=1)[:, cs.shape[1] - k]
                width = int((cs >= least[:, None]).sum(1).max())
                pick = np.argpartition(-cs, width - 1, axis=1)[:, :width]
                cs, ci = np.take_along_axis(cs, pick, 1), np.take_along_axis(ci, pick, 1)
            top = np.lexsort((ci, -cs), axis=1)[:, :k]
            best_s[group], best_i[group] = np.take_along_axis(cs, top, 1), np.take_along_axis(ci, top, 1)
            floor[group] = np.maximum(floor[group], best_s[group][:, -1])
    keep = (best_s > LOWEST) & (best_s >= kth[:, None])
    row = np.nonzero(keep)[0]
    return row, best_i[keep], best_s[keep]


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c
    flat = c.flatten().to_numpy()
    return flat.reshape(len(c), -1)


def _cell(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            q, qids = _matrix(right, "qv"), right.column("query_id").to_numpy()
            row, vec, score = search(left.column("vec_id").to_numpy(), _matrix(left, "v"), qids, q, right.column("kth").to_numpy(), k)
            out = (qids[row], vec, score)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return run


def _searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scores of the cells (dim, shard, block) that both sides name."""
    cell = ["dim", "shard", "block"]
    return vectors.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(_cell(k), "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries`` (vec_id, v) against all ``vectors`` (vec_id, v).

    A query's own row never takes part; vectors of another length than the query's do not either. Ties go
    to the smaller vec_id; fewer than ``k`` candidates give fewer rows. Both sides need distinct ids. A score beyond
    64 bits that is met in the search stops the job.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    dim, shard = F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block")
    c = vectors.select("vec_id", "v", dim, shard)
    every = c.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), dim, shard, block)
    home = stage(_searched(every, q.withColumn("kth", F.lit(LOWEST)), k), "home")
    kth = _best(home, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    q = q.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(LOWEST)))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")), lambda s: s != F.col("home"))
    q = q.withColumnRenamed("shard", "home").withColumn("shard", F.explode(others)).drop("home")
    found = home.unionByName(_searched(every, q, k)) if shards > 1 else home
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
