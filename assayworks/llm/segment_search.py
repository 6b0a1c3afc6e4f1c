"""Exact top-k by inner product, pruned with segment statistics, coarse to fine.

A vector cut into segments has in each a mean and a deviation (the length of what the mean leaves).
For q and x, the squared distance is at least the sum over segments of size * (difference of
means)^2 + (difference of deviations)^2; with both lengths known, that lower bound of the distance
is an upper bound of the inner product: size * mean * mean + deviation * deviation, summed up.
Few segments rule out most vectors, more rule out others, and exact products decide the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayworks.llm.common import lists, shuffle_partitions

#: Segments at each level, coarse to fine.
LEVELS = (1, 4, 16)
#: Rows and queries that meet in one task's group.
SHARD_ROWS, BLOCK_QUERIES = 4096, 2048


def whole(embedding: Column) -> Column:
    """Vectors without a null, NaN or infinite component."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): whole vectors as floor(scale * x); of rows that share a vec_id, the smallest vector."""
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return (
        vectors.where(F.col("vec_id").isNotNull() & whole(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the vectors from above."""
    parts = np.array_split(x.astype(np.float64), min(segments, max(1, x.shape[1])), axis=1)
    means = np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]) if p.shape[1] else np.zeros(len(x)) for p in parts], 1)
    deviations = np.sqrt(np.maximum(0.0, np.stack([(p * p).sum(axis=1) for p in parts], 1) - means * means))
    return np.concatenate([means, deviations], axis=1)


def top_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of the k best vectors for each query, ties to smaller ids."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    q_stats, x_stats = [statistics(q, s) for s in LEVELS], [statistics(x, s) for s in LEVELS]
    # Rounding of the bounds, and of squares that are subtracted, stays far below this.
    slack = 1.0 + 1e-6 * np.linalg.norm(x.astype(np.float64), axis=1).max(initial=0.0) * np.linalg.norm(q.astype(np.float64), axis=1)
    for i, me in enumerate(q_ids):
        alive = np.flatnonzero(ids != me)
        least = None
        for qs, xs in zip(q_stats, x_stats, strict=True):
            bound = xs[alive] @ qs[i]
            if len(alive) > k:
                best = alive[np.argpartition(-bound, k)[:k]]
                reached = int((x[best] @ q[i]).min())
                least = reached if least is None else max(least, reached)
                alive = alive[bound + slack[i] >= least]
        score = x[alive] @ q[i]
        # ids are sorted, so a stable sort gives ties to the smaller one.
        for j in np.argsort(-score, kind="stable")[:k]:
            out.append((int(me), int(ids[alive[j]]), int(score[j])))
    return out


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("v").combine_chunks()
        values, offsets = lists(column)
        sizes = np.diff(offsets)
        ids = table.column("vec_id").to_numpy()
        asks = table.column("asks").to_numpy()
        found = []
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            x = values[(offsets[rows][:, None] + np.arange(d)[None, :]).astype(np.int64)].reshape(len(rows), d)
            a = asks[rows].astype(bool)
            found += top_of(ids[rows][a], x[a], ids[rows][~a], x[~a], k)
        query, vec, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})
    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products for each query.

    Queries are the rows for which ``asks`` (over vec_id) holds, candidates are all rows but those with
    the query's own id. Components are floor(scale * x), products exact integers (they must fit 64
    bits). Ties go to the smaller vec_id; with fewer candidates than ``k`` all are returned. Rows
    without an id, null vectors and vectors holding null or non-finite components take no part;
    vectors meet only others of their own length; rows that share an id count once.

    Queries come in blocks and rows in shards, and each block meets each shard in one task's group:
    both sizes are fixed, so groups stay small while their number grows.
    """
    v = quantized(vectors, scale)
    # Rows that take no part only make the shards a little smaller.
    counts = vectors.where(F.col("vec_id").isNotNull()).agg(F.count("*"), F.count(F.when(asks, 1))).first()
    shards = max(-(-counts[0] // shard_rows), shuffle_partitions(vectors.sparkSession))
    blocks = max(1, -(-counts[1] // block_queries))
    spread = F.xxhash64("vec_id")
    rows = v.select("vec_id", "v", F.lit(False).alias("asks"), F.pmod(spread, F.lit(shards).cast("long")).alias("shard"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    queries = v.where(asks).select("vec_id", "v", F.lit(True).alias("asks"),
                                   F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                                   F.pmod(spread, F.lit(blocks).cast("long")).alias("block"))
    near = rows.unionByName(queries).groupBy("shard", "block").applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
