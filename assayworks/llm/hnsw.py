"""Near-duplicate vectors by navigable small-world graphs, one per shard.

Equal vectors are one class. Each label's classes are dealt to shards of a bounded size; a task
builds a layered graph for a shard, and every class asks every shard of its label. A search goes on
while it meets vectors within the threshold, so large groups are found whole. In each task a sample
of queries is checked against all vectors of the shard, and beams widen until nothing is missed.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayworks.llm.common import lists, mix, written
from assayworks.llm.graph import components
from assayworks.llm.segment_search import whole

THRESHOLD = 0.98
#: Classes in a shard and queries in a block, links of a node, and the beam that building uses.
SHARD_ROWS, BLOCK_QUERIES = 4096, 4096
LINKS, BUILD_BEAM = 12, 40
#: The first beam of a search, queries audited in each task, and the recall they must reach.
BEAM, AUDITED, RECALL = 16, 128, 1.0


class SmallWorld:
    """A layered graph over unit vectors."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray) -> None:
        self.unit = unit
        draws = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        self.height = [int(-math.log(max(u, 1e-12)) / math.log(LINKS)) for u in draws]
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(max(self.height, default=0) + 1)]
        self.entry = -1
        for node in range(len(unit)):
            self._insert(node)
        self._repair()

    def _repair(self) -> None:
        """Give nodes that nothing leads to any more a link from the nearest node that is reached."""
        links = self.layers[0]
        reached = np.zeros(len(self.unit), bool)
        todo = [self.entry] if self.entry >= 0 else []
        reached[todo] = True
        while True:
            while todo:
                for n in links[todo.pop()]:
                    if not reached[n]:
                        reached[n] = True
                        todo.append(n)
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            node = int(lost[0])
            known = np.flatnonzero(reached)
            links[int(known[np.argmax(self.unit[known] @ self.unit[node])])].append(node)
            reached[node] = True
            todo.append(node)

    def search(self, q: np.ndarray, starts: list[int], beam: int, layer: int, threshold: float = 2.0) -> list[tuple[float, int]]:
        """The ``beam`` most similar nodes, and all met on the way through nodes of at least ``threshold``."""
        links, unit = self.layers[layer], self.unit
        seen = set(starts)
        sims = unit[starts] @ q
        todo = [(-s, n) for s, n in zip(sims.tolist(), starts, strict=True)]
        heapq.heapify(todo)
        best = [(-s, n) for s, n in todo]
        heapq.heapify(best)
        inside = [(s, n) for s, n in best if s >= threshold]
        while todo:
            s, node = heapq.heappop(todo)
            if -s < threshold and len(best) >= beam and -s < best[0][0]:
                break
            fresh = [n for n in links[node] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for sim, n in zip((unit[fresh] @ q).tolist(), fresh, strict=True):
                if sim >= threshold:
                    inside.append((sim, n))
                if len(best) < beam:
                    heapq.heappush(best, (sim, n))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, n))
                elif sim < threshold:
                    continue
                heapq.heappush(todo, (-sim, n))
        return inside if threshold <= 1.0 else best

    def _spread(self, node: int, found: list[int], most: int) -> list[int]:
        """Neighbours nearer to the node than to one another, filled up with the nearest left."""
        near = self.unit[found]
        sims = near @ self.unit[node]
        order = np.argsort(-sims, kind="stable").tolist()
        between = near @ near.T
        taken: list[int] = []
        left = []
        for i in order:
            if len(taken) == most:
                break
            if all(between[i, j] <= sims[i] for j in taken):
                taken.append(i)
            else:
                left.append(i)
        taken += left[:most - len(taken)]
        return [found[i] for i in taken]

    def _insert(self, node: int) -> None:
        height = self.height[node]
        if self.entry < 0:
            for layer in range(height + 1):
                self.layers[layer][node] = []
            self.entry = node
            return
        q = self.unit[node]
        top = self.height[self.entry]
        at = self.entry
        for layer in range(top, height, -1):
            at = max(self.search(q, [at], 1, layer))[1]
        starts = [at]
        for layer in range(min(height, top), -1, -1):
            found = [n for _, n in self.search(q, starts, BUILD_BEAM, layer)]
            most = 2 * LINKS if layer == 0 else LINKS
            mine = self._spread(node, found, LINKS)
            links = self.layers[layer]
            links[node] = mine
            for n in mine:
                links[n].append(node)
                if len(links[n]) > most:
                    links[n] = self._spread(n, links[n], most)
            starts = found
        for layer in range(top + 1, height + 1):
            self.layers[layer][node] = []
        if height > top:
            self.entry = node

    def around(self, q: np.ndarray, threshold: float, beam: int, own: int = -1) -> list[int]:
        """Nodes of at least ``threshold``; ``own`` is the query's node, if it is in this graph."""
        at = self.entry
        for layer in range(self.height[self.entry], 0, -1):
            at = max(self.search(q, [at], 1, layer))[1]
        starts = [at] if own < 0 or own == at else [at, own]
        return [n for _, n in self.search(q, starts, beam, 0, threshold)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values, offsets = lists(column.combine_chunks())
    d = int(offsets[1]) if len(offsets) > 1 else 0
    return values.astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / norm[:, None], norm


def _build(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("id")
    x = _matrix(table.column("embedding"))
    ids = table.column("id").to_numpy()
    blob = pickle.dumps((ids, table.column("members").to_numpy(), x, SmallWorld(ids, _unit(x)[0])))
    return pa.table({c: table.column(c).slice(0, 1) for c in ("label", "dims", "shard")} | {"world": pa.array([blob], pa.binary())})


def _ask(threshold: float, recall: float):
    def run(queries: pa.Table, worlds: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not queries.num_rows or not worlds.num_rows:
            return empty
        ids, members, x, world = pickle.loads(worlds.column("world")[0].as_py())
        q_ids, q = queries.column("id").to_numpy(), _matrix(queries.column("embedding"))
        unit, norm = _unit(q)
        x_norm = _unit(x)[1]
        at = np.searchsorted(ids, q_ids).clip(max=len(ids) - 1)
        own = np.where(ids[at] == q_ids, at, -1)
        near = threshold - 1e-9
        sample = np.argsort(mix(q_ids.astype(np.int64).view(np.uint64)))[:AUDITED]
        truth = {int(i): set(np.flatnonzero(world.unit @ unit[i] >= near).tolist()) for i in sample}
        beam = BEAM
        while True:
            hit = sum(len(t & set(world.around(unit[i], near, beam, int(own[i])))) for i, t in truth.items())
            if beam >= len(ids) or hit >= recall * sum(map(len, truth.values())):
                break
            beam *= 2
        names = np.concatenate([q_ids, ids])
        parent = {int(n): int(n) for n in names}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        links = np.zeros(len(q_ids), np.int64)
        for i in range(len(q_ids)):
            found = np.array([n for n in world.around(unit[i], near, beam, int(own[i])) if n != own[i]], np.int64)
            if len(found):
                found = found[x[found] @ q[i] / (x_norm[found] * norm[i]) >= threshold]
            links[i] = members[found].sum()
            a = root(int(q_ids[i]))
            for n in ids[found].tolist():
                b = root(n)
                a, b = min(a, b), max(a, b)
                parent[b] = a
        counted = dict(zip(q_ids.tolist(), links.tolist(), strict=True))
        nodes = sorted(parent)
        return pa.table({"id": pa.array(nodes, pa.int64()), "links": pa.array([counted.get(n, 0) for n in nodes], pa.int64()),
                         "root": pa.array([root(n) for n in nodes], pa.int64())})
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shard_rows: int = SHARD_ROWS,
                 block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows with equal, non-null labels are linked if the cosine of their vectors, in double
    precision, is at least ``threshold``. n_links counts the other rows linked directly, component_id
    is the smallest vec_id that links lead to, and a row is kept if that is its own. Rows without
    an id or label, null, empty and zero vectors and those holding null or non-finite components
    link with nothing, and vectors only with others of their length. Equal vectors are one class,
    which all its rows share; rows that share a vec_id with different vectors are one node.
    """
    e = F.col("embedding")
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(e)
           & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False)))
    rows = written(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding",
        F.coalesce(fit, F.lit(False)).alias("fit")), "hnsw-rows")
    classes = written(
        rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("members"))
        .withColumn("dims", F.size("embedding")), "hnsw-classes")
    counts = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = classes.join(counts, ["label", "dims"])
    world_rows = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    worlds = written(world_rows.select("label", "dims", "shard", "id", "members", "embedding").groupBy("label", "dims", "shard").applyInArrow(
        _build, "label string, dims int, shard int, world binary"), "hnsw-worlds")
    blocks = counts.withColumn("blocks", F.ceil(F.col("shards") * shard_rows / block_queries))
    queries = (
        classes.join(blocks, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
        .select("label", "dims", "block", "id", "embedding", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard"))
    )
    copies = worlds.join(blocks.select("label", "dims", "blocks"), ["label", "dims"]).select(
        "label", "dims", "shard", "world", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    keys = ("label", "dims", "shard", "block")
    found = written(queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(
        _ask(threshold, recall), "id long, links long, root long"), "hnsw-found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "hnsw-links")
    of_class = (
        classes.select("label", "embedding", "id", "members").join(links, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select(F.col("label"), F.col("embedding"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component"), F.lit(True).alias("fit"))
    )
    placed = rows.join(of_class, ["label", "embedding", "fit"], "left")
    own = F.coalesce("component", "vec_id")
    return placed.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                         own.eqNullSafe(F.col("vec_id")).alias("kept"))
