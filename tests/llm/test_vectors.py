"""Top-k and near-duplicate vectors against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayworks.llm import hnsw
from assayworks.llm.hnsw import near_vectors
from assayworks.llm.segment_search import statistics, top_k
from tests.llm.brute import Union

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors(n=400, d=10):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        spread = rng.choice([0.0, 0.0, 0.02, 0.06, 0.5])
        rows.append((i, [float(np.float32(c + rng.gauss(0, spread))) for c in centre], rng.choice([0, 0, 0, 1, 2, None])))
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * d, 0), (n + 3, [math.nan] * d, 0), (n + 4, [math.inf] + [1.0] * (d - 1), 0),
             (n + 5, [None] + [1.0] * (d - 1), 0), (None, [1.0] * d, 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0),
             (n + 50, [1.0] * d, 1), (n + 51, [2.0] * d, 1), (n + 52, [-0.0] + [1.0] * (d - 1), 1), (n + 53, [0.0] + [1.0] * (d - 1), 1)]
    return rows


def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def test_top_k(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("score", F.lit(1)).repartition(4)
    good = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows if i is not None and usable(e)}
    for k, options in ((5, {}), (3, {"shard_rows": 30, "block_queries": 4}), (1000, {})):
        found: dict = {}
        for r in top_k(df, F.col("vec_id") % 10 == 0, k, **options).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in (i for i in good if i % 10 == 0):
            all_pairs = sorted((-sum(a * b for a, b in zip(good[q], e, strict=True)), i) for i, e in good.items() if i != q and len(e) == len(good[q]))
            assert found.get(q, []) == [(n + 1, i, -s) for n, (s, i) in enumerate(all_pairs[:k])]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, (200, 13)), rng.integers(-300, 300, (20, 13))
    for segments in (1, 4, 16):
        bound = statistics(q, segments) @ statistics(x, segments).T
        assert (bound + 1e-6 >= q @ x.T).all()


def expected_links(rows, threshold):
    good = [(i, np.array(e, float), label) for i, e, label in rows if i is not None and label is not None and usable(e) and any(e or [])]
    union, n = Union([i for i, _, _ in rows if i is not None]), dict.fromkeys([i for i, _, _ in rows if i is not None], 0)
    for a, (i, x, label) in enumerate(good):
        for j, y, other in good[a + 1:]:
            if label == other and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[i] += 1
                n[j] += 1
                union.join(i, j)
    return {i: (n[i], union.root(i), union.root(i) == i) for i in n}


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "block_queries": 25}])
def test_near_vectors(spark, options):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("links", F.lit(1)).withColumn("id", F.lit(1)).repartition(4)
    found = near_vectors(df, **options).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id is not None} == expected_links(rows, 0.98)
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, True)]


def test_recall_of_the_graph():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([centres[rng.integers(0, 40, 700)] + rng.normal(scale=0.05, size=(700, 24)), rng.normal(size=(500, 24))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    world = hnsw.SmallWorld(np.arange(len(x)), unit)
    truth = [set(np.flatnonzero(unit @ u >= 0.97).tolist()) for u in unit]
    hit = sum(len(t & set(world.around(u, 0.97, hnsw.BEAM))) for t, u in zip(truth, unit, strict=True))
    assert hit / sum(map(len, truth)) >= 0.99
    # With the widest beam nothing is out of reach.
    assert all(t == set(world.around(u, 0.97, len(x))) for t, u in zip(truth, unit, strict=True))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    assert near_vectors(none).count() == 0
