"""Exact top-k search and centroid clustering against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repricer.llm import clusters, topk

VECTORS = "vec_id long, embedding array<double>, label int, v string, cluster int, row long"


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows, kind="double"):
        full = [(i, v, 1, "x", 5, 7) for i, v in rows]
        return spark.createDataFrame(full, VECTORS.replace("double", kind))

    return make


def drawn(seed, n, width, groups=5, spread=0.3):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    rows = []
    for i in range(n):
        length = draw.choice([0.2, 1, 1, 3])
        rows.append((i, [length * (x + draw.gauss(0, spread)) for x in draw.choice(centers)]))
    return rows


def odd(width):
    """Vectors that take no part, and those that do although they look odd."""
    nan, inf = float("nan"), float("inf")
    out = [(9000, None), (9001, [None] + [1.0] * (width - 1)), (9002, [nan] * width), (9003, [1.0] * (width - 1) + [inf]), (9100, [-inf] * width)]
    return out, [(9200, [0.0] * width), (9300, [-1.0] * width), (None, [2.0] * width), (9300, [0.5] * width)]


# top-k


def best(rows, k, scale):
    whole = [
        (i, [max(-topk.BOUND, min(topk.BOUND, math.floor(scale * x))) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = Counter()
    for a, (query, x) in enumerate(whole):
        if query is None or query % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(whole) if a != b]
        for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1):
            found[query, rank, None if null else i, -score] += 1
    return found


def found(df, k=10, **settings):
    rows = topk.top_inner_products(df, F.col("vec_id") % 100 == 0, k, **settings).collect()
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows)


@pytest.mark.parametrize("width, k, spread", [(16, 10, 0.05), (7, 3, 1.0)])
def test_top_k(vectors, monkeypatch, width, k, spread):
    # small blocks and steps, so that every bound is met
    monkeypatch.setattr(topk, "CELLS", 64 * width)
    monkeypatch.setattr(topk, "STEP", 16)
    out, kept = odd(width)
    rows = drawn(width, 900, width, spread=spread) + out + kept
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a third of equal vectors: all ties
    assert found(vectors(rows), k) == best(rows, k, topk.SCALE)


def test_top_k_of_uneven_and_large_vectors(vectors, monkeypatch):
    monkeypatch.setattr(topk, "ROTATED", 4)
    draw = random.Random(4)
    rows = [(10 * i, [draw.uniform(-2, 2) for _ in range(draw.choice([0, 1, 3, 4, 9]))]) for i in range(80)]
    rows += [(5, [2e5, -2e5, 1e5]), (200, [-3e5, 1e30, 7.0]), (300, [0.25] * 4000), (400, [])]
    assert found(vectors(rows), 5) == best(rows, 5, topk.SCALE)
    assert found(vectors([(i, v[:3]) for i, v in rows], "float"), 5) == best([(i, [float(F32(x)) for x in v[:3]]) for i, v in rows], 5, topk.SCALE)


def F32(x):
    import numpy as np

    return np.float32(x)


def test_few_or_no_vectors(vectors):
    assert found(vectors([])) == Counter() == found(vectors([(1, [1.0])])) == found(vectors([(100, None)]))
    assert found(vectors([(100, [1.0])])) == Counter()
    two = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [1.0, 1.0])]
    assert found(vectors(two)) == best(two, 10, topk.SCALE)


def test_bounds_spare_most_of_the_scoring(vectors, monkeypatch):
    """Short vectors are never sent to the queries, and few pairs are scored exactly."""
    rows = [(i, [10.0 if j == i % 4 else 0.01 * ((i * j) % 7) for j in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.001] * 8) for i in range(4000)]
    monkeypatch.setattr(topk, "CELLS", 8 * 128)
    received = []
    real = topk._met

    def met(blocks, queries, *rest):
        received.append(queries.count())
        return real(blocks, queries, *rest)

    monkeypatch.setattr(topk, "_met", met)
    assert found(vectors(rows)) == best(rows, 10, topk.SCALE)
    n_queries = sum(i % 100 == 0 for i, _ in rows)
    assert received[1] < 2 * n_queries  # of the four partitions each query needs about one


# clustering


def by_rounds(rows, k, rounds, width, scale, seed=2):
    held = lambda x: math.floor(max(-clusters.BOUND, min(clusters.BOUND, scale * x)))
    kept = [(i, [held(x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)[:k]
    centroids = [v for *_, v in seeds]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centroids)]
    near = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, distance, j in near:
        inertia[j] += distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 1 << 63 else None
    return Counter((i, j, d, fits(inertia[j]), fits(sum(inertia.values())), digest[j]) for i, d, j in near)


def assigned(df, **settings):
    rows, centroids = clusters.clustered(df, **settings)
    rows = rows.withColumn("centroid_sha256", clusters.centroid_digests(centroids)).collect()
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows)


def test_clusters(vectors):
    out, kept = odd(6)
    rows = drawn(6, 300, 6) + out + kept + [(9400, [1.0] * 5), (9401, []), (9402, [0.3] * 6), (9403, [0.3] * 6)]
    rows += [(2000 + i, rows[5][1]) for i in range(100)] + [rows[7]] * 3  # copies, repeated rows
    settings = {"clusters": 12, "rounds": 3, "dimensions": 6}
    assert assigned(vectors(rows), **settings) == by_rounds(rows, 12, 3, 6, clusters.SCALE)
    assert assigned(vectors(rows, "float"), **settings) == by_rounds([(i, v and [x if x is None else float(F32(x)) for x in v]) for i, v in rows], 12, 3, 6, clusters.SCALE)


def test_few_and_huge_vectors(vectors):
    settings = {"clusters": 5, "rounds": 2, "dimensions": 2}
    assert assigned(vectors([]), **settings) == Counter() == assigned(vectors([(1, None), (2, [1.0])]), **settings)
    rows = [(1, [1e300, -1e300]), (2, [5e5, -5e5]), (3, [0.0, 0.0])]
    assert assigned(vectors(rows), **settings) == by_rounds(rows, 5, 2, 2, clusters.SCALE)
    many = [(i, [1e300 * (-1) ** i] * 2) for i in range(9)]
    assert assigned(vectors(many), clusters=1, rounds=1, dimensions=2) == by_rounds(many, 1, 1, 2, clusters.SCALE)


def test_rounds_run_no_python(vectors):
    kept = clusters.whole_vectors(vectors([(1, [1.0, 2.0])]), 2, 256)
    plan = kept.select(clusters.nearest(F.col("v"), [[0, 0], [9, 9]]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
