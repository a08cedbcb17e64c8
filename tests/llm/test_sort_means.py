"""Sort-means against a plain k-means over all pairs in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillstone.llm import sort_means
from quillstone.llm.common import Scratch


def brute(rows, k, rounds, dimension):
    kept = [(i, [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, _, v in sorted((name(i), [float(x) for x in v], v) for i, v in kept)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if n == rounds:
            break
        for j in range(len(centres)):
            own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    whole, part = sum(d for d, _ in at), {}
    for d, j in at:
        part[j] = part.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda v: v if v < 1 << 63 else None
    return sorted((repr((i, j, fits(d), fits(part[j]), fits(whole), sha[j])) for (i, _), (d, j) in zip(kept, at, strict=True)))


def run(spark, rows, k, rounds, dimension, kind="float", extra=False):
    df = spark.createDataFrame([(i, v) for i, v in rows], f"vec_id long, embedding array<{kind}>").repartition(3)
    if extra:
        df = df.selectExpr("*", "1 AS cluster", "'x' AS kind", "2 AS distance")
    out = sort_means.sort_means(Scratch(spark, "test"), df, k=k, dimension=dimension, rounds=rounds, scale=256, salt="2")
    return sorted(repr(tuple(r)) for r in out.collect())


def vectors(n, dimension, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.uniform(-2, 2) for _ in range(dimension)] for _ in range(6)]
    return [(i, [float(np.float32(x + r.gauss(0, 0.2) * spread)) for x in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("dimension,k,seed", [(64, 40, 1), (3, 7, 2), (2, 5, 3)])
def test_equals_plain_k_means(spark, dimension, k, seed):
    rows = vectors(400, dimension, seed)
    assert run(spark, rows, k, 5, dimension) == brute(rows, k, 5, dimension)


def test_ties_copies_and_odd_vectors(spark):
    r = random.Random(4)
    rows = [(i, [r.randrange(3) / 256 for _ in range(2)]) for i in range(60)] + [(i, [0.0, 1 / 256]) for i in range(9)]
    rows += [(70, None), (71, []), (72, [1.0]), (73, [1.0, None]), (74, [1.0, float("nan")]), (75, [float("inf"), 0.0]), (None, [0.5, 0.5]), (76, [1.0, 2.0, 3.0])]
    assert run(spark, rows, 8, 5, 2, extra=True) == brute(rows, 8, 5, 2)
    assert run(spark, rows[:3], 8, 5, 2) == brute(rows[:3], 8, 5, 2)
    assert run(spark, [], 8, 5, 2) == []


def test_components_beyond_exact_doubles(spark):
    rows = vectors(50, 2, 5) + [(100, [123456.75, -99999.5]), (101, [123456.25, -99999.0]), (102, [3e38, -3e38]), (103, [1e30, 5.0])]
    assert run(spark, rows, 6, 5, 2, "double") == brute(rows, 6, 5, 2)


def test_scan_skips_most_centroids():
    """Tight clusters far apart: nearly every vector stops at the first other centroid."""
    c = sort_means.Centroids([[1000 * i, 0] for i in range(50)])
    met = []
    plain = sort_means._squares
    sort_means._squares = lambda m, x: met.append(len(m)) or plain(m, x)
    try:
        m = np.array([[1000.0 * (i % 50) + i % 7, 3.0] for i in range(5000)])
        nearest, best = c.assign(m, np.arange(5000) % 50)
    finally:
        sort_means._squares = plain
    assert (nearest == np.arange(5000) % 50).all() and best.max() == 45
    assert sum(met) == 5000
