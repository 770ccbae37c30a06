"""Ball k-means against Lloyd's rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from strandweave.llm import ballkmeans  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, path string"


def plain(rows, dim, clusters, rounds):
    good = [(i, [64 * int(x) if math.isinf(64 * x) else math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(good, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in start[:clusters]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda k: (far(x, centres[k]), k)) for _, x in good]
        if turn < rounds:
            for k in range(len(centres)):
                if members := [x for (_, x), c in zip(good, own) if c == k]:
                    centres[k] = [sum(column) // len(members) for column in zip(*members)]
    most = ballkmeans.LONGEST
    distances = [far(x, centres[k]) for (_, x), k in zip(good, own)]
    inertia = [sum(d for d, c in zip(distances, own) if c == k) for k in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, k, min(most, d), min(most, inertia[k]), min(most, sum(distances)), digest[k]) for (i, _), k, d in zip(good, own, distances))


def got(spark, rows, dim, clusters=16, rounds=3):
    table = spark.createDataFrame([(i, v, 0, 9, "p") for i, v in rows], SCHEMA)
    out = ballkmeans.clustered(table, dim, clusters, rounds).drop("cluster_size", "n_compared")
    return sorted(tuple(r) for r in out.collect())


def test_clusters_equal_plain_rounds_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(7, 8))
    rows = [(i, (middles[i % 7] + 0.2 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(120)]  # many ties
    rows += [(1, rows[1][1]), (1, rows[1][1]), (5, [0.0] * 8), (500, None), (None, [1.0] * 8), (501, [1.0] * 7), (502, [])]
    rows += [(503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7), (505, [None] + [0.0] * 7), (506, [0.0] * 8), (-3, [-0.001] * 8), (-4, [-1e-300] * 8)]
    assert got(spark, rows, 8) == plain(rows, 8, 16, 3)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 14)).tolist()) for i in range(60)] + [(70, [1e308, -1e308, 0.0, 2.5])]
    assert got(spark, rows, 4, 5, 2) == plain(rows, 4, 5, 2)


def test_few_vectors_and_none(spark):
    rows = [(2, [1.0, 2.0]), (1, [1.0, 2.0]), (3, [9.0, 9.0])]
    assert got(spark, rows, 2) == plain(rows, 2, 16, 3)
    assert got(spark, [], 2) == [] and got(spark, [(1, None)], 2) == []


def test_balls_leave_comparisons_out_and_change_nothing():
    rng = np.random.default_rng(7)
    middles = rng.integers(-4000, 4000, (16, 6)).astype(float)
    members = np.floor(middles[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 6)) * 60)
    first, _ = ballkmeans.nearest(members, middles)
    moved = np.floor(middles + rng.normal(size=middles.shape) * 20)
    at, best, taken = ballkmeans.reassigned(members, moved, first)
    want, distance = ballkmeans.nearest(members, moved)
    assert (at == want).all() and (best == distance).all()
    assert taken < 0.2 * len(members) * 16
