"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from panelyard.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<double>, label int, node long, v string, n int"


def brute(rows, least=0.95):
    """{row number: (n_links, component_id)}."""
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = cp.units(np.array([v], float))[0]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return sorted((str(i), links[k], str(ids.get(root(k)))) for k, (i, _) in enumerate(rows))


def near(rng, center, spread, n):
    return [(center + spread * rng.standard_normal(len(center))).tolist() for _ in range(n)]


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA).repartition(3)
    got = cp.near_vectors(df).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got)


@pytest.mark.parametrize("length", [3, 24, 64])
def test_all_links(spark, length):
    rng = np.random.default_rng(length)
    vectors = [rng.standard_normal(length).tolist() for _ in range(60)]
    for spread in (0.1, 0.2, 0.3):
        vectors += near(rng, rng.standard_normal(length), spread, 25)
    vectors += [vectors[70]] * 12 + [[2 * x for x in vectors[71]], [-x for x in vectors[71]]]
    ids = rng.permutation(len(vectors)).tolist()
    rows = list(zip(ids, vectors))
    assert found(spark, rows) == brute(rows)


def test_hot_buckets_balls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cp, "HOT", 8)
    monkeypatch.setattr(cp, "BLOCK", 4)
    rng = np.random.default_rng(5)
    center = rng.standard_normal(32)
    rows = list(enumerate(near(rng, center, 0.12, 60) + near(rng, center, 0.25, 40) + near(rng, rng.standard_normal(32), 0.2, 30) + [center.tolist()] * 20))
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]), (5, [1.0, nan, 1.0]), (6, [inf, 1.0, 1.0]), (7, one), (8, one), (8, one), (None, one), (None, None), (9, [1.0, 2.0]), (10, [1e300, 2e300, 3e300]), (11, [1e-300, 2e-300, 3e-300]), (12, [5.0]), (13, [-5.0]), (14, [7.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:6]) == brute(rows[:6])
    assert found(spark, []) == []


def test_transform_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(1).standard_normal((5, 16))
    y = cp.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(cp.hadamard(y), x)


def test_tables_leave_few_pairs_unmet():
    rng = np.random.default_rng(9)
    width = cp.width_for(50_000, 64)
    hashes = cp.Hashes(64, width, cp.tables_for(64, width))
    a = cp.units(rng.standard_normal((4000, 64)))
    b = rng.standard_normal((4000, 64))
    b = cp.units(b - np.einsum("ij,ij->i", a, b)[:, None] * a)
    b = cp.LEAST * a + math.sqrt(1 - cp.LEAST**2) * b
    x, y = hashes.codes(a), hashes.codes(b)
    assert (cp.meeting(x, y) | cp.meeting(y, x)).any(axis=1).mean() >= 0.998
