"""Centroid clustering: SQL, a plain version in Python integers, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from deedlens.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string"


def brute(rows, k=8, rounds=10):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds if c else 0):
        of = assign()
        for n in range(len(c)):
            members = [v for (_, m), (_, v) in zip(of, kept) if m == n]
            if members:
                c[n] = [sum(col) // len(members) for col in zip(*members)]
    of = assign()
    total = sum(d for d, _ in of)
    return sorted(
        (str(i), n, d, sum(x for x, m in of if m == n), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, of)
    )


def found(df, **how):
    rows = centroids.sort_means(df, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((str(r[0]), *r[1:]) for r in rows)


def made(random, n, spread=0.2):
    middle = random.normal(0, 1, (5, 64))
    return [(int(i), [float(x) for x in middle[i % 5] + random.normal(0, spread, 64)], 0, "c", "v") for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_every_pair(spark, spread):
    rows = made(np.random.default_rng(1), 120, spread)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_scans_stop_only_strictly_beyond():
    """Ties between centroids at exactly twice the distance go to the smaller number."""
    c = np.zeros((3, 4), np.int64)
    c[0, 0], c[1, 0], c[2, 0] = 20, 0, 10
    x = np.array([[10, 0, 0, 0], [5, 0, 0, 0], [15, 0, 0, 0], [-7, 3, 0, 0]], np.int64)
    for before in range(3):
        cluster, distance = centroids.nearest(x, np.full(4, before), c)
        every = ((x[:, None, :] - c) ** 2).sum(2)
        assert cluster.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()


def test_nearest_from_any_centroid():
    random = np.random.default_rng(2)
    x, c = random.integers(-40, 40, (500, 3)), random.integers(-40, 40, (20, 3))
    cluster, distance = centroids.nearest(x, random.integers(0, 20, 500), c)
    every = ((x[:, None, :] - c) ** 2).sum(2)
    assert cluster.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()


def test_odd_rows(spark):
    rows = made(np.random.default_rng(3), 12)
    odd = [(90, None), (91, []), (92, [0.5] * 63), (93, [0.5] * 63 + [None]), (94, [0.5] * 63 + [float("nan")]), (95, [0.5] * 63 + [float("-inf")]), (None, [0.5] * 64), (3, rows[3][1]), (3, rows[4][1])]
    rows += [(i, v, 0, "c", "v") for i, v in odd]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    same = [(i, [0.25] * 64, 0, "c", "v") for i in range(20)]  # equal centroids, all but one of them empty
    assert found(spark.createDataFrame(same, SCHEMA)) == brute(same)
    assert found(spark.createDataFrame(same[:2], SCHEMA)) == brute(same[:2])
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame(rows[12:18], SCHEMA)) == []


def test_large_components_are_clamped(spark):
    rows = [(i, [1e300 if i % 2 else -1e300] * 64, 0, "c", "v") for i in range(10)]
    got = found(spark.createDataFrame(rows, SCHEMA), k=1, rounds=1)
    assert [r[2] for r in got] == [centroids.BOUND**2 * 64] * 10 and got[0][4] is None
