"""Delta rounds against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from corvane.llm import centroids


def plain(rows, clusters=8, rounds=10, seed=3, dimensions=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    own = [v for _, v in order[:clusters]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((gap(v, c), k) for k, c in enumerate(own))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for k in range(len(own)):
            mine = [v for (_, v), c in zip(kept, at, strict=True) if c == k]
            if mine:
                own[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(r[2] for r in out)
    sums = {k: sum(r[2] for r in out if r[1] == k) for k in range(len(own))}
    return sorted(((i, k, d, sums[k], total, hashlib.sha256(",".join(map(str, own[k])).encode()).hexdigest()) for i, k, d in out), key=repr)


def rows_of(n, chance, spread):
    centres = [[chance.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [c + chance.gauss(0, spread) for c in chance.choice(centres)]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


@pytest.mark.parametrize("seed, spread", [(1, 0.05), (2, 0.6)])
def test_rounds(spark, seed, spread):
    rows = rows_of(600, random.Random(seed), spread)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in centroids.clustered(df).collect()), key=repr) == plain(rows)


def test_edges(spark):
    """Nulls, other lengths, values that are no numbers, ties, repeated rows, null ids, clusters that stay empty; fewer vectors than clusters; none."""
    nan, inf = float("nan"), float("inf")
    vector = lambda x: [float(x)] * 64
    rows = [(1, vector(0)), (1, vector(0)), (2, vector(1)), (3, vector(-1)), (None, vector(0.5)), (None, None), (4, [1.0] * 63), (5, [nan] * 64), (6, [inf] * 64), (7, [None] * 64), (8, []), (9, vector(-0.0001)), (10, vector(1)), (11, vector(1)), (12, vector(3))]
    for part in (rows, rows[:3], rows[5:8], []):
        df = spark.createDataFrame([(*r, "c", 1) for r in part], SCHEMA)
        assert sorted((tuple(r) for r in centroids.clustered(df).collect()), key=repr) == plain(part)
    with pytest.raises(PySparkException, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, vector(1e9), "c", 1)], SCHEMA))


def test_reassigned():
    """Comparing the changed centroids alone gives what comparing all does, ties and centroids without vectors included."""
    chance = np.random.default_rng(7)
    for _ in range(200):
        x, old = chance.integers(-3, 4, (30, 3)), chance.integers(-3, 4, (5, 3))
        changed = chance.random(5) < 0.4
        new = np.where(changed[:, None], chance.integers(-3, 4, (5, 3)), old)
        every = np.arange(5)
        first = centroids.distances(x, old, every)
        own, distance = first.argmin(axis=1), first.min(axis=1)
        got = centroids.reassigned(x, own, distance, new, changed)
        want = centroids.distances(x, new, every)
        assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()
