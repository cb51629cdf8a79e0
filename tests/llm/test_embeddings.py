"""Embedding near-duplicates against brute force on clustered vectors, and their edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, mark int, keys string"


def brute(ids, vectors, threshold=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    component = np.array(ids)
    while True:
        new = np.where(linked, component[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(component, new)
        if (new == component).all():
            return linked.sum(axis=1), component
        component = new


def clustered(n=5000, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    noise = rng.uniform(0.01, 0.09, size=(n, 1)) * rng.standard_normal((n, dim))
    return centres[rng.integers(0, n // 8, n)] + noise


def test_clusters(spark):
    vectors = clustered()
    rows = [(10 * i + 7, v.tolist(), 0, "k") for i, v in enumerate(vectors)]
    n_links, component = brute([r[0] for r in rows], vectors)
    assert n_links.sum() > 10000
    for options in ({}, {"block": 8}):  # small blocks: buckets in pairs of blocks
        found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(8), **options).collect()}
        got = np.array([found[r[0]].n_links for r in rows])
        assert (got <= n_links).all() and got.sum() >= 0.97 * n_links.sum()
        same = sum(found[r[0]].component_id == c for r, c in zip(rows, component.tolist(), strict=True))
        assert same >= 0.98 * len(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_close_groups_are_whole(spark):
    """A third of all rows in one group of near copies: every link is counted, though no pair is listed."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    vectors = np.concatenate((centre + 0.02 * rng.standard_normal((300, 16)), rng.standard_normal((600, 16))))
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(vectors)]
    n_links, component = brute(list(range(900)), vectors)
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=64).collect()}
    assert [found[i].n_links for i in range(300)] == n_links[:300].tolist() and [found[i].component_id for i in range(300)] == component[:300].tolist()


def test_edges(spark):
    one, inf, nan = [1.0, 0.0, 0.0], math.inf, math.nan
    rows = [(5, one, 1, "a"), (3, one, 2, "b"), (3, one, 2, "b"), (9, [-0.0, 0.0, 0.0], 0, ""), (10, None, 0, ""), (11, [], 0, ""), (12, [nan, 1.0, 0.0], 0, ""), (13, [inf, 1.0, 0.0], 0, "")]
    rows += [(14, [None, 1.0, 0.0], 0, ""), (15, [2.0, 0.0, 0.0], 0, ""), (16, [1.0, 0.0], 0, ""), (17, [-1.0, 0.0, 0.0], 0, ""), (None, [0.0, 1.0, 0.0], 0, ""), (None, [0.0, 1e-200, 0.0], 0, ""), (18, [1e300, 1e299, 0.0], 0, ""), (None, [0.0, 0.0, 3.0], 0, "")]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=repr)
    want = [(5, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (15, 4, 3, False), (18, 4, 3, False)] + [(i, 0, i, True) for i in (9, 10, 11, 12, 13, 14, 16, 17)]
    assert got == sorted(want + [(None, 1, None, True)] * 2 + [(None, 0, None, True)], key=repr)
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    floats = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert embeddings.near_duplicates(floats).where("vec_id = 5").first().n_links == 3  # 1e300 is no finite float
