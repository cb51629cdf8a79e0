"""The index of cells against brute force: recall, pruned reads, exact results with all cells, odd vectors."""

import numpy as np
import pandas as pd
import pytest

from corvane.operators import ranking, storage, vectors
from corvane.plans.queries import QUERIES, QUERY_VECTOR, cells, read

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def clustered(spark):
    """4,000 vectors in 40 clusters, with repeated ones, and some that nothing is near to."""
    chance = np.random.default_rng(3)
    centres = chance.normal(size=(40, 16)) * 3
    points = centres[chance.integers(0, 40, 4000)] + chance.normal(size=(4000, 16))
    points[100] = points[101] = points[102]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] + [1.0] * 15), (5005, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    path = storage.new_path(spark, "cells")
    vectors.stored(df, "id", "v", path, 64)
    return df, points / np.linalg.norm(points, axis=1, keepdims=True), path


def test_every_vector_is_in_the_index(spark, clustered):
    assert sorted(r.id for r in vectors.read_cells(spark, clustered[2]).select("id").collect()) == list(range(4000))


def test_recall_of_a_tenth(spark, clustered):
    """A tenth of the cells holds 0.95 of the 50 nearest, and less than a fifth of the rows is read."""
    df, points, path = clustered
    probes, found, read_rows = 6, 0, []
    for i in range(0, 4000, 400):
        best = {r.id for r in vectors.nearest(spark, path, "id", points[i].tolist(), 50, probes).collect()}
        found += len(best & set(np.argsort(-np.round(points @ points[i], 6), kind="stable")[:50].tolist()))
        order = np.argsort(-(vectors.centroids_of(spark, path) @ points[i]), kind="stable")[:probes]
        read_rows.append(vectors.read_cells(spark, path).where(f"cell in ({','.join(map(str, order))})").count())
    assert found >= 0.95 * 500 and np.mean(read_rows) < 800
    assert vectors.probes_for(spark, path, 0.95) <= 8 and vectors.probes_for(spark, path, 1.1) == 64


def test_reads_only_its_cells(spark, clustered):
    plan = vectors.nearest(spark, clustered[2], "id", clustered[1][0].tolist(), 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("block", [512, 7])
def test_each_equals_brute_force(spark, clustered, block):
    """With all cells the answer is exact, whatever the blocks; repeated vectors and ties go by key; a query isn't its own neighbour."""
    df, points, path = clustered
    asked = df.where("id % 400 = 0 or id in (100, 5000, 5003)")
    rows = vectors.nearest_of_each(spark, path, "id", asked, "v", 5, 64, block).collect()
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in rows}
    assert len(got) == len(rows) == 5 * 11
    for q in {r["query"] for r in rows}:
        scores = np.round(points @ points[q], 6)
        order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:5]
        assert [got[q, n + 1][1] for n in range(5)] == pytest.approx([scores[i] for i in order], abs=2e-6)
    assert {got[100, 1][0], got[100, 2][0]} == {101, 102}


def test_queries_recall(spark):
    """The registered queries against brute force over all vectors: 0.9 of the neighbours or more."""
    rows = {r.vec_id: r.embedding for r in read(spark, SF, "embeddings").collect()}
    names = np.array(sorted(rows))
    points = np.stack([np.array(rows[n], float) for n in names])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    exact = {r.vec_id for r in ranking.dense(read(spark, SF, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 50).collect()}
    assert len(exact & {r.vec_id for r in QUERIES["t01_cells"](spark, SF).collect()}) >= 45
    found = {(r["query"], r["vec_id"]) for r in QUERIES["t01_cells_of_each"](spark, SF).collect()}
    want = {(int(q), int(n)) for q in names[names % 50 == 0] for n in [m for m in names[np.argsort(-(points @ points[names.tolist().index(q)]), kind="stable")] if m != q][:10]}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    print(len(found & want) / len(want), vectors.probes_for(spark, cells(spark, SF), 0.95), len(vectors.centroids_of(spark, cells(spark, SF))))


def test_nothing_to_index(spark):
    with pytest.raises(ValueError):
        vectors.stored(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v", storage.new_path(spark, "cells"))


def test_vectors_meet_their_cells_in_small_pieces():
    """A vector in each of many cells makes many rows, of which a task holds a bounded number at once."""
    rng = np.random.default_rng(1)
    batch, centroids = pd.DataFrame({"id": range(100), "unit": list(rng.standard_normal((100, 4)))}), rng.standard_normal((4000, 4))
    parts = list(vectors.placed(batch, centroids, 3000))
    assert max(map(len, parts)) <= vectors.PIECE and sum(map(len, parts)) == 300_000
    assert pd.concat(parts).groupby("id").cell.nunique().eq(3000).all()
