"""Search in vectors by an index of cells: coarse centroids, a folder of files for each, and exact ranking of what the nearest cells hold.

The centroids come from a bounded sample; every vector is in the index, in its nearest centroid's cell. A search reads the cells nearest to its
vector and no others (partition pruning), so its cost is the share of cells probed. How many that takes for a recall is measured when the index is
made: vectors in clusters need few cells, vectors without any structure most of them. `ranking.dense` stays as the exact scan beside it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import ranking

#: Bounds of the sample that the centroids are made from, of the rounds over it, and of the centroids themselves.
SAMPLE, ROUNDS, MOST_CELLS = 50_000, 8, 4096
#: Rows that a task makes at once of vectors and their cells.
PIECE = 1 << 14
#: How many points the recall is measured with, and how many neighbours of each.
TRIALS, NEIGHBOURS = 200, 50


def unit(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit): vectors of length one, as doubles; those that are null, zero, or hold null or non-finite components are left out, as nothing is near them."""
    plain = df.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    whole = plain.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    length = whole.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return length.where("n > 0").select(key, F.transform("v", lambda x: x / F.col("n")).alias("unit"))


def sample(units: DataFrame, key: str, seed: int = 7) -> np.ndarray:
    """At most SAMPLE vectors: those of smallest hash of key and seed, so reruns agree."""
    return np.stack(units.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(SAMPLE).toPandas()["unit"].to_numpy())


def fitted(points: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of length one by Lloyd's rounds."""
    centroids = points[: min(cells, len(points))].copy()
    for _ in range(ROUNDS):
        owner = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(points, math.ceil(len(points) / 1024))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def recalls(points: np.ndarray, centroids: np.ndarray) -> list[float]:
    """For each number of probes from 1 on the share of the NEIGHBOURS nearest of TRIALS points, among all points but itself, that lie in so many nearest cells.

    Over a sample neighbours are farther than over all vectors, so what it says is rather too low."""
    owner = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(points, math.ceil(len(points) / 1024))])
    found = np.zeros(len(centroids))
    for trial in np.linspace(0, len(points) - 1, min(TRIALS, len(points))).astype(int):
        near = np.argsort(-(points @ points[trial]), kind="stable")
        place = np.empty(len(centroids), int)
        place[np.argsort(-(centroids @ points[trial]), kind="stable")] = np.arange(len(centroids))
        np.add.at(found, place[owner[near[near != trial][:NEIGHBOURS]]], 1)
    total = found.sum()
    return (found.cumsum() / total).tolist() if total else [1.0] * len(centroids)


def placed(batch: pd.DataFrame, centroids: np.ndarray, probes: int) -> Iterator[pd.DataFrame]:
    """(key, unit) -> rows with their `probes` nearest cells, at most PIECE rows at a time (or one vector's): what is in memory doesn't grow with the probes."""
    step = max(1, min(1024, PIECE // probes))
    for at in range(0, len(batch), step):
        part = batch.iloc[at : at + step]
        order = np.argsort(-(np.stack(part["unit"].to_numpy()) @ centroids.T), axis=1, kind="stable")[:, :probes]
        yield part.assign(cell=list(order.astype(np.int32))).explode("cell").astype({"cell": "int32"})


def cells_of(units: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(key, unit, cell): each vector with its `probes` nearest cells, a row each; ties by the smaller cell."""

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            yield from placed(batch, centroids, probes)

    kind = dict(units.dtypes)[key]
    return units.mapInPandas(near, f"`{key}` {kind}, unit array<double>, cell int")


def stored(df: DataFrame, key: str, vector: str, path: str, cells: int | None = None) -> None:
    """Writes the index of (key, vector) to path: files by cell, and the centroids beside them. Without `cells` there are about four times the root of the
    rows, at most MOST_CELLS. A cell that holds many vectors is many files (rows are dealt by cell and a hash of the key), so no task gets all of it."""
    spark, units = df.sparkSession, unit(df, key, vector)
    rows = units.count()
    if not rows:
        raise ValueError("an index needs a vector that isn't null, zero or non-finite")
    cells = cells or max(1, min(MOST_CELLS, rows, math.ceil(4 * math.sqrt(rows))))
    points = sample(units, key)
    centroids = fitted(points, cells)
    deal = max(1, math.ceil(rows / len(centroids) / 65_536))
    dealt = cells_of(units, key, centroids, 1).repartition("cell", F.pmod(F.xxhash64(key), F.lit(deal)))
    dealt.write.partitionBy("cell").parquet(f"{path}/cells")
    known = zip(centroids, recalls(points, centroids), strict=True)
    spark.createDataFrame([(i, c.tolist(), r) for i, (c, r) in enumerate(known)], "cell int, unit array<double>, recall double").coalesce(1).write.parquet(f"{path}/centroids")


def centroids_of(spark: SparkSession, path: str) -> np.ndarray:
    """The centroids, at most MOST_CELLS rows."""
    return np.stack([r.unit for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])


def probes_for(spark: SparkSession, path: str, recall: float) -> int:
    """The least number of cells that held this share of the neighbours when the index was made."""
    known = [r.recall for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").select("recall").collect()]
    return next((i + 1 for i, r in enumerate(known) if r >= recall), len(known))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cells")


def nearest(spark: SparkSession, path: str, key: str, query: list[float], k: int, probes: int) -> DataFrame:
    """(key, score): the k vectors of highest cosine in the `probes` cells nearest to the query; reads those cells' files only."""
    v = np.asarray(query, float)
    order = np.argsort(-(centroids_of(spark, path) @ v), kind="stable")[:probes]
    found = read_cells(spark, path).where(F.col("cell").isin([int(c) for c in order]))
    return ranking.dense(found, key, "unit", list(v), k)


def nearest_of_each(spark: SparkSession, path: str, key: str, queries: DataFrame, vector: str, k: int, probes: int, block: int = 512) -> DataFrame:
    """queries (key, vector) -> (query, key, score, rank): the k nearest of each query but itself, in its `probes` nearest cells.

    Queries meet the vectors of a cell in blocks: a hot cell's vectors and queries are dealt into as many pairs of blocks as they need, each pair
    keeps its k best for each query, and the best of those are the answer. No cell is gathered in one task, and nothing is cut before it is ranked."""
    asked = cells_of(unit(queries, key, vector), key, centroids_of(spark, path), probes).select(F.col(key).alias("query"), F.col("unit").alias("q"), "cell")
    rows = read_cells(spark, path)
    # Blocks follow from counts by cell, at most MOST_CELLS rows.
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / (block * 8)).cast("int").alias("parts"))
    crowds = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("crowds"))
    plan = sizes.join(crowds, "cell")
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    left = rows.join(F.broadcast(plan), "cell").select("cell", dealt(key, "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), key, "unit")
    right = asked.join(F.broadcast(plan), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), dealt("query", "crowds").alias("crowd"), "query", "q")
    kind, query_kind = dict(rows.dtypes)[key], dict(asked.dtypes)["query"]

    def best(points: pd.DataFrame, crowd: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(crowd):
            return pd.DataFrame({"query": [], key: [], "score": []})
        scores = np.round(np.stack(crowd["q"].to_numpy()) @ np.stack(points["unit"].to_numpy()).T, 6)
        names, out = np.array(points[key].tolist()), []
        for query, row in zip(crowd["query"], scores, strict=True):
            order = np.lexsort((names, -row))
            order = order[names[order] != query][:k]
            out.append(pd.DataFrame({"query": query, key: names[order], "score": row[order]}))
        return pd.concat(out)

    on = ["cell", "part", "crowd"]
    pairs = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(best, f"query {query_kind}, `{key}` {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc(key)))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
