"""Patterns over edge tables: neighbourhoods, contradictions, missing data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.patterns import pairs
from corvane.operators.storage import written


def adjacency(edges: DataFrame) -> DataFrame:
    """edges (src, dst) -> the same in both directions, each once, for `neighbours`: to be written once and read at every hop."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def stored_adjacency(edges: DataFrame, path: str) -> None:
    """Writes the adjacency sorted by node: a hop that starts from few nodes reads the row groups that may hold them."""
    adjacency(edges).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.parquet(path)


def neighbours(both: DataFrame, seeds: DataFrame, hops: int, limit: int | None = None) -> DataFrame:
    """both (src, dst: an adjacency), seeds (node) -> (node, hop) within 1 to 3 undirected hops, each node at its least distance; the first `limit` by hop and node.

    What a hop has reached is written: the next one begins there, and the adjacency is read once a hop."""
    reached = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = reached
    last = max(1, min(3, hops))
    for hop in range(1, last + 1):
        step = both.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = step.join(reached, "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        front = written(front, "front") if hop < last else front
        reached = reached.unionByName(front)
    return reached if limit is None else reached.orderBy("hop", "node").limit(limit)


def contradictions(measured: DataFrame) -> DataFrame:
    """measured (claim, entity, unit, value) -> (entity, unit, claims, low, high): groups in which claims contradict one another.

    Claims on one entity and unit contradict if their values differ; a group holds its extremes, not its pairs, so a hot entity
    costs one row. `contradicting` gives each claim's own count."""
    groups = measured.where("unit <> ''").groupBy("entity", "unit").agg(F.count("*").alias("claims"), F.min("value").alias("low"), F.max("value").alias("high"))
    return groups.where("low < high")


def contradicting(measured: DataFrame) -> DataFrame:
    """measured -> (claim, entity, unit, others): how many claims of the group have another value, without listing pairs."""
    each = measured.where("unit <> ''").groupBy("entity", "unit", "value").agg(F.count("*").alias("same"))
    every = each.groupBy("entity", "unit").agg(F.sum("same").alias("every"))
    others = each.join(every, ["entity", "unit"]).select("entity", "unit", "value", (F.col("every") - F.col("same")).alias("others"))
    return measured.join(others.where("others > 0"), ["entity", "unit", "value"]).select("claim", "entity", "unit", "others")


def missing(left: DataFrame, right: DataFrame, found: DataFrame, most_pairs: int = 10_000_000) -> DataFrame:
    """Pairs of two lists, processes and materials, that no row of found holds. The lists are counted; beyond most_pairs it is refused."""
    return pairs(left, right, most_pairs).join(found, [*left.columns, *right.columns], "left_anti")


def induced(links: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """links (src, dst) -> the distinct links from a node of sources to one of targets (node). Links are made distinct before they are joined."""
    kept = links.select("src", "dst").distinct()
    kept = kept.join(sources.select(F.col("node").alias("src")), "src", "left_semi")
    return kept.join(targets.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
