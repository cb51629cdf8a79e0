"""What the operators of this subpackage share: reading tables, cutting lineage, components of a graph."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset on one machine (tests), one of our own."""
    set_one = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_one:
        return set_one.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark, "_corvane_folder"):
        spark._corvane_folder = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return spark._corvane_folder


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a table that this session wrote. Where the session has ended, the cluster's cleaning of the shared folder is left to do it."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet. What is written there goes when the session's Python process ends."""
    path = f"{shared_folder(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, and a lost executor costs no recomputation.

    The table goes when the session's Python process ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, in buckets by key, among which its rows must be dealt already: joins on the key read it where it is and move the other side only.

    The table goes when the session's Python process ends."""
    path, spark = new_path(df.sparkSession, name), df.sparkSession
    known = f"corvane_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(known)
    return spark.table(known)


def dropped(df: DataFrame) -> None:
    """Removes a table that `written` made and that no result reads any more."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rsplit("/", 1)[0])


def let(value: Column, body) -> Column:
    """body(value) with value computed once: as the variable of a lambda it isn't inlined where it's used repeatedly."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v: long) -> (node, component): the smallest node reachable from each node that has an edge.

    Alternating small-star and large-star steps: a round is two joins on aggregated minima, each written to
    the shared folder, and the rounds are logarithmic in the component's size. No group of neighbours is ever gathered:
    minima are combined map-side and a hub's rows are joined, which AQE splits. A small-star step comes first: where many
    edges run from a group's nodes to few others, it leaves about one a node. Loops and nulls in edges are ignored."""

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))

    def large_star(df: DataFrame) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined = both.where("v > u").join(least(both), F.col("u") == F.col("k"))
        return oriented(joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")))

    def small_star(df: DataFrame) -> DataFrame:
        first = least(df)
        rest = df.join(first, (F.col("u") == F.col("k")) & (F.col("v") > F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return first.select(F.col("k").alias("u"), F.col("m").alias("v")).unionByName(rest).distinct()

    given = written(oriented(edges.where("u is not null and v is not null")), "edges")
    now, seen = written(small_star(given), "edges"), None
    dropped(given)
    for _ in range(rounds):
        new = written(small_star(large_star(now)), "edges")
        dropped(now)
        now = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
