"""Tables in the folder that driver and executors share: written once, read by every query of a session; running sums over a total order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine (tests), a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark, "_corvane_tables"):
        spark._corvane_tables = "file://" + tempfile.mkdtemp(prefix="corvane-tables-")
    return spark._corvane_tables


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as files: its lineage ends here, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, build: Callable[[str], object]) -> str:
    """The path of what build(path) writes: made at the session's first call with this name, found at every other."""
    if not hasattr(spark, "_corvane_kept"):
        spark._corvane_kept = {}
    if name not in spark._corvane_kept:
        path = new_path(spark, "kept")
        build(path)
        spark._corvane_kept[name] = path
    return spark._corvane_kept[name]


def running(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """df with running sums (long) over a total order of all rows, by no window without partitions.

    Rows are dealt by range and written, so that both passes see the same parts; each part's totals are one row, and what comes before
    a part is added to the sums within it."""
    each = df.withColumns({f"_{n}": c.cast("long") for n, c in sums.items()}).repartitionByRange(*order)
    parts = written(each.withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_part").agg(*[F.sum(f"_{n}").alias(n) for n in sums])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as the table has parts
    offsets = totals.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = parts.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in sums}).join(F.broadcast(offsets), "_part")
    return found.select(*df.columns, *[(F.col(f"_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])


def first_beyond(marks: DataFrame, asked: DataFrame) -> DataFrame:
    """marks (value, pos), asked (target, key) -> (key, pos): the least pos among the marks of the least value above the target; null where none is.

    Both are sorted together, from the largest value down, in parts by range; the last mark seen is the next above. A part's last mark serves the parts below it."""
    order = ["v", "kind", "p"]
    rows = marks.select((-F.col("value")).alias("v"), F.lit(1).alias("kind"), (-F.col("pos")).alias("p"), F.lit(None).cast("long").alias("key"))
    rows = rows.unionByName(asked.select((-F.col("target")).alias("v"), F.lit(0).alias("kind"), F.col("key").cast("long").alias("p"), F.col("key").cast("long").alias("key")))
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    mark = F.when(F.col("kind") == 1, -F.col("p"))
    ends = parts.where("kind = 1").groupBy("_part").agg(F.max_by(-F.col("p"), F.struct("v", "p")).alias("end"))
    numbers = parts.groupBy("_part").agg(F.count("*").alias("n")).join(ends, "_part", "left")  # a row a part
    above = numbers.select("_part", F.last("end", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("above"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = parts.withColumn("own", F.last(mark, ignorenulls=True).over(inside)).where("kind = 0").join(F.broadcast(above), "_part")
    return found.select("key", F.coalesce("own", "above").alias("pos"))
