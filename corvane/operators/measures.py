"""Aggregates over claims and measurements, and evaluation metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_dimension(measured: DataFrame, key: Column, value: str) -> DataFrame:
    return measured.groupBy(F.coalesce(key, F.lit("default")).alias("dimension")).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def compared(measured: DataFrame, key: str, value: str, a: str, b: str) -> DataFrame:
    mean = lambda k: F.avg(F.when(F.col(key) == k, F.col(value)))
    return measured.agg(F.round(mean(a), 6).alias("mean_a"), F.round(mean(b), 6).alias("mean_b"), F.round(mean(b) - mean(a), 6).alias("delta"))


def nearest_rank(df: DataFrame, value: str, share: float, buckets: int = 1024) -> DataFrame:
    """The value at index round((n - 1) * share), half to even, of the sorted values; no row where there are none.

    No sort and no single task for all values: the range is cut into buckets, whose counts say which of them holds the place, and
    that one is cut again, until it has one value. A round is a scan with at most `buckets` rows for the driver; a few do. Nulls, NaN and
    infinities are left out."""
    rows = df.select(F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    n, low, high = rows.agg(F.count("*"), F.min("value"), F.max("value")).first()
    place = round((n - 1) * share)
    while n and low < high:
        width = (high - low) / buckets
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("value") - low) / width)).cast("int") if width > 0 else (F.col("value") > low).cast("int")
        found = rows.where(F.col("value").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        for row in sorted(found.collect(), key=lambda r: r.b):
            if place < row.n:
                low, high = row.low, row.high
                break
            place -= row.n
    return df.sparkSession.createDataFrame([(low,)] if n else [], "value double")


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets, as a metrics endpoint shows them."""
    row = df.agg(*[F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds)], F.count(value).alias("all"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return row.select(F.inline(pairs))
