"""Set metrics of retrieval, from rows (case, item) and never from gathered lists, so a hot case is no hot task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_metrics(expected: DataFrame, actual: DataFrame, case: str, item: str) -> DataFrame:
    """expected, actual (case, item) -> case, coverage, precision, f1; null where there is nothing to divide by."""
    rows = expected.select(case, item, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(case, item, F.lit(0).alias("e"), F.lit(1).alias("a")))
    items = rows.groupBy(case, item).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    counts = items.groupBy(case).agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum(F.col("e") * F.col("a")).alias("both"))
    zero = F.lit(0)
    return counts.select(
        case,
        F.round(F.col("both") / F.nullif("e", zero), 6).alias("coverage"),
        F.round(F.col("both") / F.nullif("a", zero), 6).alias("precision"),
        F.round(2 * F.col("both") / (F.col("e") + F.col("a")), 6).alias("f1"),
    )


def differences(before: DataFrame, after: DataFrame, metric: str, value: str) -> DataFrame:
    """Two reports (metric, value) -> metric, before, after, delta; a metric that one lacks has null there."""
    b, a = before.select(metric, F.col(value).alias("before")), after.select(metric, F.col(value).alias("after"))
    return b.join(a, metric, "full").select(metric, "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def violations(rows: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """rules: id -> (condition that must hold, severity). rule, severity and the count of rows that break it or leave it unknown."""
    broken = [F.when(~F.coalesce(F.expr(holds), F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"))) for name, (holds, level) in rules.items()]
    return rows.select(F.inline(F.array_compact(F.array(*broken)))).groupBy("rule", "severity").agg(F.count("*").alias("n"))
