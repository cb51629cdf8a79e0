"""Channels of a hybrid search and reranking; `retrieval.fused` joins them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import token_share


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of highest score, ties by key: a TakeOrderedAndProject."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def dense(points: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    score = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6)
    return top(points.select(key, score.alias("score")), "score", key, k)


def lexical(spans: DataFrame, key: str, text: str, query: list[str], k: int) -> DataFrame:
    scored = spans.select(key, F.round(token_share(F.col(text), query), 6).alias("score")).where("score > 0")
    return top(scored, "score", key, k)


def reranked(df: DataFrame, key: str, k: int) -> DataFrame:
    """df (key, overlap, constraint, base) -> its best k by min(1, .45 overlap + .35 constraint + .2 base), with rank."""
    score = F.round(F.least(F.lit(1.0), 0.45 * F.col("overlap") + 0.35 * F.col("constraint") + 0.2 * F.col("base")), 6)
    best = top(df.select(key, score.alias("score")), "score", key, k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc(key))))
