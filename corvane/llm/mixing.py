"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

A source's tokens are laid out in a seeded order of its documents and cut into blocks of equally many tokens. Blocks of
the mix are seats: each goes to the source whose quotient target / (2k - 1) is highest, k counting the source's
blocks. The seat order does not depend on the number of seats, so the seats up to a shard's end, less those up to its start, are
the shard's integer quotas. Each shard then takes its quota of blocks of every source, where the shard before it stopped in the seeded
order. A source given more blocks than it has starts again from its first block, three times over at most. A document's words are
counted shard by shard.

The seats need not be listed: a source of share p holds, among the first h of m sources' seats, between
p(h - m/2) - 3/2 and p(h + m/2) + 3/2. Only the seats in that range, 4m or so in all, are ranked by quotient.

At scale: one pass over the texts for their sizes, kept as a narrow written table; running token offsets come in two steps
(buckets of a source by seeded hash, then documents of a bucket), so that a source with a third of all
rows is spread over 4096 groups. Tables of sources are the only ones that meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import WORD, written


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3) -> DataFrame:
    """sizes (source, source_size) -> (source, source_size, rank, weight, target).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops at `limit`
    times the source's size and the excess goes to the others by weight. With sources by rising limit * size / weight,
    the level is the first (all - limits before) / (weights from here on) that does not exceed the source's own ratio."""
    all_sources = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights)))
    ranked = ranked.withColumn("cap", F.lit(float(limit)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = W.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(all_sources)
    levels = ranked.withColumn("level", (total - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(all_sources)["level"]
    return levels.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "rank", "weight", "target")


def shard_quotas(targets: DataFrame, shards: int, block_tokens: int | None, most_block: int = 16, least_blocks: int = 1 << 16) -> DataFrame:
    """targets -> (shard, rank, block, first, last): of source `rank`, the stream's blocks first .. last - 1 go to `shard`.

    block_tokens: None takes as many tokens as leave least_blocks blocks in the mix, between 1 and most_block."""
    every = W.partitionBy()
    total = F.sum("target").over(every)
    block = F.lit(block_tokens) if block_tokens else F.greatest(F.lit(1), F.least(F.lit(most_block), F.floor(total / least_blocks).cast("int")))
    t = targets.where("target > 0").select("rank", "target", total.alias("all"), block.cast("long").alias("block"), F.count("*").over(every).alias("m"))
    seats = F.round(F.col("all") / F.col("block")).cast("long")
    t = t.withColumn("end", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("house", F.floor(seats * F.col("end") / shards).cast("long"))
    share = F.col("target") / F.col("all")
    low = F.greatest(F.lit(0), F.floor(share * (F.col("house") - F.col("m") / 2) - 1.5)).cast("long")
    high = (F.ceil(share * (F.col("house") + F.col("m") / 2) + 1.5) + 1).cast("long")
    t = t.withColumn("low", low)
    open_seats = F.col("house") - F.sum("low").over(W.partitionBy("end"))
    t = t.withColumn("open", open_seats)
    k = t.withColumn("k", F.explode(F.sequence(F.col("low") + 1, high)))
    best = W.partitionBy("end").orderBy(F.desc(F.col("target") / (2 * F.col("k") - 1)), "rank", "k")
    won = k.withColumn("at", F.row_number().over(best))
    quotas = won.groupBy("end", "rank", "block", "low").agg(F.count_if(F.col("at") <= F.col("open")).alias("won"))
    quotas = quotas.select("end", "rank", "block", (F.col("low") + F.col("won")).alias("last"))
    first = F.coalesce(F.lag("last").over(W.partitionBy("rank").orderBy("end")), F.lit(0))
    return quotas.select((F.col("end") - 1).alias("shard"), "rank", "block", first.alias("first"), "last")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3, shards: int = 8, block_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """docs (doc_id, source, text) -> per document: doc_id, source, size, source_size, target, taken, by_shard, start, order.

    by_shard: words that each shard takes from the document, repeats counted; taken: their sum; start: its first token in its source's
    stream; order: its place in the seeded order. A null text has size 0 and is taken 0 times; a null source is a source. Repeated rows are
    documents of their own; ties in the seeded order fall between equal rows only. An empty table gives an empty one. Other columns are not looked at."""
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary"))
    sized = written(base.withColumn("order", key).withColumn("bucket", F.substring("order", 1, 3)), "sizes")
    in_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_bucket = written(in_bucket, "buckets")
    targets = written(source_targets(in_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, limit), "targets")
    # a source's shards follow one another in its stream: one row a source, with as many ends as there are shards
    quotas = shard_quotas(targets, shards, block_tokens).groupBy("rank").agg(F.array_sort(F.collect_list(F.col("last") * F.col("block"))).alias("ends"))
    most = (F.lit(limit) * F.col("source_size")).cast("long")
    ends = F.transform(F.coalesce("ends", F.array_repeat(F.lit(0).cast("long"), shards)), lambda e: F.least(e, most))
    plan = targets.join(quotas, "rank", "left").select(F.col("source").alias("s"), "source_size", "target", ends.alias("ends"))
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = in_bucket.withColumn("before", before)
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "ends")
    within = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    rows = sized.withColumn("within", F.coalesce(within, F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("before") + F.col("within"))

    def up_to(end: Column) -> Column:
        """Words of the document in the first `end` words of the source's stream, which starts again at its end."""
        turns = F.floor(end / F.col("source_size")).cast("long")
        return F.when(F.col("source_size") > 0, turns * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), end - turns * F.col("source_size") - F.col("start")))).otherwise(0).cast("long")

    rows = rows.withColumn("sums", F.transform("ends", up_to))
    by_shard = F.transform("sums", lambda x, i: x - F.coalesce(F.get("sums", i - 1), F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.element_at("sums", -1).alias("taken"), by_shard.alias("by_shard"), "start", "order")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs -> its rows and columns as the mix takes them: each as often as its words are taken, to the nearest whole document.

    Selection runs along the seeded order, so at most one document of a source is cut; it is taken where at least half of
    it is. Documents without words are not taken. Rows that agree in doc_id, source and number of words share what the mix takes of them all,
    as evenly as whole numbers allow: the first by a hash of their columns (maps excepted) take one more."""
    taken = mix(docs, **options).where("size > 0")
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = taken.withColumn("times", times).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times"), F.count("*").alias("same")).where("times > 0")
    picked = written(taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("times").cast("int").alias("times"), "same"), "picked")
    rows = docs.select(F.struct("*").alias("row"))
    # picked grows with the documents: it is merged, never broadcast
    joined = rows.join(picked.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("d")) & F.col("row.source").eqNullSafe(F.col("s")) & (n_words(F.col("row.text")) == F.col("z")))
    order = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    place = F.row_number().over(W.partitionBy("d", "s", "z").orderBy(order)) - 1
    several = joined.where("same > 1").withColumn("place", place)
    share = F.floor(F.col("times") / F.col("same")) + (F.col("place") < F.col("times") % F.col("same")).cast("int")
    several = several.select("row", share.cast("int").alias("times")).where("times > 0")
    every = joined.where("same = 1").select("row", "times").unionByName(several)
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")).select("row.*")
