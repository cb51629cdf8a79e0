"""Sharding along a Hilbert curve over quantised metadata. DataFrame functions only.

Size, source and language of a document are quantised to eight levels each; the cell's place on the three-dimensional Hilbert
curve orders the documents, so that a run of the order covers a compact block of cells, and files cut from it have narrow
ranges in all three columns at once. Runs of equal row counts are the shards.

A document's rank is its cell's offset, plus its bucket's offset within the cell, plus its place in the bucket. Buckets are prefixes
of a digest of the document, so that a cell with a third of all rows is ranked in 256 parts, and the only rows that
meet in one task are the at most 512 cells' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import written

BITS = 3


def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve of a grid of 2 ** bits levels in each dimension."""
    x, top, n = list(cell), 1 << (bits - 1), len(cell)
    q = top
    while q > 1:  # undo the rotations and reflections of each level, the coarsest first
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for bit in reversed(range(bits)):
        for i in range(n):
            index = index << 1 | (x[i] ^ t) >> bit & 1
    return index


def levels(values: DataFrame, name: str) -> DataFrame:
    """values (name, n) of distinct values with counts -> (name, level): by code point, null first, cut at eighths of the rows."""
    order = W.orderBy(F.col(name).asc_nulls_first())
    before = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n") / 2
    return values.select(F.col(name).alias("value"), F.least(F.lit(7), F.floor(8 * before / F.sum("n").over(W.partitionBy()))).cast("int").alias("level"))


def size_level(size: Column) -> Column:
    """Powers of four from 64 bytes on."""
    return F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.log2(size) / 2) - 3)).cast("int")


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), cell.

    Shards' counts are at most one apart; slots count each shard's rows from 0. size: UTF-8 bytes plus 1, a null text having none.
    A null text's checksum is the empty text's, 0. A null source or language is a value that comes first. Rows that are equal in all that orders them may change places. With fewer rows than
    shards some shards are empty; an empty table gives an empty one. Columns lang and source are optional, others not looked at."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    has = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", has("source").alias("source"), has("lang").alias("lang"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    base = written(base, "sizes")
    by = {c: written(levels(base.groupBy(c).agg(F.count("*").alias("n")), c), c) for c in ("source", "lang")}
    for c, table in by.items():
        base = base.join(table.select(F.col("value").alias(f"{c}_value"), F.col("level").alias(f"{c}_level")), F.col(c).eqNullSafe(F.col(f"{c}_value")))
    curve = F.array(*[F.lit(hilbert_index((a, b, c), BITS)) for a in range(8) for b in range(8) for c in range(8)])
    cell = F.get(curve, F.col("source_level") * 64 + F.col("lang_level") * 8 + size_level(F.col("size")))
    mark = F.md5(F.concat_ws("|", F.col("text_crc32").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    placed = written(base.select("doc_id", "size", "text_crc32", cell.alias("cell"), mark.alias("mark")).withColumn("bucket", F.substring("mark", 1, 2)), "cells")
    buckets = placed.groupBy("cell", "bucket").agg(F.count("*").alias("n"))
    cells = buckets.groupBy("cell").agg(F.sum("n").alias("n")).select(F.col("cell").alias("c"), F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("cell_start"), F.sum("n").over(W.partitionBy()).alias("rows"))
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(F.broadcast(cells), F.col("cell") == F.col("c")).select("c", F.col("bucket").alias("b"), (F.col("cell_start") + F.col("bucket_start")).alias("start"), "rows")
    within = F.row_number().over(W.partitionBy("cell", "bucket").orderBy("text_crc32", "doc_id", "size")) - 1
    ranked = placed.withColumn("within", within).join(starts, (F.col("cell") == F.col("c")) & (F.col("bucket") == F.col("b")))
    ranked = ranked.withColumn("rank", F.col("start") + F.col("within"))
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div rows").cast("int"))
    first = F.expr(f"(shard * rows + {shards} - 1) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")
