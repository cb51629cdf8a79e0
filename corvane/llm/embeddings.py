"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, distributed components.

Equal vectors are one class, however many rows they have. A table keys each class by the signs of its products with `bits` random
hyperplanes; two vectors at the threshold's angle agree in a sign with probability 1 - angle / pi, which gives the number of
tables for the recall asked. Buckets hold about `fill` classes, as a matrix product makes large buckets cheap: six bits a table
serve up to 64 * fill classes, and one more bit each doubling beyond. A bucket's key and its classes' vectors are rows of
one sorted partition, which holds many buckets, so that a small bucket costs no call of its own.

Classes of a bucket are compared by one matrix product in double precision. A pair counts in the first table where it meets, so
that links are counted once without listing pairs; a bucket gives counts and a spanning forest of its links.

A bucket above `block` classes is cut into blocks, and each pair of blocks is a group of its own: nothing is dropped, and no
task holds more than two blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import connected_components, written

LEAST_BITS = 6


def plan(n: int, threshold: float, recall: float, fill: int) -> tuple[int, int]:
    """(bits a table, tables) for n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(62, max(LEAST_BITS, round(math.log2(max(n, 2) / fill))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    return bits, tables


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, tables * bits))


def vectors_by_size(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A list column -> (places of rows, their vectors as a matrix of doubles), a pair for each length; null elements become NaN."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = values.take(pa.array(at)).flatten()
        yield at, np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), size)


def unit_vectors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are finite and not zero, those rows at length 1)."""
    good = np.isfinite(vectors).all(axis=1)
    good[good] &= (vectors[good] != 0).any(axis=1)
    own = vectors[good]
    own = own / np.abs(own).max(axis=1, keepdims=True)
    return good, own / np.sqrt((own * own).sum(axis=1, keepdims=True))


def cells(matrix: np.ndarray) -> list[bytes]:
    matrix = np.ascontiguousarray(matrix)
    data, width = matrix.tobytes(), matrix.shape[1] * matrix.itemsize
    return [data[i : i + width] for i in range(0, len(data), width)]


class Forest:
    """Union by the smaller position: which of the links seen so far join two trees."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def joins(self, i: int, j: int) -> bool:
        x, y = self.find(i), self.find(j)
        if x == y:
            return False
        self.root[max(x, y)] = min(x, y)
        return True


def block_links(vectors: np.ndarray, signs: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between rows left and right (positions; left < right) that meet in no table before: how many rows each class is linked with, and a spanning forest."""
    counts = np.zeros(len(vectors), dtype=np.int64)
    forest, edges = Forest(len(vectors)), []
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        cosines = vectors[rows] @ vectors[right].T
        a, b = np.nonzero(cosines >= threshold - 1e-9)
        a, b = rows[a], right[b]
        if left is right:
            a, b = a[a < b], b[a < b]
        if table and len(a):
            fresh = ~(signs[a, :table] == signs[b, :table]).any(axis=1)
            a, b = a[fresh], b[fresh]
        exact = (vectors[a] * vectors[b]).sum(axis=1) >= threshold
        a, b = a[exact], b[exact]
        np.add.at(counts, a, weights[b])
        np.add.at(counts, b, weights[a])
        edges += [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if forest.joins(i, j)]
    return counts, edges


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches in order of the keys -> tables of whole runs of equal keys: those that end in a batch together, then the next."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        change = np.zeros(part.num_rows, dtype=bool)
        for k in keys:
            values = part[k].to_numpy()
            change[1:] |= values[1:] != values[:-1]
            if kept:
                change[0] |= kept[-1][k][-1].as_py() != values[0]
        starts = np.flatnonzero(change)
        if not len(starts):
            kept.append(part)
            continue
        if kept or starts[0]:
            head = part.slice(0, starts[-1])
            yield pa.concat_tables([*kept, head])
            kept = [part.slice(starts[-1])]
        else:
            kept = [part]
    if kept:
        yield pa.concat_tables(kept)


def near_duplicates(rows: DataFrame, threshold: float = 0.9, recall: float = 0.99, seed: int = 11, fill: int = 1024, block: int = 2048) -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, n_links, component_id, kept, a row for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. Repeated rows are vectors of their own. A null vec_id is linked, but names no component: one of nulls only has
    component null, and its rows are kept. Vectors are told apart by a 128-bit hash. Other columns, labels among them, are not looked at."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    base = rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "embedding")

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            mark, unit, dim = [None] * n, [None] * n, [None] * n
            for at, vectors in vectors_by_size(batch.column(2)):
                good, own = unit_vectors(vectors)
                for i, v, raw in zip(at[good].tolist(), cells(own), cells(vectors[good] + 0.0), strict=True):
                    mark[i], unit[i], dim[i] = xxhash.xxh3_128_digest(raw), v, len(v) // 8
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dim, pa.int32()), pa.array(mark, pa.binary()), pa.array(unit, pa.binary())], ["uid", "vec_id", "dim", "mark", "unit"])

    marked = written(base.mapInArrow(normalised, f"uid long, vec_id {kind}, dim int, mark binary, unit binary"), "vectors")
    classes = marked.where("mark is not null").groupBy("dim", "mark").agg(F.min("uid").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("rows"))
    classes = written(classes, "classes")
    n = classes.count()
    bits, tables = plan(n, threshold, recall, fill)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.float64).reshape(-1, dim)
                keys = ((vectors @ hyperplanes(int(dim), bits, tables, seed)) > 0).reshape(len(vectors), tables, bits) @ powers
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells(keys.astype(np.int64)), pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "dim", "rows", "unit", "signs", "keys"])

    one = classes.select("node", "dim", "rows").join(marked.select(F.col("uid").alias("node"), "unit"), "node")
    units = written(one.mapInArrow(signed, "node long, dim int, rows long, unit binary, signs binary, keys array<long>"), "signs")
    bucket = ["dim", "t", "sign"]
    large = units.select("dim", F.posexplode("keys").alias("t", "sign")).groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = written(large.select(*bucket, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large")
    met = units.select("node", "dim", "rows", "unit", "signs", F.posexplode("keys").alias("t", "sign")).join(large, bucket, "left")
    met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own"))))
    groups = met.select("node", "dim", "rows", "unit", "signs", "t", "sign", "own", "blocks", F.explode(pairs).alias("pair"))
    groups = groups.repartition(*bucket, "pair").sortWithinPartitions(*bucket, "pair")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, [*bucket, "pair"]):
            dims, ts, signs_of, pair, blocks = (part[c].to_numpy() for c in ("dim", "t", "sign", "pair", "blocks"))
            change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(ts) != 0) | (np.diff(signs_of) != 0) | (np.diff(pair) != 0)) + 1
            bounds = [0, *change.tolist(), len(dims)]
            nodes, own, weights = part["node"].to_numpy(), part["own"].to_numpy(), part["rows"].to_numpy()
            unit, signs = part["unit"].to_pylist(), part["signs"].to_pylist()
            u, v, counted = [], [], []
            for i, j in zip(bounds, bounds[1:], strict=False):
                if j - i < 2:
                    continue
                vectors = np.frombuffer(b"".join(unit[i:j]), dtype=np.float64).reshape(j - i, -1)
                keys = np.frombuffer(b"".join(signs[i:j]), dtype=np.int64).reshape(j - i, -1)
                a, b = divmod(int(pair[i]), int(blocks[i]))
                left = np.flatnonzero(own[i:j] == a)
                right = left if a == b else np.flatnonzero(own[i:j] == b)
                counts, edges = block_links(vectors, keys, int(ts[i]), left, right, weights[i:j], threshold)
                ids = nodes[i:j]
                some = np.flatnonzero(counts)
                u += ids[some].tolist()
                v += [None] * len(some)
                counted += counts[some].tolist()
                u += [int(ids[x]) for x, _ in edges]
                v += [int(ids[y]) for _, y in edges]
                counted += [0] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(counted, pa.int64())], ["u", "v", "n"])

    found = written(groups.mapInArrow(linked, "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("v is not null").select("u", "v"))
    named = classes.join(counts, F.col("node") == F.col("u"), "left").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    named = written(named.select("dim", "mark", "least", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("dim").alias("d"), F.col("mark").alias("m"), "n_links", "component_id")
    joined = marked.join(named, (F.col("dim") == F.col("d")) & (F.col("mark") == F.col("m")), "left")
    component = F.when(F.col("mark").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))
