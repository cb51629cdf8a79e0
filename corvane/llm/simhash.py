"""SimHash near-duplicates: fingerprints, shards of fingerprints held as BK-trees, components of the links.

Every fingerprint class (equal fingerprints; a class is one row however many copies it has) goes to several shards so that
any two within the radius meet in one, and shards of a single class end in the JVM. A task turns a shard into a
BK-tree, whose children are keyed by their Hamming distance to the parent, and looks each fingerprint up in it, following
only edges within the radius of its own distance. A shard yields a link for each class it joins to a group, never all pairs.

The trees aren't broadcast: all of them together grow with the corpus. Each shard's tree travels as the shard's row instead.

Exact shards (`exact_links`): 64 bits in `blocks` blocks; two fingerprints that differ in at most r bits agree in all
blocks but r, so a shard is one choice of the blocks that agree with their value. With 10 blocks and r = 2 a class has 45
keys, and a shard at most 2 ** 14 classes whatever the corpus: no key is ever hot.

Weak-bit shards (`weak_shards`), for radii that no choice of blocks can serve: a bit differs between near-duplicates when its vote
was close. Each block of a 384-bit fingerprint is keyed with every setting of its `weak` bits of closest vote, on both sides. `plan`
takes blocks as wide as the number of documents asks, so that keys stay selective, and the weak bits and the radius that give the recall
asked at the similarity asked. Keys and classes are sorted once, 16 bytes a row, and only classes that share a key go on. A class has a key
once, so no key holds more than one in some 200 of all rows. One with more than `block` classes is cut into blocks, and each pair of blocks
is a shard. No pair is lost and no shard is larger than about two blocks, but the pairs of a key of n classes are still compared, in n /
block as many rows. Links are then verified on the documents' whole shingle sets (`verified`): first the closest link of each class, then those
links whose ends are not connected yet, so that a large group costs a few sets a class and not its pairs. What keys or radius miss is found
by an exact pass (`unmet`) over the rarest shingles of each set, whose pairs are only those of classes in different groups: no link is lost.
Its pairs meet on parity sketches first (`possible`), a bit or two a shingle, which prove most of them too different: only what is left moves sets.

Tables that grow with the documents are merged, never broadcast, whatever their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import bucketed, connected_components, dropped, written

CHUNK = 1 << 15
#: Bits of the fingerprints that weak-bit shards compare.
WIDE = 384
#: Documents whose shingle sets are in one bucket, some 30 MB at five hundred words each.
BUCKET = 8192
#: Bytes of shingle sets that a task's Python holds before it hands them on.
HELD = 1 << 21


def shingles(text: str, words: int) -> Iterator[list[bytes]]:
    """The text's shingles, CHUNK at a time: lower-cased words joined by spaces; the whole sequence where it is shorter."""
    tokens = text.encode("utf-8").lower().split()  # on bytes: A-Z only, ASCII white space only
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for at in range(0, len(starts), CHUNK):
        yield [joined[s:e] for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)]


def shingle_votes(text: str, words: int) -> tuple[np.ndarray, int]:
    """Per bit of 64, in how many shingles' XXH64 (seed 42) it is set; and the number of shingles."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for parts in shingles(text, words):
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(p, 42) for p in parts]), dtype=np.uint8)
        votes += bit_counts(hashes.reshape(-1, 8))
        n += len(parts)
    return votes, n


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """hashes (rows of bytes) -> per bit, in how many rows it is set: 128 rows at a time in single bytes."""
    bits = np.unpackbits(hashes, axis=1)
    whole = len(bits) // 128 * 128
    sums = bits[:whole].reshape(-1, 128, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[whole:].sum(axis=0, dtype=np.int64)


def wide_votes(text: str, words: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Per bit of WIDE, in how many shingles' hashes it is set; the number of shingles; and the set of shingles, as sorted 64-bit hashes."""
    votes, n, seen = np.zeros(WIDE, dtype=np.int64), 0, []
    digest, lanes = xxhash.xxh3_128_digest, range(42, 42 + WIDE // 128)
    for parts in shingles(text, words):
        hashes = np.frombuffer(b"".join([digest(p, lane) for p in parts for lane in lanes]), dtype=np.uint8).reshape(-1, WIDE // 8)
        votes += bit_counts(hashes)
        seen.append(np.ascontiguousarray(hashes[:, :8]).view(np.int64).ravel())
        n += len(parts)
    return votes, n, np.unique(np.concatenate(seen)) if seen else np.zeros(0, dtype=np.int64)


def parities(seen: np.ndarray) -> list[int]:
    """A set's parity sketch as 64-bit words: of each value of the hashes' lowest bits, whether an odd number has it; a power of two of bits, one a shingle at least.

    A shingle that only one of two sets has flips one bit, so sketches differ in no more bits than the sets in shingles. Halves that are combined by XOR make the sketch of half the bits."""
    bits = max(64, 1 << max(0, len(seen) - 1).bit_length())
    odd = np.bincount(seen & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def fingerprint(votes: np.ndarray, n: int) -> int:
    """The 64-bit fingerprint as a signed number, most significant bit first; a bit is set if over half the shingles set it."""
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def blocks_of(votes: np.ndarray, n: int, width: int) -> list[int]:
    """The values of the fingerprint's blocks of `width` bits; bits beyond the last whole block have none."""
    bits = (2 * votes > n)[: WIDE // width * width].reshape(-1, width)
    return (bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))).tolist()


def weak_bits(votes: np.ndarray, n: int, width: int, weak: int) -> list[int]:
    """Of each block, the places (from its lowest bit) of the `weak` bits whose votes were closest."""
    margin = np.abs(2 * votes - n)[: WIDE // width * width].reshape(-1, width)
    return (width - 1 - np.argsort(margin, axis=1, kind="stable")[:, :weak]).ravel().tolist()


def plan(n: int, similarity: float, recall: float, trials: int = 4000) -> tuple[int, int, int]:
    """(width of a block, weak bits in each, radius) for n documents: what finds the share `recall` of pairs whose shingle sets have this similarity.

    Sets of Jaccard similarity s have cosine c = 2s / (1 + s); two votes are normal with that correlation, and differ in sign with probability
    acos(c) / pi. Half of what may be lost is left to the radius, half to the keys, whose share is measured on simulated votes."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(min(1.0, cosine)) / math.pi
    lost = (1 - recall) / 2
    radius = math.ceil(WIDE * p + NormalDist().inv_cdf(1 - lost) * math.sqrt(WIDE * p * (1 - p)))
    width = min(32, max(28, math.ceil(math.log2(max(n, 2))) + 10))
    rng = np.random.default_rng(5)
    size = (trials, WIDE // width, width)
    x = rng.standard_normal(size, dtype=np.float32)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * rng.standard_normal(size, dtype=np.float32)
    differ, near = (x > 0) != (y > 0), [np.argsort(np.argsort(np.abs(v), axis=2), axis=2) for v in (x, y)]
    for weak in range(1, 8):
        met = ~(differ & (near[0] >= weak) & (near[1] >= weak)).any(axis=2)
        if met.any(axis=1).mean() >= 1 - lost:
            break
    return width, weak, radius


def fingerprints(text: Column, words: int) -> Column:
    """The 64-bit fingerprint of each text as a long. Without words: 0. Null counts as the empty text."""

    @F.pandas_udf("long")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(*shingle_votes(t, words)) for t in batch], dtype="int64")

    return marked(F.coalesce(F.make_valid_utf8(text), F.lit("")))


class Tree:
    """A BK-tree over integers: a node's children are keyed by their Hamming distance to it."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at = 0
            while (d := (values[at] ^ values[i]).bit_count()) in self.children[at]:
                at = self.children[at][d]
            self.children[at][d] = i

    def near(self, value: int, radius: int) -> Iterator[int]:
        todo, values, children = [0], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            own = children[at]
            if len(own) <= 2 * radius:
                todo += [c for edge, c in own.items() if abs(edge - d) <= radius]
            else:
                todo += [own[edge] for edge in range(d - radius, d + radius + 1) if edge in own]


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(position, first position it is connected to over links within the radius) of all but the firsts: stars, found in the values' BK-tree.

    Stars of the same group in different shards share most of their links, which trees would not."""
    tree, root = Tree(values), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            if j < i and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    for i in range(len(values)):
        if (first := find(i)) != i:
            yield i, first


def nearest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links (position, earlier position) within the radius, found in the values' BK-tree: from each value to the closest one of each group it joins."""
    tree, root = Tree(values), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        best: dict[int, tuple[int, int]] = {}
        for j in tree.near(value, radius):
            if j < i:
                group, own = find(j), ((values[j] ^ value).bit_count(), j)
                best[group] = min(own, best.get(group, own))
        for group, (_, j) in best.items():
            a, b = find(i), find(group)
            root[max(a, b)] = min(a, b)
            yield i, j


def shard_links(shards: DataFrame, radius: int, among=forest) -> DataFrame:
    """shards (members: array of struct(rep, fp)) -> links (u, v, d) between representatives, d their distance. fp: a long, or the bytes of a wide fingerprint."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            d: list[int] = []
            for shard in batch.column(0):
                members = sorted((m["rep"], m["fp"]) for m in shard.as_py())
                values = [fp & 0xFFFFFFFFFFFFFFFF if isinstance(fp, int) else int.from_bytes(fp, "big") for _, fp in members]
                for i, j in among(values, radius):
                    u.append(members[i][0])
                    v.append(members[j][0])
                    d.append((values[i] ^ values[j]).bit_count())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.int32())], ["u", "v", "d"])

    return shards.select("members").mapInArrow(linked, "u long, v long, d int").distinct()


def dealt(classes: DataFrame, keys: int, rows: int = 1 << 19) -> DataFrame:
    """classes, a written table, over as many partitions as leave each about so many rows when every class gets its keys."""
    return classes.repartition(max(1, math.ceil(classes.count() * keys / rows), classes.sparkSession.sparkContext.defaultParallelism))


def exact_links(classes: DataFrame, radius: int = 2, blocks: int = 10) -> DataFrame:
    """classes (fp: long, rep: long, fp distinct) -> links (u, v) of representatives that connect all within the radius."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for gone in combinations(range(blocks), radius):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in range(blocks) if b not in gone)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m, i: F.struct(i.cast("byte").alias("no"), m.bitwiseAND(F.col("fp")).alias("bits")))
    spread = dealt(classes, len(masks)).select(F.explode(keys).alias("key"), F.struct("rep", "fp").alias("member"))
    shards = spread.groupBy("key.no", "key.bits").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    return shard_links(shards, radius)


def components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    A text without words, null or empty, has fingerprint zero, linked like any other. Repeated rows are
    documents of their own. A null doc_id takes part in links but names no component (one of nulls only has id null). Other
    columns are not looked at. An empty table gives an empty one."""
    marked = written(docs.select("doc_id", fingerprints(F.col("text"), words).alias("fp")), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected_components(exact_links(classes.where("rep is not null"), radius))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("class"), F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, F.col("fp") == F.col("class")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.9, block: int = 1024) -> DataFrame:
    """docs (doc_id, text) -> doc_id, group_id: the smallest doc_id of the documents linked by shingle sets of at least this similarity.

    A row for each row. Texts of equal shingle sets are one class. Most links are candidates by wide SimHash, found with the planned recall, and verified
    on the shingle sets; `unmet` finds every other link between the groups that these make. Texts without words are alike. A null doc_id is linked, but names no group: one of nulls only has id null."""
    rows = docs.count()
    width, weak, radius = plan(rows, similarity, recall)

    columns = ["fp", "own", "blocks", "weak", "size", "sketch", "shingles"]

    @F.pandas_udf("struct<fp: binary, own: binary, blocks: array<long>, weak: array<int>, size: int, sketch: array<long>, shingles: binary>")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for text in batch:
                if size >= HELD:  # sets go back to the JVM in parts
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
                votes, n, seen = wide_votes(text, words)
                held = seen.tobytes()
                size += len(held)
                rows.append((np.packbits(2 * votes > n).tobytes(), xxhash.xxh3_128_digest(held), blocks_of(votes, n, width), weak_bits(votes, n, width, weak), len(seen), parities(seen), held))
            yield pd.DataFrame(rows, columns=columns)

    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.make_valid_utf8("text"), F.lit("")).alias("text"))
    buckets = max(1, math.ceil(rows / BUCKET), docs.sparkSession.sparkContext.defaultParallelism)
    dealt_out = texts.repartition(buckets, "uid")  # texts, which are packed, and not the sets of their shingles, which can't be
    found = bucketed(dealt_out.select("uid", "doc_id", marked("text").alias("m")).select("uid", "doc_id", "m.*"), "fingerprints", "uid", buckets)
    named = found.groupBy("own").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least"))
    classes = written(named.join(found.select(F.col("uid").alias("rep"), "fp", "blocks", "weak").hint("merge"), "rep"), "classes")
    met = written(shared_keys(classes, weak, width), "keys")
    candidates = written(shard_links(weak_shards(classes, met, block), radius, nearest), "candidates")
    closest = candidates.groupBy("u").agg(F.min(F.struct("d", "v")).alias("c")).select("u", "c.v")
    first = written(verified(closest, found, similarity), "verified")
    roots = written(connected_components(first), "roots")
    others = candidates.select("u", "v").join(closest.hint("merge"), ["u", "v"], "left_anti")
    for end in ("u", "v"):
        others = others.join(roots.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root")).hint("merge"), end, "left")
    others = written(others.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"), "others")
    second = written(verified(others, found, similarity), "verified")
    for table in (met, candidates, others, roots):
        dropped(table)
    roots = connected_components(first.unionByName(second))
    placed = written(classes.select("rep").join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component")), "placed")
    pairs = unmet(placed, found, similarity)
    left_over = written(possible(pairs, found, similarity), "possible")
    dropped(pairs)
    third = written(verified(left_over, found, similarity), "verified")
    roots = connected_components(first.unionByName(second).unionByName(third))
    grouped = classes.select("own", "rep", "least").join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").select("own", "least", F.coalesce("component", "rep").alias("group"))
    grouped = written(grouped, "named")
    least = grouped.groupBy("group").agg(F.min("least").alias("group_id"))
    named = grouped.join(least.hint("merge"), "group").select("own", "group_id")
    groups = written(found.select("doc_id", "own").join(named.hint("merge"), "own").select("doc_id", "group_id"), "groups")
    for table in (found, classes, first, second, placed, left_over, third, grouped):
        dropped(table)
    return groups


def frequent(found: DataFrame, documents: int = 10_000, most: int = 1 << 17) -> np.ndarray:
    """Shingles that several of about so many documents hold, the rarest first. They only order the shingles of a set: whichever are listed, no link is lost."""
    share = min(1.0, documents / max(1, found.count()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(held.as_buffer(), dtype=np.int64))], ["key"])

    some = found.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < round(share * (1 << 20))).select("shingles")
    counts = some.mapInArrow(each, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    return np.array([r.key for r in counts.orderBy(F.desc("n"), "key").limit(most).collect()][::-1], dtype=np.int64)  # 1 MB at most


def unmet(placed: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """placed (rep, component), found (uid, shingles) -> candidates (u, v) of different components: every pair of at least this similarity is among them.

    Two sets of n shingles or more in common order, similar enough, share one of their first n - similarity * n + 1 (prefix filtering): the order is from rare to
    frequent. Pairs whose sizes, or what is left of them after the shared shingle, are too small for the similarity go before they are written."""
    listed = frequent(found)
    order = np.argsort(listed)
    known = listed[order]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):  # what is handed on takes as much again
            keys, sizes = [], []
            for held in batch.column(2):
                own = np.frombuffer(held.as_buffer(), dtype=np.int64)
                sizes.append(len(own))
                first = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, order[at] + 1, 0)
                    own = own[np.argsort(rank, kind="stable")]
                keys.append(own[:first])
            lengths = np.array([len(k) for k in keys], dtype=np.int64)
            rows = np.repeat(np.arange(len(keys)), lengths)
            places = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), *[batch.column(i).to_numpy()[rows] for i in (0, 1)], np.array(sizes, dtype=np.int32)[rows], places.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rep", "component", "n", "place"])

    sets = placed.join(found.select(F.col("uid").alias("rep"), "shingles").hint("merge"), "rep").select("rep", "component", "shingles")
    spread = sets.mapInArrow(prefixes, "key long, rep long, component long, n int, place int")
    every = W.partitionBy("key")
    met = spread.withColumns({"low": F.min("component").over(every), "high": F.max("component").over(every)}).where("low < high").drop("low", "high")
    met = written(met, "met")
    side = lambda end: met.select("key", *[F.col(c).alias(f"{end}_{c}") for c in ("rep", "component", "n", "place")])
    left = lambda end: F.col(f"{end}_n") - F.col(f"{end}_place")
    enough = F.least(left("u"), left("v")) >= (F.col("u_n") + F.col("v_n")) * similarity / (1 + similarity) - 1e-6
    both = side("u").hint("merge").join(side("v"), "key").where((F.col("u_rep") > F.col("v_rep")) & (F.col("u_component") != F.col("v_component")) & enough)
    pairs = written(both.select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v")).distinct(), "unmet")
    dropped(met)
    return pairs


def possible(links: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """links (u, v) of found (uid, size, sketch: `parities`; in buckets by uid) -> those whose sets may have this Jaccard similarity: none that has it goes.

    Sets of a and b shingles are similar enough only if no more than (a + b) (1 - s) / (1 + s) shingles are in one of them only."""
    sketches = lambda end: found.select(F.col("uid").alias(end), F.col("size").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_s")).hint("merge")
    both = links.join(sketches("u"), "u").join(sketches("v"), "v")
    xor = lambda a, b: a.bitwiseXOR(b)
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, 1, half(x)), F.slice(x, half(x) + 1, half(x)), xor)
    fit = lambda x, y: F.when(F.size(x) > F.size(y), folded(x)).otherwise(x)
    u, v = F.col("u_s"), F.col("v_s")
    differ = F.aggregate(F.zip_with(fit(u, v), fit(v, u), xor), F.lit(0), lambda n, x: n + F.bit_count(x))  # null if one is over twice as long
    most = (F.col("u_n") + F.col("v_n")) * (1 - similarity) / (1 + similarity) + 1e-6
    return both.where(F.coalesce(differ <= most, F.lit(True))).select("u", "v")


def verified(links: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """links (u, v) of found (uid, shingles: sorted 64-bit hashes as bytes; in buckets by uid) -> those whose sets have at least this Jaccard similarity.

    Links go to the sets: only those of a link's first end are moved, to the buckets of its second."""
    sets = lambda end, name: found.select(F.col("uid").alias(end), F.col("shingles").alias(name)).hint("merge")
    both = links.join(sets("u", "a"), "u").join(sets("v", "b"), "v")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (a, b))
                at = np.searchsorted(b, a)
                shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
                every = len(a) + len(b) - shared
                good.append(shared >= similarity * every - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(compared, "u long, v long")


def block_keys(weak: int, width: int) -> Column:
    """Of blocks and weak: the keys of every block under every setting of its weak bits."""

    def keys(value: Column, no: Column) -> Column:
        bits = F.transform(F.slice("weak", no * weak + 1, weak), lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at))
        base = F.aggregate(bits, value, lambda v, bit: v.bitwiseAND(F.bitwise_not(bit)))
        settings = F.aggregate(bits, F.array(base), lambda out, bit: F.concat(out, F.transform(out, lambda v: v.bitwiseOR(bit))))
        return F.transform(settings, lambda v: v.bitwiseOR(F.call_function("shiftleft", no.cast("long"), F.lit(width))))

    return F.flatten(F.transform("blocks", keys))


def shared_keys(classes: DataFrame, weak: int, width: int) -> DataFrame:
    """classes (rep, blocks, weak) -> (key, rep) of the keys that more than one class has: one shuffle, sorted, read as a stream."""
    met = dealt(classes, WIDE // width << weak).select(F.explode(block_keys(weak, width)).alias("key"), "rep")
    partitions = max(1, math.ceil(classes.count() * (WIDE // width << weak) / (1 << 20)), classes.sparkSession.sparkContext.defaultParallelism)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met_before = None, False  # the row held back, and whether the one before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, reps = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                keys, reps = np.concatenate(([last[0]], keys)), np.concatenate(([last[1]], reps))
            same, good = keys[1:] == keys[:-1], np.zeros(len(keys), dtype=bool)
            good[1:] |= same
            good[:-1] |= same
            good[0] |= met_before
            last, met_before = (keys[-1], reps[-1]), bool(good[-1])
            out = np.flatnonzero(good[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(reps[out])], ["key", "rep"])
        if met_before:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["key", "rep"])

    return met.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(several, "key long, rep long")


def weak_shards(classes: DataFrame, met: DataFrame, block: int) -> DataFrame:
    """classes (rep, fp), met (key, rep) -> (key, pair, members: array of struct(rep, fp)): any two classes of a key meet in a shard.

    Only keys with more than `block` classes are joined with their number of blocks; a class goes to the shards of its block and each other."""
    large = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("large"), F.ceil(F.col("n") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: o != own)
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own)))
    placed = met.join(large, F.col("key") == F.col("large"), "left").select("rep", "key", F.explode(pairs).alias("pair"))
    members = placed.join(classes.select("rep", "fp").hint("merge"), "rep")
    return members.groupBy("key", "pair").agg(F.collect_list(F.struct("rep", "fp")).alias("members"))


def near_deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs' rows and columns without near-duplicates: of each group the document of the smallest doc_id stays, once.

    Rows of equal doc_id count as one document, which stays if one of them does; of these rows the first by a hash of their columns
    (maps excepted) stays. Documents whose doc_id is null all stay."""
    groups = near_duplicate_groups(docs, **options)
    by_id = groups.where("doc_id is not null").groupBy("doc_id")
    judged = by_id.agg(F.bool_or(F.col("doc_id") == F.col("group_id")).alias("stays"), F.count("*").alias("same"))
    special = written(judged.where("not stays or same > 1").select(F.col("doc_id").alias("id"), "stays"), "special")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(special.hint("merge"), F.col("row.doc_id") == F.col("id"), "left")
    order = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = joined.where("stays").groupBy("id").agg(F.min_by("row", order).alias("row")).select("row")
    return joined.where("id is null").select("row").unionByName(one).select("row.*")
