"""LM scoring by context-tree weighting over bytes, beside a smoothed unigram base.

Counting (`gram_counts`): one pass counts words and byte grams (the byte and the DEPTH bytes before it), combined in the worker over `HELD` rows
at most and then map-side. Texts are taken in parts of `PART` bytes, so a worker's memory does not follow its batches. Every
context of 0 to DEPTH bytes is a node of the tree. Grams of documents that don't train are in the table too, with 0 for
training, so a table of all grams serves every document. Each next byte is decomposed into eight binary decisions. At every node and
decision the Krichevsky-Trofimov estimate of the node is weighted half and half with the product of its children's weighted
probabilities, which mixes all depths. Counts are frozen when scoring: the tree gives each decision one probability
in each context, and a gram one log probability.

Weighting (`gram_logs`): a gram's key begins with the nearest byte, so sorted keys list the tree in depth-first order. Tasks take whole
subtrees of the two nearest bytes. A first pass over them sums up what the nodes of no and one byte need, 256 * 255 rows at most whatever
the corpus and all that reaches the driver; a second one carries the weights down and gives each gram its log probability. A subtree
is held whole: 2 ** 24 grams at the very most, in texts well below a million.

Scoring (`scored`): words and grams are not bounded, so only the `frequent` most frequent words and the grams of the highest counts (at
most `frequent_grams`, 16 bytes each) are broadcast; the rest of each document's words and grams are joined by key,
each document's equal ones as one row. Frequent is what all documents have most often, so that no hot word or gram is joined. They are
held as sorted arrays and looked up by binary search, a part's words and grams at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written

DEPTH = 4
#: Bytes of text that are turned into grams at a time.
PART = 1 << 19
#: Words, and grams, that a worker counts before it gives them on.
HELD = 1 << 20
#: Grams, in whole subtrees, that are weighted at a time.
CHUNK = 1 << 17


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, words joined by spaces and ended by a line end, each text after DEPTH line ends as context; and where each starts."""
    pad = b"\n" * DEPTH
    parts = [pad + b" ".join(words) + b"\n" for words in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def own_places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the texts' own bytes, without the context before each."""
    own = np.ones(len(data), dtype=bool)
    for i in range(DEPTH):
        own[starts[:-1] + i] = False
    return np.flatnonzero(own)


def parts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[bytes]]]]:
    """Rows of the batches in parts of about PART bytes, with their tokens."""
    for batch in batches:
        rows, texts, size = [], [], 0
        values = batch.column(column)
        for i in range(batch.num_rows):
            text = values[i].as_py() or b""
            rows.append(i)
            texts.append(tokens(text))
            size += len(text) + 1
            if size >= PART:
                yield batch, rows, texts
                rows, texts, size = [], [], 0
        if rows:
            yield batch, rows, texts


def word_key(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(word), "big", signed=True)


def gram_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gram at each place: the byte before it first, then the ones further back, then the byte itself."""
    keys = np.zeros(len(at), dtype=np.int64)
    for back in (*range(1, DEPTH + 1), 0):
        keys = keys << 8 | data[at - back]
    return keys


class Tally:
    """Counts by 64-bit key, two a key, in sorted arrays that are merged when they have doubled."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.merged = 0

    def add(self, keys: np.ndarray, n: np.ndarray, every: np.ndarray) -> None:
        self.parts.append((keys, n, every))
        self.size += len(keys)
        if self.size > max(HELD // 2, 2 * self.merged):
            self.merge()

    def merge(self) -> None:
        keys, n, every = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[first], np.add.reduceat(n[order], first), np.add.reduceat(every[order], first))]
        self.size = self.merged = len(first)

    def taken(self, gram: bool) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            keys, n, every = self.parts[0]
            for i in range(0, len(keys), 1 << 16):
                j = i + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[i:j]), gram)), pa.array(keys[i:j]), pa.array(n[i:j]), pa.array(every[i:j])], ["gram", "key", "n", "every"])
        self.__init__()


def counted_grams(texts: list[list[bytes]], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of the texts, in order: key, how often in texts that are not held out, and in all."""
    data, starts = coded(texts)
    marked = gram_keys(data, own_places(data, starts))
    marked <<= 1
    marked |= np.repeat(held, np.diff(starts) - DEPTH)
    marked, every = np.unique(marked, return_counts=True)
    return marked >> 1, np.where(marked & 1, 0, every), every


def counted_words(texts: list[list[bytes]], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts: hash, how often in texts that are not held out, and in all."""
    every, own = Counter(), Counter()
    for words, out in zip(texts, held.tolist(), strict=True):
        every.update(words)
        if not out:
            own.update(words)
    n = len(every)
    return tuple(np.fromiter(x, dtype=np.int64, count=n) for x in (map(word_key, every), (own[w] for w in every), every.values()))


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs (held_out: boolean, text: binary) -> (gram: boolean, key: long, n, every): all words by 64-bit hash, and all
    grams of DEPTH + 1 bytes. n counts training documents only, every all of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {False: Tally(), True: Tally()}
        for batch, rows, texts in parts_of(batches, 1):
            held = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
            for gram, tally in tallies.items():
                tally.add(*(counted_grams if gram else counted_words)(texts, held))
                if tally.size > HELD:
                    yield from tally.taken(gram)
        for gram, tally in tallies.items():
            yield from tally.taken(gram)

    rows = docs.mapInArrow(counted, "gram boolean, key long, n long, every long")
    return rows.groupBy("gram", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series, seven places up."""
    shift = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5) * (x + 6))
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log probability that Krichevsky-Trofimov estimation gives a sequence of n0 zeros and n1 ones."""
    out = np.zeros(n0.shape)
    seen = (n0 + n1) > 0
    a, b = n0[seen], n1[seen]
    out[seen] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
    return out


def decided(counts: np.ndarray, depth: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """counts (contexts x decisions x 2) -> probability of a one in each context at each decision; decisions are trees of their own."""
    kids = np.zeros_like(counts)
    np.add.at(kids, parent[1:], counts[1:])
    rows = [np.flatnonzero(depth == d) for d in range(DEPTH + 1)]
    n0, n1 = counts[..., 0], counts[..., 1]
    rest0, rest1 = n0 - kids[..., 0], n1 - kids[..., 1]
    own, longer = log_kt(n0, n1), log_kt(rest0, rest1)
    whole = own.copy()
    for d in range(DEPTH, -1, -1):
        r = rows[d]
        if d < DEPTH:
            whole[r] = np.logaddexp(own[r], longer[r]) - np.log(2)
        if d:
            np.add.at(longer, parent[r], whole[r])
    weight = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
    mine, others = (n1 + 0.5) / (n0 + n1 + 1), (rest1 + 0.5) / (rest0 + rest1 + 1)
    before, share, one = np.zeros_like(own), np.ones_like(own), np.empty_like(own)
    for d, r in enumerate(rows):
        if d:
            p = parent[r]
            before[r] = before[p] + share[p] * weight[p] * mine[p]
            share[r] = share[p] * (1 - weight[p])
        one[r] = before[r] + share[r] * (mine[r] if d == DEPTH else weight[r] * mine[r] + (1 - weight[r]) * others[r])
    return one


def weighted(counts: np.ndarray, depth: np.ndarray, parent: np.ndarray, at_once: int = 8) -> np.ndarray:
    """counts (contexts x 256), each context's depth and its parent's row (the root's: 0) -> log10 probabilities of the same shape.

    The tree in memory, against which tests hold `gram_logs`; contexts that are left out are pooled. Row 0 is the root. Decisions are taken `at_once` at a time, which bounds the memory."""
    m = len(counts)
    table = np.zeros((m, 256), dtype=np.float32)
    for level in range(8):
        width = 256 >> level
        for first in range(0, 1 << level, at_once):
            part = slice(first * width, min(first + at_once, 1 << level) * width)
            one = decided(counts[:, part].reshape(m, -1, 2, width // 2).sum(axis=3), depth, parent)
            logs = np.log10(np.stack((1 - one, one), axis=2)).reshape(m, -1)
            table[:, part] += np.repeat(logs, width // 2, axis=1).astype(np.float32)
    return table


def mixture(n0: np.ndarray, n1: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes with these counts and their children's weighted log probabilities: their own, the weight of their estimate, and that estimate of a one."""
    own = log_kt(n0, n1)
    return np.logaddexp(own, longer) - np.log(2), 1 / (1 + np.exp(np.clip(longer - own, -700, 700))), (n1 + 0.5) / (n0 + n1 + 1)


class Subtrees:
    """Whole subtrees of the two nearest bytes at one of the eight decisions of a byte: nodes of DEPTH to 2 bytes, and whose child each is.

    keys: sorted grams; n: their counts. A node's id is its context followed by the `level` bits decided before."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, level: int):
        ids = keys >> (8 - level)
        first = np.concatenate(([True], ids[1:] != ids[:-1]))
        self.place = np.cumsum(first) - 1
        self.bit = keys >> (7 - level) & 1
        self.level = level
        m = int(self.place[-1]) + 1
        sums = np.bincount(self.place * 2 + self.bit, weights=n, minlength=2 * m).reshape(m, 2)
        n0, n1 = sums[:, 0], sums[:, 1]
        self.estimates, self.weights, self.parents = [(n1 + 0.5) / (n0 + n1 + 1)], [], []
        whole, ids = log_kt(n0, n1), ids[first]
        for _ in range(DEPTH - 2):
            ids, parent = np.unique(self.above(ids), return_inverse=True)
            n0, n1, longer = (np.bincount(parent, weights=x, minlength=len(ids)) for x in (n0, n1, whole))
            whole, weight, estimate = mixture(n0, n1, longer)
            self.parents.append(parent)
            self.weights.append(weight)
            self.estimates.append(estimate)
        self.n0, self.n1, self.whole = n0, n1, whole
        over = self.above(ids)
        self.byte, self.decision = over >> level, (over & ((1 << level) - 1)) | 1 << level

    def above(self, ids: np.ndarray) -> np.ndarray:
        return ids >> (8 + self.level) << self.level | (ids & ((1 << self.level) - 1))

    def logs(self, before: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's decision; before, share (byte x decision): what the shorter contexts give a one and leave to longer ones."""
        one, left = before[self.byte, self.decision], share[self.byte, self.decision]
        for weight, estimate, parent in zip(self.weights[::-1], self.estimates[:0:-1], self.parents[::-1], strict=True):
            one, left = (one + left * weight * estimate)[parent], (left * (1 - weight))[parent]
        one = one + left * self.estimates[0]
        return np.log10(np.where(self.bit, one[self.place], 1 - one[self.place]))


def whole_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (key, n, every) in order of key -> the columns in parts of about CHUNK grams that end where a subtree of the two nearest bytes does."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= CHUNK:
            keys, n, every = (np.concatenate(x) for x in zip(*kept, strict=True))
            end = int(np.searchsorted(keys, keys[-1] >> 24 << 24))
            if end:
                yield keys[:end], n[:end], every[:end]
            kept, size = [[keys[end:], n[end:], every[end:]]], (len(keys) - end if end else 0)
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def gram_logs(grams: DataFrame) -> DataFrame:
    """grams (key, n, every) -> key, every, log: the log10 probability of the gram's byte after the bytes before it, by the tree of all contexts."""
    trees = grams.select("key", "n", "every").repartition(F.shiftright("key", 24)).sortWithinPartitions("key")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 1 << 16))
        for keys, n, _ in whole_subtrees(batches):
            for level in range(8):
                part = Subtrees(keys, n, level)
                node = part.byte << 8 | part.decision
                for total, x in zip(sums, (part.n0, part.n1, part.whole), strict=True):
                    total += np.bincount(node, weights=x, minlength=1 << 16)
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, sums[:, at])], ["node", "n0", "n1", "longer"])

    rows = trees.mapInArrow(summed, "node long, n0 double, n1 double, longer double")
    found = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "longer")]).toPandas()
    sums = np.zeros((3, 256, 256))
    for total, c in zip(sums, ("n0", "n1", "longer"), strict=True):
        total.ravel()[found["node"].to_numpy(dtype=np.int64)] = found[c].to_numpy()
    n0, n1, longer = sums
    whole, weight, estimate = mixture(n0, n1, longer)
    _, top_weight, top_estimate = mixture(n0.sum(axis=0), n1.sum(axis=0), np.where(n0 + n1 > 0, whole, 0).sum(axis=0))
    before = top_weight * top_estimate + (1 - top_weight) * weight * estimate
    shared = grams.sparkSession.sparkContext.broadcast((before, (1 - top_weight) * (1 - weight)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, every in whole_subtrees(batches):
            logs = np.zeros(len(keys))
            for level in range(8):
                logs += Subtrees(keys, n, level).logs(*shared.value)
            for i in range(0, len(keys), 1 << 16):
                j = i + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.array(every[i:j]), pa.array(logs[i:j])], ["key", "every", "log"])

    return trees.mapInArrow(weighed, "key long, every long, log double")


def most_frequent(logs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """logs (key, every, log) -> its rows of the highest counts, at most `most`, and the others: cut between powers of 2 ** (1 / 16), without a sort."""
    bucket = F.floor(F.log2("every") * 16)
    left, least = most, None
    for b, n in sorted(((r.b, r.n) for r in logs.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > left:
            break
        left, least = left - n, b
    return (logs.limit(0), logs) if least is None else (logs.where(bucket >= least), logs.where(bucket < least))


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the wanted are among the sorted keys, their values; 0 for the others)"""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], 0.0)


def sorted_arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """df (key, log), of proven size, as arrays in order of the key."""
    table = df.select("key", F.col("log").cast("double").alias("log")).toArrow()
    keys, logs = table["key"].to_numpy(), table["log"].to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.int64), logs[order].astype(np.float64)


def scored(docs: DataFrame, frequent: int = 1 << 16, frequent_grams: int = 1 << 19, folds: int = 5, held_out: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row.

    Documents whose crc32(doc_id as text) mod folds is held_out are left out of training; a null doc_id counts as empty text and
    trains. A null or empty text is its end token. Repeated rows each train and each are scored; with nothing to train on, counts
    are 0 and every byte has the probability of empty nodes. Words are told apart by 64-bit hashes. score: log10 probability of
    the words, joined by spaces, and the end. Other columns are not looked at."""
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held_out
    base = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", fold.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = written(gram_counts(base.select("held_out", "text")), "counts")
    ends = base.where(~F.col("held_out")).count()
    words = counts.where(~F.col("gram"))
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    train_tokens, kinds = n_words + ends, kinds + (ends > 0)
    # a word that no training document has keeps a null log: it counts as unknown, like one that is not in the table
    word_logs = words.select("key", "every", F.when(F.col("n") > 0, F.log10(F.col("n") + 0.5)).alias("log"))
    common, uncommon = most_frequent(word_logs, frequent)
    often, seldom = most_frequent(written(gram_logs(counts.where("gram")), "grams"), frequent_grams)
    unknown = float(np.log10(0.5))
    shared = spark.sparkContext.broadcast((sorted_arrays(common.select("key", F.coalesce("log", F.lit(unknown)).alias("log"))), sorted_arrays(often)))

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common_keys, common_logs), (often_keys, often_logs) = shared.value
        end_log = float(np.log10(ends + 0.5))
        for batch, rows, texts in parts_of(batches, 3):
            data, starts = coded(texts)
            bounds = starts - DEPTH * np.arange(len(starts))
            grams, place = np.unique(gram_keys(data, own_places(data, starts)), return_inverse=True)
            found, values = looked_up(often_keys, often_logs, grams)
            scores = np.add.reduceat(values[place], bounds[:-1])
            late = np.flatnonzero(~found[place])
            late_from = np.searchsorted(late, bounds)
            late = grams[place[late]]
            every = list({w for words in texts for w in words})
            hashes = np.fromiter(map(word_key, every), dtype=np.int64, count=len(every))
            seen, logs = looked_up(common_keys, common_logs, hashes)
            known = dict(zip(every, zip(hashes.tolist(), seen.tolist(), logs.tolist(), strict=True), strict=True))
            n_tokens, n_known, sums, kinds_of, keys_of, times_of, sizes = [], [], [], [], [], [], [0]
            for t, words in enumerate(texts):
                total, n = end_log, int(ends > 0)
                keys, times = np.unique(late[late_from[t] : late_from[t + 1]], return_counts=True)
                own_keys, own_times = [], []
                for word, k in Counter(words).items():
                    key, is_common, log = known[word]
                    if is_common:
                        total += k * log
                        n += k if log != unknown else 0
                    else:
                        own_keys.append(key)
                        own_times.append(k)
                kinds_of.append(np.arange(len(keys) + len(own_keys)) < len(keys))
                keys_of += [keys, np.array(own_keys, dtype=np.int64)]
                times_of += [times, np.array(own_times, dtype=np.int64)]
                sizes.append(len(keys) + len(own_keys))
                n_tokens.append(len(words) + 1)
                n_known.append(n)
                sums.append(total)
            own = batch.take(pa.array(rows)).select([0, 1, 2])
            rare = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (kinds_of, keys_of, times_of)], ["gram", "key", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rare)
            more = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores), rare]
            yield pa.RecordBatch.from_arrays([*own.columns, *more], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "sums", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = written(base.mapInArrow(partly, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, sums double, score double, rare array<struct<gram: boolean, key: long, n: long>>"), "scores")
    rare = part.select("uid", F.explode("rare").alias("r")).select("uid", "r.gram", "r.key", F.col("r.n").alias("times"))
    known = uncommon.select(F.lit(False).alias("gram"), "key", "log").unionByName(seldom.select(F.lit(True).alias("gram"), "key", "log"))
    joined = rare.join(known, ["gram", "key"], "left")
    value = F.col("times") * F.coalesce("log", F.lit(unknown))
    word = ~F.col("gram")
    late = joined.groupBy("uid").agg(
        F.sum(F.when(word, value)).alias("late"), F.sum(F.when(word & F.col("log").isNotNull(), F.col("times"))).alias("late_known"), F.sum(F.when(F.col("gram"), value)).alias("late_score")
    )
    all_parts = part.drop("rare").join(late, "uid", "left")
    base_score = F.col("sums") + F.coalesce("late", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(train_tokens + 0.5 * (kinds + 1)))
    return all_parts.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base_score.alias("base_score"), (F.col("score") + F.coalesce("late_score", F.lit(0.0))).alias("score"))
