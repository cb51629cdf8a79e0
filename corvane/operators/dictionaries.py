"""Names of a dictionary within texts, found by Aho-Corasick automata: a text is read once, whatever the number of names; names that words nearly spell."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache
from itertools import combinations

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of names that one automaton holds: a broadcast of at most this size. Larger dictionaries are split by the names' hash.
MOST_BYTES = 64 << 20
#: Keys that a word or name has at most for each length that it is compared with, unless it can be cut no finer.
MOST_KEYS = 256
_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(own: str, names: list[str]) -> ahocorasick.Automaton:
    """The automaton of a broadcast list, built once in each worker; own is a name that no other list has."""
    if own not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, name in enumerate(names):
            found.add_word(name, i)
        found.make_automaton()
        _BUILT[own] = found
    return _BUILT[own]


def contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """texts (key, text), names (name) -> (key, name): the distinct names that a row's text contains, as they are spelt in lower case, anywhere in it.

    Names are sized first. Each part of at most most_bytes is broadcast and met by all texts, so a dictionary k times as large costs k passes
    and no more memory. Null and empty names are in no text; null texts contain none. Works on streams of texts, where names are read once."""
    low = names.select(F.lower(name).alias("name")).where("name <> ''").distinct()
    size = low.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0
    parts = -(-size // most_bytes)
    spark, kind = texts.sparkSession, dict(texts.dtypes)[key]
    found = None
    for part in range(parts):
        held = low if parts == 1 else low.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        listed = [r[0] for r in held.collect()]  # at most most_bytes
        if not listed:
            continue
        sent = spark.sparkContext.broadcast(listed)

        def each(batches: Iterator[pa.RecordBatch], sent=sent, own=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            words = sent.value
            machine = automaton(own, words)
            for batch in batches:
                rows, got = [], []
                for i, body in enumerate(batch.column(1)):
                    if body.is_valid:
                        hits = {w for _, w in machine.iter(body.as_py())}
                        rows += [i] * len(hits)
                        got += [words[w] for w in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(got, pa.string())], names=[key, "name"])

        hits = texts.select(key, F.lower(text).alias("_text")).mapInArrow(each, f"`{key}` {kind}, name string")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return texts.select(key, F.lit("").alias("name")).limit(0)
    return found


def most_edits(a: Column, b: Column, score: int) -> Column:
    """How many characters two words of these lengths may have left over, deleted or inserted, if their ratio of 2 * matches / lengths rounds to score or more.

    It is odd if the sum of the lengths is, as matches come in pairs."""
    most = F.floor((a + b) * (1 - (score - 0.5) / 100) + 1e-9).cast("int")
    return most - F.pmod(most - a - b, F.lit(2))


@cache
def cuts(la: int, lb: int, score: int, most: int = MOST_KEYS) -> tuple[list, list]:
    """How words of la and names of lb characters are keyed: for either a list of (part, from, characters, how many of them are left out); empty if the lengths are too far apart.

    Similar enough, they have at most d characters left over: x of the word, y of the name. Whole words then have something in common with x and y characters left
    out; of k parts of a name one has at most d / k left over. Taken is the smallest k that gives neither side more than `most` keys: the fewer parts, the fewer
    pairs that aren't near; with d + 1 parts, one is found in the word as it is."""
    d = math.floor((la + lb) * (1 - (score - 0.5) / 100) + 1e-9)
    d -= (d - la - lb) % 2
    x, y = (d + la - lb) // 2, (d + lb - la) // 2
    if x < 0 or y < 0:
        return [], []
    for k in range(1, d + 2):
        words, names, q = set(), set(), d // k
        for part in range(k):
            at, size = lb * part // k, lb * (part + 1) // k - lb * part // k
            for y1 in range(min(q, y, size) + 1):
                for x1 in range(min(q - y1, x) + 1):
                    if x1 + y1 + 2 <= q and x1 < x and y1 < y and y1 < size:
                        continue  # with one more left out of both they still have the rest in common
                    own = size - y1 + x1
                    first, last = (0, 0) if part == 0 else (max(0, at - y + y1), min(la - own, at + x - x1))
                    if part == k - 1:
                        first = last = la - own
                    words |= {(part, start, own, x1) for start in range(first, last + 1) if 0 <= start <= la - own}
                    names.add((part, at, size, y1))
        if k == d + 1 or max(sum(math.comb(c[2], c[3]) for c in side) for side in (words, names)) <= most:
            return sorted(words), sorted(names)


@cache
def kept(n: int, out: int) -> list[tuple[int, ...]]:
    """The places of n of which `out` are left out, in every way."""
    return list(combinations(range(n), n - out))


def keyed(words: DataFrame, side: int, score: int) -> DataFrame:
    """words (word, ...) -> key with their columns: the words' keys (side 0) or the names' (side 1), by `cuts`. Words are near only if they have a key in common."""
    share, columns = 1 - (score - 0.5) / 100, words.columns  # lengths differ by at most this share of their sum

    def keys(word: str) -> Iterator[int]:
        n = len(word)
        for m in range(max(1, math.ceil(n * (1 - share) / (1 + share) - 1e-9)), math.floor(n * (1 + share) / (1 - share) + 1e-9) + 1):
            la, lb = (m, n) if side else (n, m)
            own = set()
            for part, start, size, out in cuts(la, lb, score)[side]:
                piece, prefix = word[start : start + size], f"{la} {lb} {part} "
                own |= {prefix + "".join([piece[i] for i in places]) for places in kept(size, out)} if out else {prefix + piece}
            for key in own:
                yield xxhash.xxh3_64_intdigest(key.encode()) - (1 << 63)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[int] = []
            made = lambda: pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *[c.take(pa.array(rows, pa.int64())) for c in batch.columns]], names=["key", *columns])  # noqa: B023, E731
            for i, word in enumerate(batch.column(0)):
                before = len(found)
                found.extend(keys(word.as_py()))
                rows += [i] * (len(found) - before)
                if len(rows) > 1 << 16:
                    yield made()
                    rows, found = [], []
            yield made()

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in words.dtypes)
    return words.mapInArrow(each, f"key long, {kinds}")


def nearly(tokens: DataFrame, token: str, names: DataFrame, name: str, place: str, score: int = 88) -> DataFrame:
    """(token, name, score): for each distinct token the name of highest spelling ratio (difflib's, in percent, rounded), ties by the smaller place;
    tokens whose best name is below `score`, or is the token itself, have no row. Dictionaries of any size; null and empty words are near nothing.

    Two words with at most d characters left over, which follows from their lengths, share what is left of them, or of a part, with some left out (`cuts`): both are
    joined on these keys. Up to some twenty characters a pair that meets is one with no more than d left over; pairs are tried by their edit distance, and what is left by the ratio itself.
    Spark takes keys for as small as the names they are made of: the joins are merges at every size, so that the driver gets no keys and no names."""
    own = tokens.select(F.col(token).alias("token")).where("token <> ''").distinct()
    held = names.select(F.col(name).alias("name"), F.col(place).alias("place")).where("name <> ''").groupBy("name").agg(F.min("place").alias("place"))
    spread = max(own.sparkSession.sparkContext.defaultParallelism, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = keyed(own.repartition(spread, "token"), 0, score)
    known = keyed(held.select("name").repartition(spread, "name"), 1, score)
    edits = most_edits(F.length("token"), F.length("name"), score)
    near = asked.join(known.hint("merge"), "key").withColumn("d", edits).where(F.expr("levenshtein(token, name, d) >= 0")).select("token", "name").distinct()

    @F.pandas_udf("int")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(SequenceMatcher(None, x, y).ratio() * 100) for x, y in zip(a, b, strict=True)], dtype="int32")

    scored = near.withColumn("score", ratio("token", "name")).join(held.hint("merge"), "name")
    best = scored.groupBy("token").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), "place")).alias("best"))
    return best.select("token", "best.*").where((F.col("score") >= score) & (F.col("token") != F.col("name")))  # not before: the ratio would be had once a key
