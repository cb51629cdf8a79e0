"""URL filters by a cascade of Bloom filters: exact membership of listed keys, without joins.

A url's keys are its host's suffixes, each with every prefix of its path that ends in a slash. Level 1 of a cascade encodes the listed
keys; level 2 the other keys of the corpus that level 1 takes for listed; level 3 the listed keys that level 2 takes for
those; and so on, until a level has no false positives. A key of the corpus is listed if the first level that denies it
is an even one (or, past the last level, if the number of levels is odd).

The universe is every key of every url, so membership is exact over the corpus. A level's bits are set by an aggregation over
words of 64 bits; only those words, whose number follows that of the level's keys, reach the driver and the tasks. Level 1 is
sized so that it passes about as many other keys as there are listed ones, so the cascade's size follows the list, not
the corpus, at 1.44 bits a key and halving of the rate. What is broadcast is bounded by `most_bits`: a longer list is split by a hash of its
keys into parts, each with a cascade of its own over the keys of the corpus with that hash, and the urls meet one part after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import written

def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty where url is null or has no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or end; empty where url is null or has no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: str, path: str) -> list[str]:
    """The url's keys, the longest first: each suffix of the host at a dot, with each prefix of the path that ends in a slash."""
    if not host:
        return []
    labels, parts = host.split("."), path.split("/")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    keys = [f"{s}{'/'.join(parts[:i])}/" for s in suffixes for i in range(1, len(parts))]
    return sorted(keys, key=lambda k: (len(k), k), reverse=True)


def url_keys(host: Column, path: Column) -> Column:
    @F.pandas_udf("array<string>")
    def keys(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([keys_of(h, p) for h, p in zip(hosts, paths, strict=True)], dtype=object)

    return keys(host, path)


def places(key: str, level: int, bits: int, hashes: int) -> list[int]:
    """The bits of a level that stand for the key."""
    h = xxhash.xxh3_128_intdigest(key.encode(), level)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


def sized(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter of n keys with this rate of false positives."""
    return max(256, math.ceil(-n * math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, key: str, no: int) -> bool:
        words = self.words
        return all(words[p >> 6] >> np.uint64(p & 63) & np.uint64(1) for p in places(key, no, self.bits, self.hashes))


class Cascade:
    """levels: Bloom filters over, in turn, listed keys and others."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def denied_at(self, key: str) -> int:
        for no, level in enumerate(self.levels):
            if not level.has(key, no):
                return no
        return len(self.levels)

    def lists(self, key: str) -> bool:
        return self.denied_at(key) % 2 == 1

    @property
    def n_bits(self) -> int:
        return sum(level.bits for level in self.levels)


def _level(keys: DataFrame, no: int, bits: int, hashes: int) -> Level:
    """The Bloom filter over keys (key), its bits gathered by 64-bit word."""

    @F.pandas_udf("array<long>")
    def set_bits(batch: pd.Series) -> pd.Series:
        return batch.map(lambda k: places(k, no, bits, hashes))

    at = keys.select(F.explode(set_bits("key")).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    found = at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
    words = np.zeros(bits // 64 + 1, dtype=np.int64)
    words[found["word"].to_numpy()] = found["set"].to_numpy()
    return Level(bits, hashes, words.view(np.uint64))


def _passes(level: Broadcast, no: int):
    @F.pandas_udf("boolean")
    def passes(batch: pd.Series) -> pd.Series:
        own = level.value
        return batch.map(lambda k: own.has(k, no)).astype(bool)

    return passes


def first_rate(n_listed: int, n_others: int) -> float:
    """The first level's rate of false positives: about as many other keys pass as are listed."""
    return min(0.5, max(1e-9, n_listed / max(1, n_others)))


def build(spark: SparkSession, listed: DataFrame, universe: DataFrame, most_levels: int = 40) -> Cascade:
    """listed (key), universe (key; repeats do no harm) -> the cascade that tells them apart, exactly on both.

    Both are read several times: give written tables."""
    listed = listed.where("key is not null").distinct()
    n_listed = listed.count()
    if not n_listed:
        return Cascade([])
    n_others = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [_level(listed, 0, *sized(n_listed, first_rate(n_listed, n_others)))]
    own, others = listed, universe.where("key is not null")
    while len(levels) < most_levels:
        source = others if len(levels) % 2 else own
        passed = source.where(_passes(spark.sparkContext.broadcast(levels[-1]), len(levels) - 1)("key")).distinct()
        if len(levels) == 1:  # what passes is about twice the list, whatever the corpus
            passed = passed.join(listed, "key", "left_anti")
        false = written(passed, "false")
        n_false = false.count()
        if not n_false:
            return Cascade(levels)
        levels.append(_level(false, len(levels), *sized(n_false, 0.1)))
        if source is others:
            others = false
        else:
            own = false
    raise RuntimeError(f"{most_levels} levels have not told the keys apart")


def small(listed: set[str], universe: set[str]) -> Cascade:
    """The cascade of two lists that are parameters themselves, made on the spot."""
    levels: list[Level] = []
    own, others = listed, universe - listed
    while own:
        no, (bits, hashes) = len(levels), sized(len(own), 0.05)
        words = np.zeros(bits // 64 + 1, dtype=np.uint64)
        for p in (p for key in own for p in places(key, no, bits, hashes)):
            words[p >> 6] |= np.uint64(1 << (p & 63))
        levels.append(Level(bits, hashes, words))
        own, others = {k for k in others if levels[-1].has(k, no)}, own
    return Cascade(levels)


#: The contract's rules, by verdict.
RULES = {"block": ["net/", "example.com/de/"], "allow": ["example.net/en/", "org/fr/"]}
#: Hosts that are listed as unwanted, apart from the rules: each as a registered name that any domain may carry.
UNWANTED = ["casino-win", "cheap-pills", "free-bets", "ads-track", "spam-farm", "adult-x"]
ZONES = ["example.com", "example.net", "example.org"]


def unwanted_keys(spark: SparkSession, names: list[str] | None = None, zones: list[str] | None = None) -> DataFrame:
    """The table of unwanted keys (key: host/) that the query reads where it is given none."""
    names, zones = UNWANTED if names is None else names, ZONES if zones is None else zones
    return spark.createDataFrame([(f"{n}.{z}/",) for n in names for z in zones], "key string")


def judged(pages: DataFrame, rules: dict[str, list[str]] | None = None, unwanted: DataFrame | None = None, most_bits: int = 1 << 28) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict.

    rules: keys host/path/ by verdict, block or allow; unwanted: a table (key: host/path/) of any length. A cascade holds them all over all
    keys of the corpus, in as many parts as keep the bits of a part's first level below most_bits; two more, over the listed keys
    only, tell rules from other keys and blocks from allows. The longest key that is a rule is the url's rule. Without one the verdict
    is block if a key is unwanted, else allow. A key that is both is a rule. Null urls, and urls without :// or without a path, have no keys:
    allow, without a rule. Rows, repeated ones and null ids too, are judged each; other columns are not looked at. An empty table gives an empty one."""
    spark = pages.sparkSession
    rules = rules or RULES
    lists = {verdict: set(rules.get(verdict, [])) for verdict in ("block", "allow")}
    every_rule = lists["block"] | lists["allow"]
    rule_keys = spark.createDataFrame([(k,) for k in sorted(every_rule)], "key string")
    listed = written(rule_keys.unionByName((unwanted_keys(spark) if unwanted is None else unwanted).select("key")).distinct(), "listed")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = written(urls.select(F.explode(url_keys(F.col("host"), F.col("path"))).alias("key")), "keys")
    n = listed.count()
    parts = max(1, math.ceil(sized(n, first_rate(n, universe.count()))[0] / most_bits))
    of_rules, blocks = build(spark, rule_keys, listed), small(lists["block"], every_rule)
    found = urls.withColumn("found", F.array().cast("array<string>"))
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    for no in range(parts):
        cascade = build(spark, listed.where(part == no), universe.where(part == no))
        more = _found(spark.sparkContext.broadcast(cascade))(F.filter(url_keys(F.col("host"), F.col("path")), lambda k: F.pmod(F.xxhash64(k), F.lit(parts)) == no))  # noqa: B023
        found = found.withColumn("found", F.concat("found", more))
        if no < parts - 1:
            found = written(found, "found")
    shared = spark.sparkContext.broadcast((of_rules, blocks))

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of_rules, blocks = shared.value
        for batch in batches:
            out = []
            for keys in batch:
                rule = max((k for k in keys if of_rules.lists(k)), key=lambda k: (len(k), k), default=None)
                block = blocks.lists(rule) if rule else len(keys) > 0
                out.append((rule, "block" if block else "allow"))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    return found.select("page_id", "host", "path", verdicts("found").alias("v")).select("page_id", "host", "path", "v.rule", "v.verdict")


def _found(cascade: Broadcast):
    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = cascade.value
        for batch in batches:
            yield batch.map(lambda keys: [k for k in keys if own.lists(k)])

    return found
