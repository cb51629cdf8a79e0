"""Groups of spelling variants: frequent words of a corpus within one edit of each other, found by Aho-Corasick automata over halves of words.

A word of length L has a first half of L // 2 code points and a second half of the rest. One edit leaves one half of each of two
near words whole, at the start or at the end of the other. Halves are dealt to shards by their hash; every word goes to the shards that could hold
a half of a near word (two lengths at either end) and is scanned there by the shard's automaton; each hit is checked for its place,
the length of its owner and the distance."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written

#: Runs of A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8: those letters beyond ASCII are \xC3 and one byte more, and nothing else begins so.
RUN = re.compile(rb"[a-z\xc3][a-z\x80-\xbf\xc3]*")
#: A byte after which a text may be cut: no letter, and no part of a character beyond ASCII.
EDGE = re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of text whose runs are held at a time, and distinct words that a task holds before it hands them on.
SLICE, MOST_HELD = 1 << 20, 200_000
#: Words a shard, and owners of one half beyond which its words are compared by their masked rests and not one by one.
SHARD, MOST_OWNERS = 2000, 512
#: Owners of a half and length up to which each is compared; of more, those that can be near are looked up.
FEW = 16


def slices(low: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(low):
        edge = EDGE.search(low, at + SLICE) if len(low) - at > SLICE else None
        end = edge.end() if edge else len(low)
        yield low[at:end]
        at = end


def without(run: bytes, at: int) -> bytes:
    text = run.decode("utf-8", "replace")
    return (text[: at % len(text)] + text[at % len(text) + 1 :]).encode()


def word_counts(docs: DataFrame, slips: int = 0) -> DataFrame:
    """(word, n): the runs of all texts, A-Z lower-cased, and how often they occur.

    slips > 0 plants slips of spelling: where it divides the unsigned crc32 of `<doc_id>:<run>`, the run loses the code point at that
    number modulo its length. A null text has no words; a null doc_id is written as nothing. Counts are made per task, with a bounded number of words held, and added by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{key.as_py()}:".encode())
                for part in slices(text.as_buffer().to_pybytes().lower()):
                    for run, n in Counter(RUN.findall(part)).items():
                        if slips and (h := zlib.crc32(run, start)) % slips == 0:
                            run = without(run, h)
                        held[run] += n
                    if len(held) > MOST_HELD:
                        yield handed()
                        held.clear()
        yield handed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :]


def left_out(rest: str) -> set[str]:
    return {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


class Owners:
    """The words of one length that have a half at one end, found by what is left of them: an edit outside the half is an edit of the rest."""

    __slots__ = ("side", "size", "words", "found")

    def __init__(self, side: int, size: int):
        self.side, self.size, self.words, self.found = side, size, [], None

    def rest(self, word: str) -> str:
        return word[: len(word) - self.size] if self.side else word[self.size :]

    def index(self) -> dict[str, list[tuple[str, int]]]:
        """Rests as they are, with a place masked and (after a mark) with a place left out."""
        found: dict[str, list[tuple[str, int]]] = {}
        for own in self.words:
            rest = self.rest(own[0])
            keys = [rest, *(rest[:i] + "\0" + rest[i + 1 :] for i in range(len(rest))), *("\1" + x for x in left_out(rest))]
            for key in keys:
                found.setdefault(key, []).append(own)
        return found

    def candidates(self, word: str) -> Iterator[tuple[str, int]]:
        if len(self.words) <= FEW:
            yield from self.words
            return
        if self.found is None:
            self.found = self.index()
        rest, longer = self.rest(word), len(word) - len(self.words[0][0])
        keys = left_out(rest) if longer > 0 else ["\1" + rest] if longer < 0 else [rest[:i] + "\0" + rest[i + 1 :] for i in range(len(rest))]
        for key in keys:
            yield from self.found.get(key, ())


def automaton(owners: list[tuple[int, str, str, int]]) -> ahocorasick.Automaton:
    """owners: (side, half, word, n). Each half's value: for either side, its owners by their length."""
    values: dict[str, tuple[dict, dict]] = {}
    for side, half, word, n in owners:
        sides = values.setdefault(half, ({}, {}))
        sides[side].setdefault(len(word), Owners(side, len(half))).words.append((word, n))
    found = ahocorasick.Automaton()
    for half, value in values.items():
        found.add_word(half, (half, value))
    found.make_automaton()
    return found


def near_in(machine: ahocorasick.Automaton, word: str) -> Iterator[tuple[str, int]]:
    """The owners near the word, each once: by its first half where the word begins with that, else by its second."""
    for end, (half, sides) in machine.iter(word):
        for side, at_its_place in ((0, end + 1 == len(half)), (1, end + 1 == len(word))):
            if not at_its_place:
                continue
            for length in range(len(word) - 1, len(word) + 2):
                if len(half) == (length - length // 2 if side else length // 2):
                    for own, n in sides[side][length].candidates(word) if length in sides[side] else ():
                        if not (side and word.startswith(own[: length // 2])) and one_edit(word, own):
                            yield own, n


def scanned(table: pa.Table) -> pa.Table:
    """A shard's rows (side, half, word, n) with its owners and, where half is null, the words to scan -> (word, n_near, near_n, near)."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("side", "half", "word", "n")), strict=True))
    owners = [r for r in rows if r[1] is not None]
    found: list[tuple[str, int, int, str]] = []
    if owners:
        machine = automaton(owners)
        for _, half, word, _ in rows:
            if half is None and (near := list(near_in(machine, word))):
                best = min(near, key=lambda x: (-x[1], x[0]))
                found.append((word, len(near), best[1], best[0]))
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "near_n", "near"])


def ends(word: Column, lengths: tuple[Column, Column], side: int) -> list[Column]:
    return [F.struct(F.lit(side).alias("side"), (F.right(word, k) if side else F.left(word, k)).alias("half")) for k in lengths]


def masked(pairs: DataFrame, probe: bool) -> DataFrame:
    """One row for each way in which a rest may meet another: with a place masked, with one left out, and as it is."""
    rest = F.when(F.col("side") == 0, F.expr("substr(word, length(half) + 1)")).otherwise(F.expr("left(word, length(word) - length(half))"))
    places = F.when(F.length("rest") > 0, F.sequence(F.lit(1), F.length("rest"))).otherwise(F.array().cast("array<int>"))
    masks = F.transform(places, lambda i: F.struct(F.lit(0).alias("way"), F.concat(F.substring("rest", F.lit(1), i - 1), F.lit("\u0001"), F.expr("rest").substr(i + 1, F.length("rest"))).alias("key")))
    less = F.transform(F.array_distinct(F.transform(places, lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.expr("rest").substr(i + 1, F.length("rest"))))), lambda k: F.struct(F.lit(2 if probe else 1).alias("way"), k.alias("key")))
    same = F.array(F.struct(F.lit(1 if probe else 2).alias("way"), F.col("rest").alias("key")))
    return pairs.withColumn("rest", rest).select("side", "half", "word", "n", F.inline(F.concat(masks, less, same)))


def near_words(words: DataFrame, most_owners: int = MOST_OWNERS, shard: int = SHARD) -> DataFrame:
    """(word, n) with distinct words of two code points or more -> (word, n_near, near, near_n) of those that have near words.

    near is the near word of largest n, the first in code-point order of several. words must be a written table. Halves of more than most_owners
    words would make a task compare all their pairs: those words are joined on their rests with one place masked or left out, so the rows grow with the links."""
    word, length = F.col("word"), F.length("word")
    first, second = F.floor(length / 2).cast("int"), F.ceil(length / 2).cast("int")
    owners = words.select("word", "n", F.inline(F.array(*ends(word, (first,), 0), *ends(word, (second,), 1))))
    lower = F.floor((length - 1) / 2).cast("int"), F.floor((length + 1) / 2).cast("int")
    probes = words.select("word", "n", F.inline(F.array(*ends(word, lower, 0), *ends(word, (first, first + 1), 1)))).where("half <> ''")
    hot = written(owners.groupBy("side", "half").count().where(F.col("count") > most_owners).select("side", "half"), "halves")
    crowded = not hot.isEmpty()
    cold = (lambda df: df.join(hot, ["side", "half"], "left_anti")) if crowded else (lambda df: df)
    shards = max(1, -(-words.count() // shard))
    place = F.pmod(F.xxhash64("side", "half"), F.lit(shards))
    held = cold(owners).select(place.alias("shard"), "side", "half", "word", "n")
    sent = cold(probes).select(place.alias("shard"), "word").distinct().select("shard", F.lit(0).alias("side"), F.lit(None).cast("string").alias("half"), "word", F.lit(0).cast("long").alias("n"))
    found = held.unionByName(sent).groupBy("shard").applyInArrow(scanned, "word string, n_near long, near_n long, near string")
    if crowded:
        crowd = lambda df: df.join(hot, ["side", "half"], "left_semi")
        a, b = masked(crowd(probes), True), masked(crowd(owners), False).select("side", "half", "way", "key", F.col("word").alias("near"), F.col("n").alias("near_n"))
        met = a.join(b, ["side", "half", "way", "key"]).where(F.col("word") != F.col("near"))
        met = met.where((F.col("side") == 0) | ~F.startswith("word", F.expr("left(near, cast(floor(length(near) / 2) as int))")))
        found = found.unionByName(met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")).select("word", "n_near", (-F.col("b.m")).alias("near_n"), "b.near"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.near", (-F.col("b.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last form that is reached. A form is more frequent than its word, so there are no circles.

    Pointer doubling: each round joins the words that go on with what their root leads to, and the number of rounds is the logarithm of the longest chain."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        now = new.select("word", "root")
        if new.where("went").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, slips: int = 0, most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    form: its near word of largest n (ties: first in code-point order) if that n is `times` the word's or more, else null; root: where forms lead.
    Null texts and texts without letters have no words; repeated rows count again; an empty table gives no rows."""
    long_enough = (F.length("word") >= least_length) & (F.col("n") >= least_count)
    words = written(word_counts(docs.select("doc_id", "text"), slips).where(long_enough), "words")
    near = near_words(words, most_owners)
    known = near["near_n"] >= times * words["n"]
    joined = words.join(near, "word", "left").select(
        words["word"], words["n"], F.coalesce(near["n_near"], F.lit(0)).alias("n_near"), F.when(known, near["near"]).alias("form"), F.when(known, near["near_n"]).alias("form_n")
    )
    result = written(joined, "forms")
    return result.join(roots(result.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
