"""Token counts: byte-pair merging with a heap over a linked list, counting merges and making no identifiers.

A word's symbols stand in a doubly linked list; a heap holds its adjacent pairs by merge rank. The lowest-ranked pair is popped,
its symbols become one, and the two new neighbours' pairs are pushed; n symbols take O(n log n) steps however
long the word. Each merge lowers the count by one, so the count is the number of initial symbols less that of merges.

Texts are split into words on the executors, batch by batch; a bounded memo of words spares repeating the merges. No shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMO = 400_000
#: Pieces up to this length are kept in the memo.
MEMO_CHARS = 40


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the vocabulary file of a BPE tokenizer with word ends describes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {tuple(pair.split(" ") if isinstance(pair, str) else pair): i for i, pair in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.letters = byte_letters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"[\p{L}]+", r"\p{L}++").replace(r"[^\s\p{L}\p{N}]+", r"[^\s\p{L}\p{N}]++")).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merges(self, symbols: list[str]) -> int:
        """How many merges the symbols allow, lowest rank first and leftmost among equals."""
        n, rank = len(symbols), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has meanwhile been merged with another
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            done += 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return done

    def kept(self, piece: str, count: int) -> int:
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:  # the full memo becomes the older one, so pieces in use stay
                self.memo, self.older = {}, self.memo
            self.memo[piece] = count
        return count

    def word(self, word: str) -> int:
        count = self.memo.get(word)
        if count is None:
            symbols = [self.letters[b] for b in word.encode("utf-8")]
            symbols[-1] += self.end
            count = self.kept(word, len(symbols) - self.merges(symbols))
        return count

    def chunk(self, chunk: str) -> int:
        if (count := self.older.get(chunk)) is not None:
            return self.kept(chunk, count)
        words = self.words(chunk)
        return self.word(chunk) if words == [chunk] else self.kept(chunk, sum(map(self.word, words)))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings: NFC, letters lowered one by one; no word spans a space or line end."""
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        memo, chunk = self.memo, self.chunk
        total = 0
        for c in low.replace("\n", " ").split(" "):
            count = memo.get(c)
            total += chunk(c) if count is None else count
        return total

    def text(self, text: str) -> int:
        """Special strings in the text are one token each, as the library takes them by default."""
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def n_tokens(text: Column, vocabulary: str) -> Column:
    """A text column's token counts; vocabulary: the path of the tokenizer file on each machine. Null counts as the empty text."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(vocabulary).text
        for batch in batches:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return counted(F.coalesce(F.make_valid_utf8(text), F.lit("")))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row for each row.

    A null or empty text has no bytes and no tokens. Repeated rows are counted each; other columns are not looked at."""
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col("text"), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
