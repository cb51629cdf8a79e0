"""Byte-level BPE: encoding by a lazily determinised transducer, decoding through an incremental UTF-8 machine.

The transducer reads bytes and writes token ids. A sequence of tokens is the BPE encoding of its bytes exactly if each adjacent
pair of tokens is the encoding of its own bytes, so after each byte there is one token that ends there and is compatible with
what stands before its start. A configuration holds what later bytes can still change: for every place where a token may have
begun, the tokens up to that place and the vocabulary's trie node reached from it. What all of
them share is written: lookahead never exceeds the longest token. Configurations become numbered states when they are
first met, and their moves are kept; both are bounded and are built anew when full. The last written token isn't part of a state but
a register: where a token may follow it, a move has two outcomes, by whether the two are compatible.

Whether two tokens are compatible follows from how each is merged: the parts along their meeting edge live until the rank
at which they are merged on, and no part on the left may form a token with one on the right at an earlier rank.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import batched, chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMO = 300_000
MEMO_CHARS = 40
STATES = 300_000
PAIRS = 400_000
DECODE_IDS = 4096
#: Results go back to the JVM in parts of about so many ids.
HELD_IDS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merged(ranks: dict[bytes, int], piece: bytes, down_to: int = 1) -> list[bytes]:
    """Plain merging by rank, lowest and leftmost first, until down_to parts are left: for single tokens and for tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > down_to:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = STATES):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][b]
            self.token_at[node] = i
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states = [(((), 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple | None, tuple | None]] = {}

    def edge(self, token: int) -> tuple | None:
        """The token's parts along its left and right edge, each with the rank that ends it; None if merging never makes the token.

        Merges are expected in rising order, parts before wholes, as training yields them."""
        if token not in self.edges:
            whole = self.bytes_of[token]
            self.edges[token] = None
            if len(whole) == 1:
                self.edges[token] = ([(whole, 1 << 60)], [(whole, 1 << 60)])
            else:
                parts = merged(self.ranks, whole, 2)
                if len(parts) == 2:
                    left, right = self.edge(self.ranks[parts[0]]), self.edge(self.ranks[parts[1]])
                    if max(map(self.ranks.__getitem__, parts)) > token:
                        raise ValueError(f"token {token} ranks before its parts")
                    ends = lambda side: [(whole, 1 << 60), (side[0][0], token), *side[1:]]
                    self.edges[token] = (ends(left[0]), ends(right[1]))
        return self.edges[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether token stands as it is, alone and after the token before it (-1: none)."""
        known = self.pairs.get(before << 32 | token)
        if known is None:
            after, ranks = self.edge(token), self.ranks
            known = after is not None
            if known and before >= 0:
                for left, left_ends in self.edge(before)[1]:
                    for right, right_ends in after[0]:
                        rank = ranks.get(left + right)
                        if rank is not None and rank < left_ends and rank <= right_ends:
                            known = False
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[before << 32 | token] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, tuple | None, tuple | None]:
        """(token, move if it fits after the last written one, move if not or if token is -1), computed when first asked for.

        A move is the next state and what is written. Places where a token may have begun stand in rising order, and one token ends
        at this byte. Only the first place can stand right after the last written token."""
        trie, token_at = self.trie, self.token_at
        now, end, first = [], None, -1
        for path, node in self.states[state]:
            child = trie[node].get(byte)
            if child is None:
                continue
            if (token := token_at[child]) >= 0:
                if not path:
                    first = token
                elif end is None and self.follows(path[-1], token):
                    end = (*path, token)
            if trie[child]:
                now.append((path, child))
        found = self.moves[state << 8 | byte] = (first, self.settled(now, (first,)) if first >= 0 else None, self.settled(now, end) if end else None)
        return found

    def settled(self, now: list, end: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """The number of the state with these places and the one after end, and the tokens that all of them share, which are written."""
        now = [*now, (end, 0)]
        shared = now[0][0]
        if shared:
            for path, _ in now:
                while path[: len(shared)] != shared:
                    shared = shared[:-1]
            if shared:
                now = [(path[len(shared) :], node) for path, node in now]
        key = tuple(now)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        return number, shared

    def encode(self, piece: bytes) -> list[int]:
        """The piece's token ids. A piece that is a token is that token."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        if len(self.states) > self.most_states:
            self.forget()
        out: list[int] = []
        state, last, moves, pairs = 0, -1, self.moves, self.pairs
        for byte in piece:
            token, fit, other = moves.get(state << 8 | byte) or self.move(state, byte)
            if token >= 0:
                fits = pairs.get(last << 32 | token)
                state, now = fit if (self.follows(last, token) if fits is None else fits) else other
            else:
                state, now = other
            if now:
                out += now
                last = now[-1]
        out += self.states[state][-1][0]
        return out


class Memo(dict):
    """Pieces' ids; those of a piece that is asked for first are found then. A full memo becomes the older one, so pieces in use stay."""

    def __init__(self, encode: Callable[[bytes], list[int]], most: int = MEMO):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or tuple(self.encode(piece.encode("utf-8")))  # a list keeps room for more
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids: pieces by the pattern, each through the transducer; common pieces are remembered, within bounds."""

    def __init__(self, path: str, pattern: str, most_states: int = STATES):
        self.transducer = Transducer(read_ranks(path), most_states)
        self.pieces = regex.compile(pattern.replace(r"\p{L}+", r"\p{L}++").replace(r"\p{N}+", r"\p{N}++").replace(r"[^\s\p{L}\p{N}]+", r"[^\s\p{L}\p{N}]++")).findall
        self.ids_of = Memo(self.transducer.encode, min(MEMO, 2 * most_states)).__getitem__
        self.names = [str(i) for i in range(max(self.transducer.bytes_of) + 1)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of, self.pieces(text))))

    def written(self, ids: list[int]) -> bytes:
        """The decimal ids, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids)).encode()

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of the ids, in parts: a part ends where a character does, bytes that form none become U+FFFD."""
        bytes_of, machine = self.transducer.bytes_of.__getitem__, Utf8()
        for part in batched(ids, DECODE_IDS):
            yield machine.feed(b"".join(map(bytes_of, part)))
        yield machine.end()


class Utf8:
    """A UTF-8 machine that is fed bytes in parts: the state is how many bytes of a started character wait for the rest."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, part: bytes) -> str:
        data = self.waiting + part
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if need > back:
                    cut -= back
                break
            if lead < 0x80:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


@contextmanager
def rare_collection() -> Iterator[None]:
    """States and memos are many small tuples without cycles: the collector looks for cycles rarely while texts are encoded, and as before afterwards."""
    before = gc.get_threshold()
    gc.set_threshold(500_000, 20, 100)
    try:
        yield
    finally:
        gc.set_threshold(*before)


_encoders: dict[tuple[str, str, int], Encoder] = {}


def encoder(path: str, pattern: str, most_states: int = STATES) -> Encoder:
    key = (path, pattern, most_states)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """A text column's token ids as array<int>. Null counts as the empty text."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path, pattern).encode
        with rare_collection():
            for batch in batches:
                yield batch.map(encode)

    return encoded(F.coalesce(F.make_valid_utf8(text), F.lit("")))


def round_trips(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, most_states: int = STATES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids: a row for each row.

    path: of the rank file on each machine. Null and empty texts have no ids. Ids are decoded again in the same task; the
    digests are of the decimal ids joined by spaces and of the decoded bytes. most_states bounds the memory of transducer and memo, not their results. Other columns are not looked at."""
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string" + ", ids: array<int>>" * with_ids + ">" * (not with_ids)

    @F.pandas_udf(kind)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern, most_states)
        with rare_collection():
            for batch in batches:
                rows, held = [], 0
                for text in batch:
                    ids = own.encode(text)
                    back = hashlib.sha256()
                    for part in own.decode(ids):
                        back.update(part.encode("utf-8"))
                    rows.append((len(ids), hashlib.sha256(own.written(ids)).hexdigest(), back.hexdigest(), *([np.array(ids, dtype=np.int32)] * with_ids)))
                    held += len(ids)
                    if held >= HELD_IDS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    texts = docs.select("doc_id", F.coalesce(F.make_valid_utf8("text"), F.lit("")).alias("text"))
    return texts.select("doc_id", coded("text").alias("c")).select("doc_id", "c.*")
