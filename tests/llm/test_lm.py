"""The context tree against a plain recursive one, and words that only documents outside training have."""

import collections
import math
import zlib

import pytest

from corvane.llm import lm

TEXTS = ["the cat sat on the mat", "The cat  sat\n on a hat", "", None, "a dog sat on the cat", "novel novel novel novel words here", "one more line of the text the cat", "last one"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def body(text):
    return b"\n" * lm.DEPTH + b" ".join((text or "").encode().lower().split()) + b"\n"


class Plain:
    """Context-tree weighting as its definition reads, by recursion over contexts, for one decision of a byte."""

    def __init__(self, counts, decision):
        self.counts, self.decision = counts, decision

    def bits(self, context):
        """How often a zero and a one were decided after the context (its nearest byte last)."""
        return self.counts.get((self.decision, context), (0, 0))

    def kt(self, context):
        a, b = self.bits(context)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context):
        own = self.kt(context)
        if len(context) == lm.DEPTH:
            return own
        kids = sum(self.weighted(bytes([c]) + context) for c in range(256) if any(self.bits(bytes([c]) + context)))
        top = max(own, kids)
        return top + math.log(math.exp(own - top) + math.exp(kids - top)) - math.log(2)

    def one(self, context):
        """The probability of a one after a full context: each node's estimate and its child's, by the nodes' posterior weights."""
        p = None
        for d in range(lm.DEPTH, -1, -1):
            c = context[lm.DEPTH - d :]
            a, b = self.bits(c)
            own = (b + 0.5) / (a + b + 1)
            if d == lm.DEPTH:
                p = own
                continue
            kids = sum(self.weighted(bytes([x]) + c) for x in range(256) if any(self.bits(bytes([x]) + c)))
            share = 1 / (1 + math.exp(min(700, max(-700, kids - self.kt(c)))))
            p = share * own + (1 - share) * p
        return p


@pytest.mark.parametrize("frequent", [0, 3, 1 << 19])
def test_score_is_the_plain_tree(spark, frequent):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in rows:
        x = body(t)
        for p in range(lm.DEPTH, len(x)):
            for level in range(8):
                for d in range(lm.DEPTH + 1):
                    if not held(i):
                        counts[(level, x[p] >> (8 - level)), x[p - d : p]][x[p] >> (7 - level) & 1] += 1
    memo = {}

    def log10_of(context, byte):
        key = (context, byte)
        if key not in memo:
            ones = [(Plain(counts, (k, byte >> (8 - k))).one(context), byte >> (7 - k) & 1) for k in range(8)]
            memo[key] = sum(math.log10(p if bit else 1 - p) for p, bit in ones)
        return memo[key]

    found = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent, frequent_grams=frequent).collect()}
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    seen = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    for i, t in rows:
        x = body(t)
        assert found[i].score == pytest.approx(sum(log10_of(x[p - lm.DEPTH : p], x[p]) for p in range(lm.DEPTH, len(x))), rel=1e-9)
        assert (found[i].n_known, found[i].n_tokens, found[i].train_tokens) == (sum(seen[w] > 0 for w in words(t)), len(words(t)), n)
        assert found[i].base_score == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), rel=1e-9)


def test_edges(spark):
    schema = "doc_id long, text string, held_out string, key int, log int"
    rows = [(1, "a b", "x", 1, 1), (1, "a b", "x", 1, 1), (None, None, None, None, None), (None, "c", None, None, None), (2, "word " * 30000, "", 0, 0)]
    found = lm.scored(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 5 and all(r.score < 0 and r.base_score < 0 for r in found)
    assert len({(r.score, r.n_tokens) for r in found if r.doc_id == 1}) == 1
    assert lm.scored(spark.createDataFrame([], schema)).collect() == []
    only = lm.scored(spark.createDataFrame([(i, "x y") for i in range(40) if held(i)], "doc_id long, text string")).first()
    assert (only.train_tokens, only.n_known) == (0, 0)
