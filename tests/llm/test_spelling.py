"""Spelling variants against brute force: counts, near words with and without crowded halves, forms and roots."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import spelling


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, slips):
    out = Counter()
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            out[run if not slips or h % slips else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    out.pop("", None)
    return out


def expected(counts, least_length=6, least_count=5, times=5):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    rows = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if distance_one(w, v)]
        form = min(near)[1] if near and -min(near)[0] >= times * n else None
        rows[w] = [form, None, n, len(near), words[form] if form else None]
    for w, row in rows.items():
        at = w
        while rows[at][0]:
            at = rows[at][0]
        row[1] = at
    return {w: tuple(r) for w, r in rows.items()}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@settings(max_examples=500, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == distance_one(a, b)


@pytest.mark.parametrize("few", [0, 2, 16])
@settings(max_examples=60, deadline=None)
@given(words=st.lists(st.text("ab", min_size=6, max_size=9), unique=True, max_size=60))
def test_one_shard(few, words):
    """Every word meets each near word once, whichever halves they share, compared one by one or looked up."""
    spelling.FEW = few
    owners = [(side, w[len(w) // 2 :] if side else w[: len(w) // 2], w, 1) for w in words for side in (0, 1)]
    machine = spelling.automaton(owners) if owners else None
    for w in words:
        assert sorted(v for v, _ in spelling.near_in(machine, w)) == sorted(v for v in words if distance_one(w, v))


TEXTS = ["Strasse straße STRASSE strasse", "naïvely naivety ÀÉÎõü× ÷÷÷÷÷÷", "x" * 3_000_000, "wordd " * 400_000, "", None, " \n1234", "日本語 Wörter worter wörter", "co-operate's d'abord"]


@pytest.mark.parametrize("slips", [0, 3])
def test_counts(spark, slips):
    """Long texts and long runs are cut at no letter; null ids and texts, empty texts and repeated rows."""
    rows = [(i if i else None, t, "w", 1) for i, t in enumerate(TEXTS + TEXTS[:2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.word_counts(df, slips).collect()} == dict(counted([r[:2] for r in rows], slips))


@pytest.mark.parametrize("most_owners", [512, 3, 1])
def test_variants(spark, most_owners):
    """A vocabulary in which half of the words share a half: automata and masked rests find the same links."""
    import random

    chance = random.Random(5)
    base = ["".join(chance.choice("abc") for _ in range(chance.randint(6, 9))) for _ in range(60)] + ["prefix" + "".join(chance.choice("ab") for _ in range(chance.randint(1, 7))) for _ in range(80)]
    rows = [(i, " ".join([w] * chance.choice([5, 7, 30, 200, 1100]))) for i, w in enumerate(base)] + [(1, "abcabc " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.variants(df, most_owners=most_owners)) == expected(counted(rows, 0))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(spelling.variants(docs, slips=199)) == expected(counted(rows, 199))


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string, root string")).collect() == []


def test_chains(spark):
    """Forms of forms: the root is the last of a long chain."""
    words = ["aaaaaaaa", "baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    df = spark.createDataFrame([(w, w2) for w, w2 in zip(words, words[1:], strict=False)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(df).collect()} == dict.fromkeys(words[:-1], words[-1])
