"""Near spellings of a dictionary's names against a plain loop over all of them."""

import random
from difflib import SequenceMatcher

import pytest

from corvane.operators import dictionaries
from corvane.plans.queries import QUERIES, read

SF = "/root/testdata/sf0.001"


def plain(tokens, names, least):
    """names in the order of their places."""
    found = {}
    for token in tokens:
        best, score = None, 0
        for name in names:
            own = round(SequenceMatcher(None, token, name).ratio() * 100)
            if own > score:
                best, score = name, own
        if score >= least and best != token:
            found[token] = (best, score)
    return found


def edited(chance, word, letters):
    for _ in range(chance.randint(0, 3)):
        at = chance.randint(0, len(word))
        word = word[:at] + chance.choice(["", chance.choice(letters)]) + word[at + chance.randint(0, 1) :]
    return word


@pytest.mark.parametrize("least", [88, 75])
def test_equals_a_plain_loop(spark, least):
    chance = random.Random(least)
    letters = "abcшéß𝛼"
    names = list(dict.fromkeys("".join(chance.choices(letters, k=chance.randint(1, 22))) for _ in range(150)))
    tokens = {edited(chance, chance.choice(names), letters) for _ in range(500)} - {""}
    df = spark.createDataFrame([(t,) for t in tokens] * 2 + [(None,), ("",)], "t string")
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(names[3], 900), (None, 1), ("", 2)], "n string, p int")
    rows = dictionaries.nearly(df, "t", known, "n", "p", least).collect()
    assert len(rows) == len({r.token for r in rows}) and {r.token: (r.name, r.score) for r in rows} == plain(tokens, names, least)
    assert len(rows) > 100 and dictionaries.nearly(df, "t", known.limit(0), "n", "p").count() == 0 == dictionaries.nearly(df.limit(0), "t", known, "n", "p").count()


def test_query(spark):
    import regex

    docs = {}
    for row in read(spark, SF, "documents").collect():
        for word in set(regex.findall(r"\p{L}{4,}", (row.text or "").lower())):
            docs[word] = docs.get(word, 0) + 1
    rows = QUERIES["x17_near_names"](spark, SF).collect()
    chance = random.Random(5)
    rare = sorted(w for w, n in docs.items() if n < 20)
    names = [w for w, n in docs.items() if n >= 20]
    found = {r.token: r for r in rows}
    for token in chance.sample(rare, min(400, len(rare))):
        scores = {n: round(SequenceMatcher(None, token, n).ratio() * 100) for n in names}
        best = max(scores.values(), default=0)
        assert (token in found) == (best >= 88)
        if token in found:
            ties = [n for n, s in scores.items() if s == best]
            assert found[token].score == best and docs[found[token].name] == max(docs[n] for n in ties)
    assert rows and len(rows) == len(found)


def test_slips_are_found_as_by_comparing_every_name():
    """best_match leaves out what can't reach the threshold, and finds what a plain loop finds."""
    from corvane.functions import aliases

    rng, names = random.Random(3), aliases.choices()
    tokens = [n[:k] + rng.choice("aeix") + n[k + 1 :] for n in names for k in (0, len(n) // 2)] + names + ["", "zzzzzzzz"]
    tried = aliases.matchers(names)
    for token in tokens:
        want, score = None, 87
        for name in names:
            if (own := round(SequenceMatcher(None, token, name).ratio() * 100)) > score:
                want, score = name, own
        assert aliases.best_match(token, tried, 88) == (want, score)


def test_words_meet_only_names_that_they_have_enough_in_common_with(spark):
    """Words of few syllables share pieces with most names, and keys with those alone that are near enough."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = step(row, x, b)
        return row[-1]

    def step(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        return new

    chance = random.Random(8)
    words = sorted({"".join(chance.choices(["ba", "ko", "li", "na", "ter", "s"], k=chance.randint(4, 6))) for _ in range(150)})
    words = [w for w in words if len(w) <= 12]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    met = dictionaries.keyed(df, 0, 88).join(dictionaries.keyed(df.withColumnRenamed("w", "name"), 1, 88), "key").select("w", "name").distinct().collect()
    assert {(r.w, r.name) for r in met} == {(a, b) for a in words for b in words if 200 * common(a, b) >= 87.5 * (len(a) + len(b))}
    share = lambda n: max(len(dictionaries.kept(c[2], c[3])) for c in dictionaries.cuts(n, n, 88)[0])
    assert len(words) > 50 and all(share(n) <= dictionaries.MOST_KEYS for n in range(1, 60))


def test_the_driver_gets_no_keys_and_no_names(spark):
    """Keys are many times the names that Spark sizes them by: joins of them are merges, however few the names."""
    df = spark.createDataFrame([(w,) for w in ("leaching", "leachin", "flotatoin", "zzz")], "t string")
    known = spark.createDataFrame([("leaching", 0), ("flotation", 1)], "n string, p int")
    found = dictionaries.nearly(df, "t", known, "n", "p")
    assert {(r.token, r.name) for r in found.collect()} == {("leachin", "leaching"), ("flotatoin", "flotation")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and plan.count("SortMergeJoin") and "Broadcast" not in plan
