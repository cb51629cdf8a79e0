"""Near-duplicates of whole texts against brute force on shingle sets: recall, precision, large groups, and edge cases."""

import collections
import random

import pytest

from corvane.llm import simhash

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts, similarity=0.8):
    """Each text's group, by the links of all pairs, and those links."""
    sets = [shingle_set(t) for t in texts]
    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {""}:
            at[x].append(i)
    pairs = {(j, i) for own in at.values() if len(own) > 1 for i in own for j in own if j < i}
    links = {(j, i) for j, i in pairs if jaccard(sets[i], sets[j]) >= similarity}
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for j, i in sorted(links):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], links


def changed(words, share, rng):
    """The text with so many of its words replaced, in one run, so that about `share` of all shingles are common."""
    out = list(words)
    n = round((1 - share) / (1 + share) * len(words))
    at = rng.randrange(len(words) - n - 4)
    out[at : at + max(1, n - 4)] = [f"new{rng.randrange(10**9)}" for _ in range(max(1, n - 4))]
    return out


def planted(rng, pairs=300):
    rows = []
    for k in range(pairs):
        words = [f"w{rng.randrange(20000)}" for _ in range(rng.choice((60, 150, 400)))]
        rows += [" ".join(words), " ".join(changed(words, rng.uniform(0.7, 0.95), rng))]
    return rows


def test_plan_reaches_the_recall():
    for n in (1000, 10**6, 10**9):
        width, weak, radius = simhash.plan(n, 0.8, 0.9)
        assert 28 <= width <= 32 and weak < 7 and 60 <= radius <= 75
    assert simhash.plan(10**9, 0.8, 0.9)[0] > simhash.plan(10**6, 0.8, 0.9)[0]


def test_recall_and_precision(spark):
    texts = planted(random.Random(4))
    want, links = brute_groups(texts)
    assert 100 < len(links) < 300
    found = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hit = sum(found[i] == found[j] for j, i in links)
    assert hit >= 0.93 * len(links)
    assert all(want[i] == want[found[i]] for i in found)  # nothing is linked that brute force doesn't link


def test_large_group_of_near_copies(spark):
    """Near copies of one text, in keys that are cut into pairs of blocks: one of them stays."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copies = [" ".join(base[:k] + [f"x{i}"] + base[k + 1 :]) for i, k in enumerate(rng.choices(range(200), k=300))]
    others = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_deduplicated(docs, block=32).collect()}
    assert kept == {0} | set(range(300, 600))


def test_large_keys_are_cut_into_pairs_of_blocks(spark):
    """Classes that share a block meet in small shards, and each two of them in one at least."""
    rng = random.Random(10)
    classes = spark.createDataFrame([(i, bytes(48), [77] + [rng.getrandbits(28) for _ in range(7)], [0, 1] * 8) for i in range(90)], "rep long, fp binary, blocks array<long>, weak array<int>")
    met = simhash.shared_keys(classes, 2, 28)
    shards = simhash.weak_shards(classes, met, 16).collect()
    assert len({r.key for r in shards}) == 4
    assert max(len(r.members) for r in shards) <= 60
    met = {(a.rep, b.rep) for r in shards for a in r.members for b in r.members}
    assert {(a, b) for a in range(90) for b in range(90)} <= met


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want, links = brute_groups([r.text for r in rows])
    found = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert sum(found[rows[i].doc_id] == found[rows[j].doc_id] for j, i in links) >= 0.95 * len(links)
    group = {r.doc_id: rows[w].doc_id for r, w in zip(rows, want, strict=True)}
    assert all(group[i] == group[g] for i, g in found.items())


@pytest.mark.parametrize("column", ["map<string,int>", "int"])
def test_edges(spark, column):
    long = "word and " * 20000
    texts = [(1, "a b c d e f"), (2, "A  b c d E f"), (3, None), (4, ""), (5, " \n"), (None, "a b c d e f"), (None, "z"), (6, long), (7, long + "x"), (8, "one"), (8, "two"), (9, "three"), (9, "three")]
    rows = [(i, t, "u", "f", None) for i, t in texts]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, uid string, fp string, `group` {column}")
    out = simhash.near_deduplicated(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 6, 7, 8, 9] and kept.count(None) == 2
    assert simhash.near_deduplicated(docs.limit(0)).collect() == []
    groups = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs).collect() if r.doc_id}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9}


def test_no_link_is_lost(spark):
    """Pairs just above the threshold, which keys and radius miss in part."""
    rng = random.Random(12)
    texts = []
    for _ in range(300):
        words = [f"w{rng.randrange(20000)}" for _ in range(rng.choice((12, 40, 150)))]
        texts += [" ".join(words), " ".join(changed(words, rng.uniform(0.78, 0.84), rng))]
    want, links = brute_groups(texts)
    assert len(links) > 50
    found = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_sets_stay_in_their_buckets(spark):
    """Verifying moves links, and the sets of a link's first end: no whole table of sets is shuffled."""
    import numpy as np

    from corvane.llm.common import bucketed

    sets = [np.arange(i // 2 * 100, i // 2 * 100 + 50 + i % 2, dtype=np.int64).tobytes() for i in range(40)]
    found = bucketed(spark.createDataFrame(list(enumerate(sets)), "uid long, shingles binary").repartition(4, "uid"), "sets", "uid", 4)
    links = spark.createDataFrame([(i + 1, i) for i in range(39)], "u long, v long")
    good = simhash.verified(links, found, 0.8)
    assert {tuple(r) for r in good.collect()} == {(i + 1, i) for i in range(0, 39, 2)}
    plan = good._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    initial = plan[plan.find("Initial Plan") :]
    assert len(scans) >= 2 and all("Bucketed: true" in line for line in scans)
    assert initial.count("Exchange hashpartitioning") == 2


def test_parity_sketches_never_differ_in_more_than_the_sets(spark):
    """Pairs around the threshold, of sizes on both sides of a power of two and far apart: what is similar enough stays, what is unrelated goes."""
    import numpy as np

    from corvane.llm.common import bucketed

    rng = np.random.default_rng(3)
    sets, links, similar, unrelated = [], [], set(), set()
    for n in (1, 2, 7, 60, 64, 65, 120, 130, 500, 1024, 1100, 5000):
        base = np.unique(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))
        for common in (1.0, 0.95, 0.889, 0.85, 0.5, 0.0):
            kept = base[: round(common * len(base))]
            other = np.unique(np.concatenate([kept, rng.integers(-(2**63), 2**63 - 1, len(base) - len(kept), dtype=np.int64)]))
            for b in (other, kept[: max(1, len(kept) - len(kept) // 50)] if len(kept) else other):
                pair = (len(sets), len(sets) + 1)
                sets += [base, b]
                links.append(pair)
                shared = len(np.intersect1d(base, b))
                if shared >= 0.8 * (len(base) + len(b) - shared) - 1e-9:
                    similar.add(pair)
                if n >= 60 and common <= 0.5 and len(b) > 0.8 * len(base):
                    unrelated.add(pair)
    rows = [(i, len(s), simhash.parities(s)) for i, s in enumerate(sets)]
    found = bucketed(spark.createDataFrame(rows, "uid long, size int, sketch array<long>").repartition(4, "uid"), "sets", "uid", 4)
    kept = {tuple(r) for r in simhash.possible(spark.createDataFrame(links, "u long, v long"), found, 0.8).collect()}
    assert len(similar) > 40 and similar <= kept
    assert len(unrelated) > 15 and not unrelated & kept


def test_texts_with_a_common_passage_move_no_sets(spark, monkeypatch):
    """Texts that share rare shingles only meet in the exact pass, but go before their sets are moved."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(40):
        passage = [word() for _ in range(20)]
        texts += [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)]) for _ in range(2)]
    moved, own = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda links, *rest: moved.append(links.count()) or own(links, *rest))
    groups = simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.doc_id == r.group_id for r in groups)
    assert len(moved) == 3 and moved[-1] == 0


def test_sets_are_handed_on_in_parts(spark, monkeypatch):
    """Results are the same however few bytes of sets a task's Python holds."""
    rows = [(i, f"a{i // 2} b c d e f{i // 2} g h") for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(simhash, "HELD", 1)
    found = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert found == {i: i // 2 * 2 for i in range(41)}
