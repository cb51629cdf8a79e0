"""The operators against brute force or the public libraries, on edge cases and the smallest tables."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from corvane.llm import bpe, common, embeddings, html, lm, mixing, quality, sharding, simhash, tokens, urlfilter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = P.path("byte_bpe_50k.tiktoken")
LONG = "word " * 30000
TEXTS = [None, "", " \n\t", "One.", "a b c d", "A B C D", "a b c d", LONG, "été naïve 中文字 한국 😀 İΣς", "x" * 20000, "<|endoftext|> a", "line one here.\nline one here.\nother", "a\u00a0b\u2003c\x1cd", "'s 'LL 12345  \n\n  end "]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `key` int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, repeats, ties, very long texts, and columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4], rows[4], (None, "no id at all", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = df.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    target = brute_targets(dict(sizes))
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    taken = collections.Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == sum(r["by_shard"]) and len(r["by_shard"]) == 8 and min(r["by_shard"]) >= 0
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 16 + len(target) for s in target)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(found) == key(mixing.mix(df.repartition(5)).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_sainte_lague_quotas(spark):
    rng = random.Random(2)
    for m, seats in ((1, 5), (7, 40), (23, 311)):
        votes = [rng.random() ** 3 * 100 for _ in range(m)]
        table = spark.createDataFrame([(i, v * seats / sum(votes)) for i, v in enumerate(votes)], "rank int, target double")
        found = {(r.shard, r["rank"]): r["last"] for r in mixing.shard_quotas(table, 4, 1).collect()}
        heap, seat = [(-v, i, 1) for i, v in enumerate(votes)], [0] * m
        heapq.heapify(heap)
        ends = {math.floor(seats * (j + 1) / 4): j for j in range(4)}
        for h in range(1, seats + 1):
            _, i, k = heapq.heappop(heap)
            seat[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * k + 1), i, k + 1))
            if h in ends:
                assert [found[ends[h], i] for i in range(m)] == seat


def test_token_counts(edge):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in tokens.token_counts(edge.withColumnRenamed("size", "n_tokens"), P.path("word_bpe_49k.json")).collect():
        text = TEXTS[r.doc_id] if r.doc_id is not None else "no id at all"
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 2048)


def brute_fingerprint(text, k=3):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = list(range(len(ids)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return [ids[find(i)] for i in range(len(ids))]


def test_simhash(edge, docs):
    for df in (docs, edge.where("doc_id is not null").distinct()):
        rows = df.collect()
        fps = [brute_fingerprint(r.text) for r in rows]
        component = brute_components([r.doc_id for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)  # noqa: B023
        found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(df).collect()}
        assert found == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, component, strict=True)}
    assert simhash.components(edge).count() == edge.count() and simhash.components(edge.limit(0)).count() == 0


def test_exact_shards_lose_no_link(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(5)]
    values = list(dict.fromkeys(v - (1 << 64) if v >> 63 else v for v in values))
    links = simhash.exact_links(spark.createDataFrame(list(zip(values, range(len(values)), strict=True)), "fp long, rep long")).collect()
    root = brute_components(list(range(len(values))), lambda i, j: ((values[i] ^ values[j]) & ((1 << 64) - 1)).bit_count() <= 2)
    pairs = {(r.u, r.v) for r in links}
    assert brute_components(list(range(len(values))), lambda i, j: (i, j) in pairs or (j, i) in pairs) == root


def test_near_deduplicated(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(20):
        base = text(300)
        copies = [base, base, base[:150] + ["changed"] + base[151:], base[:-2]]
        groups.append([len(rows) + i for i in range(len(copies))])
        rows += [(len(rows) + i, " ".join(c)) for i, c in enumerate(copies)]
    alone = [(1000 + i, " ".join(text(200))) for i in range(60)]
    kept = {r.doc_id for r in simhash.near_deduplicated(spark.createDataFrame(rows + alone, "doc_id long, text string")).collect()}
    assert {i for i, _ in alone} <= kept
    assert sum(g[0] in kept for g in groups) == 20 and len(kept) - 60 <= 22


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {p + k for ps in seen.values() if len(ps) > 1 for p in ps for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(edge, docs):
    for df in (edge, docs):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.judged(df).collect():
            base = brute_quality(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
            assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judged(docs).join(labels, "doc_id").where("n_words >= 20").collect()
    assert all(r.kept for r in rows if r.quality == 1) and not any(r.kept for r in rows if r.quality == 0)
    assert quality.cleaned(docs).columns == docs.columns


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([b + 0.25 * rng.standard_normal((4, 16)) for b in base])
    vectors = [v.tolist() for v in np.concatenate((base, near, base[:5]))]
    bad = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate(vectors + bad)]
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, 0)
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = (cos >= 0.9).sum(axis=1)
    ours = np.array([found[i].n_links for i in range(len(vectors))])
    assert len(found) == len(rows) and (ours <= links).all() and ours.sum() >= 0.97 * links.sum()
    for i in range(len(vectors), len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://net", "http://a.net/", "http://EXAMPLE.net/en/1?x", "https://m.example.net/de/#t", "http://b.example.com/de/x", "http://example.com/dex", "http://x.org/fr/", "http://x.org/fr", "http://casino-win.example.com/en/1", "http://netx/", "a://b://c/d", "http://..net//", "http://x.example.org/en/?/fr/"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for r in urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect():
        url = urls[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if "://" in url else ""
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[1])
        assert r.verdict == (fit[2] if fit else "block" if "casino-win" in host else "allow")


def test_cascade_is_exact(spark):
    universe = [f"k{i}" for i in range(3000)]
    listed = universe[::30]
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    cascade = urlfilter.build(spark, frame(listed), frame(universe))
    assert len(cascade.levels) > 1 and [k for k in universe if cascade.lists(k)] == listed


def test_bpe(edge):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in bpe.round_trips(edge, RANKS, P.PATTERN, with_ids=True).collect():
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "no id at all") or ""
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_utf8_machine():
    data = "aé中😀z".encode() + b"\xff\xc3\x28"
    for step in (1, 2, 3, 5):
        machine = bpe.Utf8()
        assert "".join(machine.feed(data[i : i + step]) for i in range(0, len(data), step)) + machine.end() == data.decode("utf-8", "replace")


def test_lm(docs, edge):
    rows = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    counts = collections.Counter(w for r in rows if not held(r.doc_id) for w in low(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in lm.scored(docs, frequent=100).collect():
        text = low(next(x.text for x in rows if x.doc_id == r.doc_id))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(text), sum(counts[w] > 0 for w in text), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in text), rel=1e-9)
        assert r.score < 0
    assert lm.scored(edge).count() == edge.count() and lm.scored(edge.limit(0)).count() == 0


def test_context_rows_are_distributions():
    rng = np.random.default_rng(6)
    counts = np.zeros((4, 256))
    counts[3] = rng.integers(0, 3, 256)
    counts[1], counts[2] = counts[3] + rng.integers(0, 5, 256), rng.integers(0, 4, 256)
    counts[0] = counts[1] + counts[2] + 1
    table = lm.weighted(counts, np.array([0, 1, 1, 2]), np.array([0, 0, 0, 1]))
    assert (10.0**table).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_lm_keeps_every_context(spark):
    """More contexts than 16,384; the rare ones count like others, whatever is broadcast."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(500))) for i in range(40)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    body = {i: b"\n" * 4 + b" ".join(t.encode().lower().split()) + b"\n" for i, t in rows}
    seen = collections.Counter((d, x[p - d : p], x[p]) for i, x in body.items() if not held(i) for p in range(4, len(x)) for d in range(5))
    row = {c: k for k, c in enumerate(sorted({(d, c) for d, c, _ in seen}))}
    assert len(row) > 1 << 14
    counts = np.zeros((len(row), 256), dtype=np.float32)
    for (d, c, b), n in seen.items():
        counts[row[d, c], b] = n
    table = lm.weighted(counts, np.array([d for d, _ in row]), np.array([row[d - 1, c[1:]] if d else 0 for d, c in row]), 32)
    deepest = lambda c: next(row[d, c[4 - d :]] for d in range(4, -1, -1) if (d, c[4 - d :]) in row)
    for most in (1 << 20, 500, 0):
        for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), frequent_grams=most).collect():
            x = body[r.doc_id]
            assert r.score == pytest.approx(sum(float(table[deepest(x[p - 4 : p]), x[p]]) for p in range(4, len(x))), rel=1e-5)


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div class="cookie-notice">We use cookies, really, all the time.</div><div class=ad>Buy, now!</div><!-- x <p>no</p> --><article><h1>Head &amp; line</h1><p>One  <b>bold</b>&nbsp;text,
    here.<p>Two<br>lines.<aside>Aside.</aside><ul><li>Item</li></ul></article><section id="comments"><p>A long comment, with many words, that is not the article, at all.</p></section>
    <form><p>Name</p></form><footer>&copy; Us</footer></body></html>"""
    assert html.main_text(page) == "Head & line\n\nOne bold text, here.\n\nTwo lines.\n\nItem"
    assert html.main_text("") == "" and html.main_text("plain &lt; text\n here") == "plain < text here"
    plain = "<html><body><div class='menu'><a>x</a></div><div><h2>T</h2><p>Some long text, with points.</p><p>Short</p></div><div><a href=/>more</a></div></body></html>"
    assert html.main_text(plain) == "T\n\nSome long text, with points.\n\nShort"
    rows = spark.createDataFrame([(1, "u", None), (2, None, "<p>a</p>"), (3, "u", "<p")], "page_id int, url string, html string")
    assert [(r.text, r.n_chars) for r in html.extracted(rows).orderBy("page_id").collect()] == [("", 0), ("a", 1), ("", 0)]
    assert html.main_text("<p>x</p>" * 20000).count("x") == 20000


def test_html_keeps_short_sections_of_an_article():
    long = "Long text, with points, and more of it. " * 40
    page = f"<article><h1>Head</h1><div class=lead><p>Short lead</p></div><div class=text><p>{long}</p></div><div class=links><a href=/>Other pages</a></div><div class=end><p>The end.</p></div></article>"
    assert html.main_text(page) == f"Head\n\nShort lead\n\n{long.strip()}\n\nThe end."
    assert html.main_text("<p>One.</p><svg/><p>Two.</p><math display='block' /><p>Three.</p>") == "One.\n\nTwo.\n\nThree."
    assert html.main_text("<p>One.</p><svg><text>no</text></svg><p>Two.</p>") == "One.\n\nTwo."


def test_sharding(edge, docs):
    for df in (edge, docs, docs.limit(5)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        rows = sharding.sharded(df).collect()
        assert len(rows) == df.count()
        counts = collections.Counter(r.shard for r in rows)
        assert max(counts[s] for s in range(8)) - min(counts[s] for s in range(8)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        for r in rows:
            data = texts[r.doc_id].encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert sharding.sharded(edge.limit(0)).count() == 0


def test_hilbert_curve_steps_by_one():
    cells = sorted(((a, b, c) for a in range(8) for b in range(8) for c in range(8)), key=lambda x: sharding.hilbert_index(x, 3))
    assert all(sum(abs(p - q) for p, q in zip(x, y, strict=True)) == 1 for x, y in zip(cells, cells[1:], strict=False))


def test_pipeline(spark, docs):
    import corpus_pipeline

    stage, seen = docs, []
    for _, f in corpus_pipeline.STAGES:
        stage = common.written(f(spark, stage, SF), "test")
        seen.append(stage)
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {r.doc_id for r in seen[0].collect()} == kept and all(s.columns == docs.columns for s in seen[:3])
    assert {r.doc_id for r in seen[2].collect()} <= {r.doc_id for r in seen[1].collect()} <= kept
    assert corpus_pipeline.run(spark, SF).count() == seen[2].count()


def test_memo_is_bounded_with_the_states():
    """A transducer of few states has a small memo, and the same ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    small, usual = (bpe.Encoder(path, public_tokenizers.PATTERN, *most) for most in ((50,), ()))
    text = " ".join(f"word{i * 7919 % 1000}x" for i in range(2000))
    assert small.encode(text) == usual.encode(text)
    memo = small.ids_of.__self__
    assert len(memo) <= 100 and len(memo.older) <= 100 < len(usual.ids_of.__self__)
