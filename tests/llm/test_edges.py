"""Every operator and every pipeline stage on empty tables, nulls, repeated rows, long texts and columns whose names clash; tokens against the libraries."""

import gc
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import bpe, mixing, quality, queries, sharding, simhash, tokens, urlfilter

SF = "/root/testdata/sf0.001"
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, uid string, `row` string, size int, bucket string, target double, taken int, turn int, rank int, cell int, mark string, fp int, rep int, new string, words string, keep boolean"
LONG = "the long text goes on and on, as it must.\n" * 4000
GOOD = "A sentence, which is long enough to be kept by every rule, has at least twenty words in it, and it ends here, at last."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, GOOD), (1, GOOD), (2, GOOD + " More."), (None, GOOD), (None, None), (3, ""), (4, " \n\t"), (5, "one"), (6, LONG), (7, "é中😀 " * 30), (8, GOOD + "\nREAD | MORE | HERE | NOW")]
    rest = ("u", "r", 1, "b", 1.0, 1, 1, 1, 1, "m", 1, 1, "n", "w", True)
    rows = [(i, t, [None, "en"][k % 2], [None, "a", "b"][k % 3], None if t is None else len(t), *rest) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op5_embeddings", "op6_urls", "op9_html", "op11_spelling", "op12_warc", "op13_centroids")])
def test_operators(spark, docs, tmp_path, name):
    docs.coalesce(2).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    found = queries.queries()[name](spark, f"{tmp_path}/some")
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(r.doc_id) for r in docs.collect())
    empty = queries.queries()[name](spark, f"{tmp_path}/none")
    assert empty.collect() == [] and empty.schema == found.schema


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, docs, stage):
    out = stage(spark, docs.limit(0), SF)
    assert out.collect() == []
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns


def test_cleaned(docs):
    rows = quality.cleaned(docs).collect()
    kept = sorted((str(r.doc_id), r.text) for r in rows)
    assert [i for i, _ in kept] == ["1", "1", "2", "8", "None"] and dict(kept)["8"] == GOOD  # the menu line goes
    assert all(r.n_chars == len(r.text) and r["row"] == "r" and r.keep for r in rows)


def test_near_deduplicated(docs):
    rows = simhash.near_deduplicated(docs).collect()
    ids = sorted(str(r.doc_id) for r in rows)
    assert ids == ["1", "3", "5", "6", "7", "8", "None", "None"] or ids == ["1", "2", "3", "5", "6", "7", "8", "None", "None"]
    assert all(r["row"] == "r" for r in rows)


def test_mixed_documents(docs):
    """Rows are taken as often as their words are, to the nearest whole; equal rows share what the mix takes of them all."""
    taken = mixing.mix(docs).collect()
    want = sum(round((r["taken"] + 1e-9) / r["size"]) for r in taken if r["size"])
    rows = mixing.mixed_documents(docs).collect()
    assert len(rows) == want and all(r.text and r.uid == "u" for r in rows)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_whole_table_counts_tokens_like_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in tokens.token_counts(spark.read.parquet(f"{SF}/documents.parquet"), WORDS).collect():
        n = len(library.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(rows[r.doc_id].encode()), n > 2048)


def test_whole_table_is_encoded_like_the_library(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trips(docs, RANKS, P.PATTERN, with_ids=True).collect():
        assert r.ids == library.encode_ordinary(rows[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    before = gc.get_threshold()
    own = bpe.encoder(RANKS, P.PATTERN)
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text) and "".join(own.decode(ids)) == text and gc.get_threshold() == before


def test_url_lists_in_parts(spark):
    """A list beyond the bound is split by hash; the verdicts are those of one cascade. Null ids, repeats and clashing names are judged each."""
    rows = [(i if i % 7 else None, f"http://h{i % 60}.example.com/p{i % 5}/x", "k", "f") for i in range(300)] + [(1, None, "k", "f"), (2, "http://a.net/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, found string")
    listed = spark.createDataFrame([(f"h{i}.example.com/",) for i in range(0, 60, 3)] + [("h1.example.com/p1/",), (None,)], "key string")
    key = lambda df: sorted(map(str, df.collect()))
    one, many = urlfilter.judged(pages, unwanted=listed), urlfilter.judged(pages, unwanted=listed, most_bits=64)
    assert key(one) == key(many)
    for r in one.collect():
        n = int(r.host[1:].split(".")[0]) if r.host.startswith("h") else None
        assert r.verdict == ("block" if r.rule == "net/" or (n is not None and (n % 3 == 0 or (n == 1 and r.path.startswith("/p1/")))) else "allow")
    assert urlfilter.judged(pages.limit(0), unwanted=listed).collect() == []


def test_curve_files_prune(spark):
    """Files cut along the curve have narrow ranges of source and language: a query on both reads a few of them, unlike files by order of arrival."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(docs, 64).collect()}
    rows = docs.select("doc_id", "source", "lang").collect()
    by_curve, by_arrival = {}, {}
    for i, r in enumerate(sorted(rows, key=lambda r: r.doc_id)):
        by_curve.setdefault(cells[r.doc_id][0], []).append((r.source or "", r.lang or ""))
        by_arrival.setdefault(i * 64 // len(rows), []).append((r.source or "", r.lang or ""))

    def read(files, source, lang):
        return sum(all(min(x[k] for x in f) <= v <= max(x[k] for x in f) for k, v in enumerate((source, lang))) for f in files.values())

    asked = {(r.source or "", r.lang or "") for r in rows}
    assert sum(read(by_curve, *a) for a in asked) < 0.4 * sum(read(by_arrival, *a) for a in asked)


PROSE = ["She would read more at night.", "They had to log in to the old mill.", "Sign up sheets were kept by the clerk of the town for years.", " ".join(f"शब्द{i}" for i in range(25)) + " ।"]
NOT_PROSE = ["READ MORE", "» Click here", "Subscribe to our newsletter", "Home | News | About", " ".join(f"word{i}" for i in range(25))]


def test_lines(spark):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(x,) for x in PROSE + NOT_PROSE], "line string")
    fails = {r.line: r.f for r in lines.select("line", quality.line_fails(F.col("line")).alias("f")).collect()}
    assert [x for x in PROSE if fails[x]] == [] and [x for x in NOT_PROSE if not fails[x]] == []
