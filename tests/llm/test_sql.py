"""Each query that SQL can express against its SQL twin, over whole tables of the smallest size and over a table of edge cases."""

import os

import duckdb
import pytest

from corvane.llm import queries

SF = os.environ.get("CORVANE_SF_DIR", "/root/testdata/sf0.001")


def same(v):
    return float(f"{v:.12g}") if isinstance(v, float) else v


def compared(df, result):
    cols = sorted(df.columns)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    ours = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(same(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b] == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    compared(queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name]))


TEXTS = [None, "", " \n\t", "One.", "a b c d", "A B C D e", "été naïve 中文字 한국 😀", "line one here.\nline one here.\nother", "READ MORE | HOME | NEWS | SIGN UP | END", "w " * 300, "x" * 5000]
TEXTS += ["Straße straße strasse " * 6 + "STRASSES naïvetés " * 40 + "naïveté " * 7]
TEXTS += ["Ein Satz, der lang genug ist, um zu bleiben, und noch ein paar Worte mehr hat, damit zwanzig zusammen kommen, ja.\nHier klicken\nTous droits réservés. 2020"] * 2
URLS = [None, "", "no scheme", "http://net", "http://a.net/", "http://EXAMPLE.net/en/1?x", "https://m.example.net/de/#t", "http://b.example.com/de/x", "http://x.org/fr/", "http://x.org/fr", "http://casino-win.example.com/en/1", "a://b://c/d", "http://..net//", "http://x.example.org/en/?/fr/"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, tmp_path, name, empty):
    """Nulls, ties, repeated rows and extra columns whose names clash; and empty tables."""
    docs = [(i % 9 if i else None, t, [None, "en", "de"][i % 3], [None, "a", "b", "c"][i % 4], "x", 1, 2, "k", "w") for i, t in enumerate(TEXTS)]
    pages = [(i if i % 3 else None, u, "h", "p", "r", "v", [None, "", "<p>a", "<p>a", "é"][i % 5]) for i, u in enumerate(URLS + URLS[4:6])]
    vectors = [(i if i % 4 else None, None if i == 5 else [((i * 7 + k) % 11) / 8.0 - 0.5 if i != 6 or k else [None, float("nan")][i % 2] for k in range(64 - (i == 9))], "c", 1) for i in range(40)]
    docs = spark.createDataFrame([] if empty else docs + docs[5:7], "doc_id long, text string, lang string, source string, size string, shard int, cell int, row string, words string")
    pages = spark.createDataFrame([] if empty else pages, "page_id long, url string, host string, path string, rule string, key string, html string")
    vectors = spark.createDataFrame([] if empty else vectors + vectors[10:12], "vec_id long, embedding array<double>, cluster string, distance int")
    con = duckdb.connect()
    for table, df in (("documents", docs), ("pages", pages), ("embeddings", vectors)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    compared(queries.queries()[name](spark, str(tmp_path)), con.execute(queries.oracle_sql()[name]))
