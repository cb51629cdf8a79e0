"""Queries of office documents and archives made out of the test tables, and of rows that other queries only use inside."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import evidence, extract, quantities, text, verify
from corvane.operators import patterns, ranking, retrieval, state, storage
from corvane.plans.extraction import FOUND, NOTE, NOTES, notes
from corvane.plans.graphs import BASE, LEVELS, graph
from corvane.plans.queries import COSINE_SQL, QUERY_VECTOR, TOKENS_SQL, query, read
from corvane.plans.search import CODES, asks
from corvane.sources import files, packages

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SLIDE = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def packed(spark: SparkSession, sf_dir: str, end: str, entries) -> DataFrame:
    """A file for each part: entries(name, size) gives its archive's parts."""

    @F.pandas_udf("binary")
    def content(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, sizes in parts:
            out = []
            for name, size in zip(names, sizes, strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as archive:
                    for path, data in entries(name, size).items():
                        archive.writestr(path, data)
                out.append(buffer.getvalue())
            yield pd.Series(out)

    rows = read(spark, sf_dir, "part").select("p_partkey", content("p_name", "p_size").alias("content"))
    return rows.select(F.concat(F.col("p_partkey").cast("string"), F.lit(end)).alias("path"), "content")


def spans_of(made: DataFrame) -> DataFrame:
    docs = files.documents(files.normalised(made))
    rows = docs.select(F.substring_index("path", ".", 1).cast("long").alias("p_partkey"), F.posexplode("spans").alias("i", "s"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("i"), F.col("s.page").alias("page"), F.col("s.start_offset").alias("start_offset"), F.col("s.text").alias("text"))


def word_parts(name: str, size: int) -> dict[str, str]:
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:t> {name} </w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell('size')}{cell('x')}</w:tr><w:tr>{cell(size)}{cell('')}</w:tr></w:tbl>"
    return {"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>"}


def slide_parts(name: str, size: int) -> dict[str, str]:
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda t: f"<p:sld {SLIDE}><p:cSld><p:spTree>{shape(t)}</p:spTree></p:cSld></p:sld>"
    return {"ppt/slides/slide1.xml": slide(name), "ppt/slides/slide2.xml": slide(size)}


@query("""SELECT p_partkey, 0 AS i, 1 AS page, 0 AS start_offset, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, 1, length(p_name) + 2, 'size | x' FROM part UNION ALL SELECT p_partkey, 2, 1, length(p_name) + 12, trim(p_size || ' | ') FROM part""")
def sc03_word_documents(spark, sf_dir):
    return spans_of(packed(spark, sf_dir, ".docx", word_parts))


@query("SELECT p_partkey, 0 AS i, 1 AS page, 0 AS start_offset, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, 2, length(p_name) + 2, CAST(p_size AS VARCHAR) FROM part")
def sc04_slides(spark, sf_dir):
    return spans_of(packed(spark, sf_dir, ".pptx", slide_parts))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'zip_entry_limit_exceeded:' || p_partkey || '.zip' ELSE p_name END AS found FROM part UNION ALL SELECT p_partkey, 'nested_zip_unsupported:in/b.zip' FROM part WHERE p_size <= 40""")
def sc09_archives(spark, sf_dir):
    made = packed(spark, sf_dir, ".zip", lambda name, size: {"in/a.txt": name, "in/b.zip": "x", **({f"{i}.txt": "y" for i in range(3)} if size > 40 else {})})
    normal = files.normalised(made, most_entries=3)
    key = F.substring_index("path", ".", 1).cast("long").alias("p_partkey")
    return files.documents(normal).select(key, F.col("content").alias("found")).unionByName(files.warnings(normal).select(key, F.col("warning").alias("found")))


#: The objects of a file of two pages whose font's codes are UTF-16; a page of text and one with a ruled table of two rows follow as 8 and 7.
TO_UNICODE = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
PDF_OBJECTS = [
    "<</Type/Catalog/Pages 2 0 R>>",
    "<</Type/Pages/Count 2/Kids[3 0 R 4 0 R]/Resources<</Font<</F1 5 0 R>>>>>>",
    "<</Type/Page/Parent 2 0 R/Contents 8 0 R>>",
    "<</Type/Page/Parent 2 0 R/Contents 7 0 R>>",
    "<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/DW 500>>]/ToUnicode 6 0 R>>",
    f"<</Length {len(TO_UNICODE)}>>\nstream\n{TO_UNICODE}\nendstream",
]
RULES = " ".join([f"50 {y} m 1250 {y} l" for y in (100, 120, 140)] + [f"{x} 100 m {x} 140 l" for x in (50, 650, 1250)])


def pdf_of(text: Column, cells: list[Column], damaged: Column) -> Column:
    """A PDF of a text, a line of the page for each of its lines, and of a table's cells; without its cross references if it is to be damaged."""
    coded = lambda c: F.concat(F.lit("<"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">"))
    stream = lambda number, body: F.concat(F.lit(f"{number} 0 obj <</Length "), F.length(body).cast("string"), F.lit(">>\nstream\n"), body, F.lit("\nendstream endobj\n"))
    head, places = "%PDF-1.4\n", []
    for number, body in enumerate(PDF_OBJECTS, start=1):
        places.append(len(head))
        head += f"{number} 0 obj {body} endobj\n"
    places.append(len(head))
    at = [(55, 126), (655, 126), (55, 106), (655, 106)]
    table = F.concat(F.lit(f"{RULES} S BT /F1 10 Tf"), *[F.concat(F.lit(f" 1 0 0 1 {x} {y} Tm "), coded(c), F.lit(" Tj")) for (x, y), c in zip(at, cells, strict=True)], F.lit(" ET"))
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(coded(line), F.lit(" Tj T*"))), "\n")
    page = F.concat(F.lit("BT /F1 10 Tf 14 TL 50 800 Td\n"), lines, F.lit("\nET"))
    before = F.concat(F.lit(head), stream(7, table))
    body = F.concat(before, stream(8, page))
    entries = F.concat(F.lit("xref\n0 9\n0000000000 65535 f \n" + "".join(f"{p:010} 00000 n \n" for p in places)), F.lpad(F.length(before).cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    trailer = F.lit("trailer <</Size 9/Root 1 0 R>>\n")
    return F.when(damaged, F.concat(body, trailer)).otherwise(F.concat(body, entries, trailer, F.lit("startxref\n"), F.length(body).cast("string"), F.lit("\n%%EOF"))).cast("binary")


LAID_OUT = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\f\v]*\n[ \t\r\f\v]*', chr(10), 'g'), '\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""SELECT doc_id, CASE WHEN b <> '' THEN b || nn ELSE '' END || 'source' || n || 'lang' || nn || s || n || l || nn || 'source | lang' || nn || s || ' | ' || l AS content, s || ' | ' || l AS row
 FROM (SELECT doc_id, {LAID_OUT} AS b, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, chr(10) AS n, chr(10) || chr(10) AS nn FROM documents)""")
def sc02_pdf(spark, sf_dir):
    """Whole texts and tables laid out as PDF, every second file without its cross references, and read again."""
    source, lang = (F.coalesce(c, F.lit("none")) for c in ("source", "lang"))
    content = pdf_of(F.coalesce("text", F.lit("")), [F.lit("source"), F.lit("lang"), source, lang], F.col("doc_id") % 2 == 1)
    made = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), content.alias("content"))
    docs = files.documents(files.normalised(made))
    return docs.select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "content", F.array_join(F.col("tables")[0]["rows"][0], " | ").alias("row"))


def package_parts(name: str, size: int) -> dict[str, str]:
    """A package of one entry; some have another checksum, no version or no manifest."""
    entries = json.dumps([{"canonical": name, "aliases": [f" size {size} ", ""]}])
    digest = hashlib.sha256((entries + "?" * (size % 4 == 1)).encode()).hexdigest()
    manifest = {"schema_version": packages.SCHEMA, "version": "" if size % 4 == 2 else f"v{size}", "files": [{"path": "e/own.json", "kind": "entities", "sha256": digest}]}
    return {"e/own.json": entries} | ({"manifest.json": json.dumps(manifest)} if size % 4 < 3 else {})


@query("""SELECT p_partkey, NULL AS version, CASE p_size % 4 WHEN 1 THEN 'dictionary_checksum_mismatch' WHEN 2 THEN 'dictionary_version_missing' ELSE 'dictionary_manifest_missing' END AS found FROM part WHERE p_size % 4 > 0
 UNION ALL SELECT p_partkey, 'v' || p_size, p_name || ' = ' || unnest([p_name, 'size ' || p_size]) FROM part WHERE p_size % 4 = 0""")
def sc16_packages(spark, sf_dir):
    found = storage.written(packages.read(packed(spark, sf_dir, ".zip", package_parts)), "packages")
    key = F.substring_index("path", ".", 1).cast("long").alias("p_partkey")
    sound = found.where("code is null").select(key, "package_sha256").distinct()
    names = packages.names(found).join(sound, "package_sha256").select("p_partkey", "version", F.concat_ws(" = ", "canonical", "alias").alias("found"))
    return names.unionByName(packages.refused(found).select(key, F.lit(None).cast("string").alias("version"), F.col("code").alias("found")))


@query("""SELECT conv_id, turn, unnest(CASE WHEN turn % 2 = 0 THEN [0, 1] ELSE [0] END) AS pos, 'official-' || conv_id AS id, text FROM conversations""")
def sc23_gold_questions(spark, sf_dir):
    """Gold objects of whole turns: two official questions, or an official one and another."""
    ask = lambda prefix: F.struct(F.concat(F.lit(prefix), F.col("conv_id").cast("string")).alias("id"), F.col("text").alias("question"))
    more = F.when(F.col("turn") % 2 == 0, F.array(ask("official-"))).otherwise(F.array(ask("other-")))
    body = F.to_json(F.struct(F.array(ask("official-")).alias("questions"), more.alias("corpus_regression_questions")))
    objects = read(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("whole"))
    return files.questions(objects, "whole", official_only=True).select("conv_id", "turn", "pos", "id", F.get_json_object("question", "$.question").alias("text"))


#: Texts in Cyrillic are made from those of the test tables letter by letter; the rest of a text that isn't ASCII becomes a question mark.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"
#: The characters from 128 on of the two codings of a byte that are told apart; the one byte that Windows-1251 lacks stands for itself.
HIGH = bytes(range(128, 256)).decode("latin-1")
HIGH_1251 = "".join(bytes([i]).decode("cp1251", "ignore") or chr(i) for i in range(128, 256))
CYRILLIC_SQL = f"translate(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '?', 'g'), '{LATIN}', '{CYRILLIC}')"


def as_cyrillic(letters: str):
    return F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7f]", "?"), LATIN, letters)


@query(f"SELECT doc_id, content FROM (SELECT doc_id, regexp_replace(regexp_replace({CYRILLIC_SQL}, '^\\s+', ''), '\\s+$', '') AS content FROM documents) WHERE content <> ''")
def sc10_encodings(spark, sf_dir):
    """Whole texts in UTF-8, with a mark before them, and in Windows-1251, whose bytes are written as those of the Latin letters that share them.

    A file of white space alone is a document without content, and no row here; white space is what the twin's pattern takes for it."""
    d = F.col("doc_id") % 3
    plain = F.encode(as_cyrillic(CYRILLIC), "UTF-8")
    narrow = F.encode(as_cyrillic(CYRILLIC.encode("cp1251").decode("latin-1")), "ISO-8859-1")
    content = F.when(d == 0, plain).when(d == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).otherwise(narrow)
    rows = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), content.alias("content"))
    docs = files.documents(files.normalised(rows, blanks=" \t\n\f\r")).where("content <> ''")
    return docs.select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "content")


@query(f"SELECT doc_id, {CYRILLIC_SQL} AS text FROM documents")
def x38_repaired(spark, sf_dir):
    """Every second text is broken: its bytes in UTF-8 read as Windows-1251."""
    whole = as_cyrillic(CYRILLIC)
    broken = F.translate(F.decode(F.encode(whole, "UTF-8"), "ISO-8859-1"), HIGH, HIGH_1251)
    said = F.when(F.col("doc_id") % 2 == 0, broken).otherwise(whole)
    return read(spark, sf_dir, "documents").select("doc_id", said.alias("t")).select("doc_id", extract.repaired(F.col("t")).alias("text"))


@query(f"WITH {NOTES}, {FOUND} SELECT unit, max(CASE unit WHEN '%' THEN 0.05 WHEN 'm/s' THEN 0.01 WHEN 'mg/l' THEN 0.01 WHEN 'mg/dm3' THEN 0.01 ELSE 0.000001 END)::DOUBLE AS tolerance, sum(a) AS total FROM found GROUP BY 1")
def x09_x40_tolerances(spark, sf_dir):
    found = notes(spark, sf_dir).select(F.explode(quantities.quantities(F.col("note"))).alias("q")).select("q.*")
    return found.groupBy("unit").agg(F.max(quantities.tolerance(F.col("unit"))).alias("tolerance"), F.sum("value").alias("total"))


@query(f"SELECT doc_id, len({TOKENS_SQL}) AS n, array_to_string(list_sort({TOKENS_SQL})[1:5], ' ') AS first FROM documents")
def x01_search_tokens(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice(F.array_sort("t"), 1, 5), " ").alias("first"))


@query(f"SELECT vec_id, round({COSINE_SQL}, 6) AS cosine FROM embeddings")
def x19_cosines(spark, sf_dir):
    asked = F.array(*[F.lit(float(x)) for x in QUERY_VECTOR])
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(ranking.cosine(F.col("embedding"), asked), 6).alias("cosine"))


@query(f"WITH {CODES} SELECT doc_id, len(years) > 0 AND (q <> 1 OR len(list_filter(years, lambda y: y BETWEEN 2019 AND 2021)) > 0) AS time, CASE q WHEN 0 THEN contains(form, 'россия') OR list_contains(places, 'Россия') WHEN 2 THEN contains(form, 'norilsk') AND (contains(form, 'норильский регион') OR list_contains(places, 'Норильский регион')) ELSE true END AS place FROM x")
def f19_f20_coverage(spark, sf_dir):
    ask = asks()
    return notes(spark, sf_dir).select("doc_id", verify.time_covered(F.col("note"), ask["start_year"], ask["end_year"]).alias("time"), verify.places_covered(F.col("note"), ask["places"]).alias("place"))


@query("SELECT p_partkey, 'row' AS kind FROM part WHERE p_size % 2 = 0")
def f12_table_rows_only(spark, sf_dir):
    size = F.col("p_size")
    index = read(spark, sf_dir, "part").select("p_partkey", F.when(size % 2 == 0, "table_row").otherwise("source_span").alias("item_type"), F.lit("public").alias("access_level"), F.array().cast("array<string>").alias("allowed_roles"))
    return index.where(retrieval.asked_for([], tables_only=True)).select("p_partkey", F.lit("row").alias("kind"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, role) AS rank, CAST(coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM conversations")
def w02_w03_ranks_offsets(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc_nulls_first(F.length("text")), "turn", "role"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", rank.cast("long").alias("rank"), evidence.running_start(F.col("text"), "conv_id", "turn", "role", "text").alias("start_offset"))


@query("SELECT event_id FROM events ORDER BY CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END DESC NULLS FIRST, ts DESC, event_id LIMIT 60")
def t06_nulls_first(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("confidence", F.when(F.col("event_id") % 50 != 0, F.col("value")))
    return rows.orderBy(F.desc_nulls_first("confidence"), F.desc("ts"), "event_id").limit(60).select("event_id")


@query("SELECT o_orderkey, o_orderdate AS created, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def m02_created_kept(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))
    new = old.where("o_orderkey % 4 = 0").select("o_orderkey", F.expr("created + interval 3 days").alias("created"), F.lit("new").alias("status"))
    return state.upserted(old, new, ["o_orderkey"], "created")


@query("SELECT claim_id, version FROM (SELECT o_orderkey AS claim_id, 1 AS version FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'F')")
def m04_fact_versions(spark, sf_dir):
    first = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.lit(0).alias("at"), F.lit(0).alias("n"), "o_orderstatus")
    log = first.unionByName(first.where("o_orderstatus = 'F'").withColumn("at", F.lit(1)))
    return state.versioned(log, "claim_id", "at", "n").select("claim_id", "version")


@query(f"""SELECT doc_id, 'Title ' || doc_id AS title, 'd' || doc_id AS span, length({NOTE}) AS size, CASE WHEN doc_id % 2 = 0 THEN 'gap' ELSE '' END AS gaps FROM documents""")
def pr09_export_documents(spark, sf_dir):
    """The document that an export is made of, as one struct for each answer, read back from its JSON."""
    d = F.col("doc_id").cast("string")
    source = F.struct(F.concat(F.lit("d"), d).alias("id"), F.expr(NOTE).alias("text"))
    gaps = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>"))
    body = F.struct(F.concat(F.lit("Title "), d).alias("title"), F.array(source).alias("sources"), gaps.alias("gaps"))
    made = read(spark, sf_dir, "documents").select("doc_id", F.to_json(body).alias("j"))
    back = made.select("doc_id", F.from_json("j", "title string, sources array<struct<id: string, text: string>>, gaps array<string>").alias("b"))
    return back.select("doc_id", "b.title", F.col("b.sources")[0]["id"].alias("span"), F.length(F.col("b.sources")[0]["text"]).alias("size"), F.array_join("b.gaps", ",").alias("gaps"))


NAMED = "(SELECT 'p' || s_suppkey AS id FROM supplier WHERE contains(lower(s_name), 'supplier#1') ORDER BY CASE WHEN lower(s_name) = 'supplier#1' THEN 1 ELSE 2 END, id LIMIT 10)"
FALLBACK = f"{BASE} SELECT claim_id, span_id, 'entity_property' AS pattern FROM v WHERE process IN {NAMED} ORDER BY confidence DESC NULLS FIRST, claim_id LIMIT 20"


def searched(spark: SparkSession, sf_dir: str, spec: patterns.Spec) -> DataFrame:
    g = graph(spark, sf_dir)
    none = g.entities.limit(0).select("entity_id", F.col("canonical_name").alias("name"))
    found, _ = patterns.exact_search_or_neighbours(g, none, spec)
    return found.select("claim_id", "span_id", "pattern")


@query(FALLBACK)
def v09_search_by_names(spark, sf_dir):
    return searched(spark, sf_dir, patterns.Spec(hints=["supplier#1"], levels=LEVELS, patterns=["entity_property"]))


@query(FALLBACK)
def v10_search_falls_back(spark, sf_dir):
    """An id that names no entity: the search goes on from the names that it resembles."""
    return searched(spark, sf_dir, patterns.Spec(entity_ids=["supplier#1"], levels=LEVELS, patterns=["entity_property"]))
