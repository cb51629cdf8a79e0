"""Files made here: each format, archives and their limits, encodings, checksums, exports and streams."""

import hashlib
import io
import json
import stat
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corvane.functions import aliases, extract
from corvane.operators import patterns, retrieval
from corvane.sinks import exports
from corvane.sources import files, formats
from corvane.streaming import feeds

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def docx():
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:t> First </w:t><w:tab/><w:t>line</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell('h')}{cell('u')}</w:tr><w:tr>{cell('')}{cell(' ')}</w:tr><w:tr>{cell('1')}{cell('mg/l')}</w:tr></w:tbl><w:p><w:r><w:t>Last</w:t></w:r></w:p>"
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx():
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p></p:txBody></p:sp>"
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = lambda inner: f"<p:sld {P}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    return archive({"ppt/presentation.xml": "<x/>", "ppt/slides/slide10.xml": slide(shape("Ten")), "ppt/slides/slide2.xml": slide(shape("Two") + table)})


def test_formats():
    read = lambda name, data: formats.normalised("c", name, data)
    (d,), w = read("a.docx", docx())
    assert [s["text"] for s in d["spans"]] == ["First \tline", "Last", "h | u", "1 | mg/l"] and w == []
    assert [(s["start_offset"], s["end_offset"]) for s in d["spans"]] == [(0, 11), (13, 17), (19, 24), (26, 34)] and d["content"][26:34] == "1 | mg/l"
    assert d["tables"] == [{"id": hashlib.sha1(f"{d['document_id']}:1:0".encode()).hexdigest()[:16], "page": 1, "headers": ["h", "u"], "rows": [["1", "mg/l"]]}]
    (d,), _ = read("a.pptx", pptx())
    assert [(s["page"], s["text"]) for s in d["spans"]] == [(1, "Two\nmore"), (1, "k"), (2, "Ten\nmore")]
    (d,), _ = read("a.TSV", "﻿a\tb\n\t\n1\t2\n".encode())
    assert d["tables"][0]["headers"] == ["a", "b"] and d["tables"][0]["rows"] == [["1", "2"]] and d["source_type"] == "tsv"
    assert read("a.txt", "привет".encode("cp1251"))[0][0]["content"] == "привет" and formats.decoded(b"\x98\xff") == "��"
    assert read("a.md", b"  \n")[1] == ["empty_document:a.md"]
    assert read("a.json", b'{"content": "x"}')[0][0]["title"] == "a.json" and read("a.json", b"[1]")[1] == ["unsupported_json_shape:a.json"]
    for name, code in (("a.pdf", "pdf_parse_failed"), ("a.doc", "doc_converter_unavailable"), ("a.exe", "unsupported_source_format"), ("a.docx", "docx_parse_failed"), ("a.json", "invalid_json")):
        assert read(name, b"bad")[1] == [f"{code}:{name}"]
    bomb = archive({"word/document.xml": f'<!DOCTYPE x [<!ENTITY a "b">]><w:document {W}/>'})
    assert read("a.docx", bomb)[1] == ["docx_parse_failed:a.docx"]


def test_archives():
    def unpacked(data, most_entries, most_bytes):
        parts = list(formats.unpacked("c", data, most_entries, most_bytes))
        return [d for documents, _ in parts for d in documents], [w for _, warnings in parts for w in warnings]

    good = archive({"in/a.txt": "text", "b.zip": b"PK", "c.exe": b"", "d.docx": b"bad", "e/": "", "f.txt": " "})
    documents, warnings = unpacked(good, 10, 1000)
    assert [d["title"] for d in documents] == ["a.txt", "f.txt"] and documents[0]["document_id"] == formats.document_id("c", "in/a.txt")
    assert warnings == ["nested_zip_unsupported:b.zip", "unsupported_source_format:c.exe", "docx_parse_failed:d.docx", "empty_document:f.txt"]
    link = zipfile.ZipInfo("l.txt")
    link.external_attr = (stat.S_IFLNK | 0o777) << 16
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(link, "/etc/passwd")
    cases = [(good, (3, 1000), "zip_entry_limit_exceeded"), (good, (10, 5), "zip_size_limit_exceeded"), (b"no", (10, 10), "invalid_zip"), (archive({"../a.txt": "x"}), (9, 99), "zip_path_rejected"), (archive({"/a.txt": "x"}), (9, 99), "zip_path_rejected"), (out.getvalue(), (9, 99), "zip_symlink_rejected")]
    for data, limits, code in cases:
        with pytest.raises(formats.Unreadable, match=code):
            unpacked(data, *limits)
    broken = bytearray(archive({"a.txt": "some text", "b.txt": "more"}))
    broken[broken.index(b"some")] ^= 1  # its checksum no longer holds: that file is a warning, the other stays
    documents, warnings = unpacked(bytes(broken), 9, 99)
    assert [d["title"] for d in documents] == ["b.txt"] and warnings == ["archive_entry_read_failed:a.txt"]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"text one", "sub/b.zip": archive({"x.csv": "h\n1"}), "sub/c.zip": b"bad", ".hidden": b"x", "d.tmp": b"x", "e.txt": b"text one"}.items():
        (tmp_path / name).write_bytes(data)
    listed = files.listed(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[-1] for r in listed.collect()) == ["a.txt", "b.zip", "c.zip", "e.txt"]
    normal = files.normalised(listed)
    assert sorted((r.title, len(r.spans)) for r in files.documents(normal).collect()) == [("a.txt", 1), ("e.txt", 1), ("x.csv", 2)]
    assert [r.warning for r in files.warnings(normal).collect()] == ["invalid_zip:c.zip"]
    assert files.stored_once(listed).count() == 3
    assert files.spans(files.documents(normal)).where("source_type = 'table'").count() == 2
    packed = {r.path.rsplit("/", 1)[-1]: r.batch for r in files.batches(listed.select("path", "length"), 12).collect()}
    assert packed["a.txt"] == 0 and packed["e.txt"] == 1


def test_report_and_csv(spark, tmp_path):
    report = spark.createDataFrame([("b", 0.5, "pass"), ("a", None, "blocked")], "metric string, value double, status string")
    exports.write_report(report, str(tmp_path / "r"), "v1")
    assert spark.read.text(str(tmp_path / "r" / "v1" / "markdown")).count() == 2 and spark.read.json(str(tmp_path / "r" / "current" / "json")).count() == 2
    rows = spark.createDataFrame([("x,1", 'q"q'), ("line\nend", None)], "a string, b string")
    exports.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted(back.collect()) == sorted(rows.collect())
    assert sorted(r.line for r in exports.csv_lines(rows).collect()) == ['"line\nend",', '"x,1","q""q"'] and exports.header(rows) == "a,b"


def test_token_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alpha beta."), (2, "beta (gamma)"), (3, None)], "id long, text string")
    retrieval.token_index(docs, "id", "text", str(tmp_path / "index"))
    found = retrieval.lexical_from_index(spark.read.parquet(str(tmp_path / "index")), "id", ["beta", "gamma"], 5).collect()
    assert [(r.id, r.score) for r in found] == [(2, 1.0), (1, 0.5)]


def test_fuzzy_names(spark):
    tokens = ["nikel", "никел", "coppr", "flotation", "slagg", "электроэкстракци", "zzzz"]
    names = aliases.choices()
    want = set()
    for t in tokens:
        best, score = None, 0
        for name in names:
            own = round(SequenceMatcher(None, t, name).ratio() * 100)
            if own > score:
                best, score = name, own
        if score >= 88 and t != best:
            want.add((f"{t} -> {aliases.CODES.get(best, best)}", round(score / 100, 2)))
    df = spark.createDataFrame([(tokens,), ([],), (None,)], "t array<string>")
    found = {(a.value, a.confidence) for r in df.select(aliases.fuzzy(F.col("t")).alias("f")).collect() for a in r.f}
    assert found == want and want


def test_spelling_vectors(spark):
    words = ["nickel", "Fe–Ni", "ab"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", aliases.vector(F.col("w")).alias("v")).collect()
    plain = aliases.spelling_vectors([w.lower().replace("–", "-") for w in words])
    for r, v in zip(rows, plain, strict=True):
        assert r.v == pytest.approx(v.tolist(), abs=1e-12)


def test_small_functions(spark):
    df = spark.createDataFrame([("РџСЂРёРІРµС‚",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(extract.repaired(F.col("t"))).collect()] == ["Привет", "plain", None]
    assert [r[0] for r in spark.createDataFrame([("abc",), ("",), (None,)], "t string").select(extract.messages(F.col("t"), 2)).collect()] == [[(0, "ab"), (2, "c")], [], []]
    messages = list(feeds.phases(spark.createDataFrame([("parsing", ""), ("synthesis", "abc")], "phase string, text string").coalesce(1), 2))
    assert [m.get("text", m["type"]) for m in messages] == ["phase", "phase", "ab", "c", "end"]


def test_refusals(spark):
    one = spark.range(100).select(F.col("id").cast("string").alias("a"))
    with pytest.raises(ValueError, match="more than 50"):
        patterns.pairs(one, one.withColumnRenamed("a", "b"), 50)


def test_foreach_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny")
    seen = []
    for _ in range(2):  # the second run finds nothing new: its place is in the checkpoint
        feeds.published(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "at"), lambda batch, no: seen.append((no, batch.count()))).awaitTermination(120)
    assert seen == [(0, 2)]


def test_what_is_handed_on_counts_spans_and_tables():
    """A document that is given with its spans has no content of its own: its spans fill a batch all the same."""
    data = {"id": "d", "source_spans": [{"text": "x" * 1000}], "table_blocks": [{"headers": ["ab"], "rows": [["c", "de"]]}]}
    (given,), _ = formats.normalised("c", "a.json", json.dumps(data).encode())
    (plain,), _ = formats.normalised("c", "a.txt", b"words")
    assert given["content"] == "" and files.characters(given) == 1005 and files.characters(plain) == 10


ODD_TEXTS = [None, "", "  \n\t", "\x0b", "\x0bword\x1c", "\x1d \x1fa b\x1e\n", " nbsp　", "\x85next ", "😀 smile", "﻿mark", "\r\nline\r\nend\r\n", "п»ї", "Upper Abc", "\x7f", "q" * 5, "\x0c", "a\x00b"]


def test_encodings_of_odd_texts_equal_their_sql(spark, tmp_path):
    """Texts that are empty, or blank, or have rare white space at their ends, in each of the three codings."""
    import duckdb

    from corvane.plans.queries import ORACLES, QUERIES

    rows = [(3 * i + k, t) for i, t in enumerate(ODD_TEXTS) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = sorted(map(tuple, QUERIES["sc10_encodings"](spark, str(tmp_path)).select("doc_id", "content").collect()))
    assert found == sorted(db.execute(ORACLES["sc10_encodings"]).fetchall())
