"""Archives: round trips of hostile payloads, revisits within and between archives, damage, and files that other tools can read."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.llm import warc

NASTY = [
    None, "", "a", "a", "\r\n\r\n", "x\r\n", "x\r\n\r\n", "\r\nx", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n", "é中😀\r\n\r\n\r\n\r\n", "\n\n\r\r\n\n", "long " * 600_000, "a",
]
URLS = ["http://a.net/", None, "http://b.net/\r\nWARC-Type: revisit", "", "http://ü.net/é"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i % 5 else None, URLS[i % 5], h, "x", 1) for i, h in enumerate(NASTY)]
    return spark.createDataFrame(rows + rows[2:4], "page_id long, url string, html string, record_type string, `offset` int").coalesce(2)


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        key = html or ""
        order = (page is None, page or 0)
        first[key] = min(first.get(key, order), order)
    out, seen = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= least and ((html or "") in seen)
        seen.add(html or "")
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", (None if first[html or ""][0] else first[html or ""][1]) if again else None))
    return sorted(out, key=repr)


def test_pages_in_archives(pages):
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in warc.pages_in_archives(pages).collect()), key=repr) == expected(rows)
    assert sorted((tuple(r) for r in warc.pages_in_archives(pages, 2).collect()), key=repr) == expected(rows, 2)
    assert warc.pages_in_archives(pages.limit(0)).collect() == []


def test_round_trip(spark, pages, tmp_path):
    """Every payload comes back, through revisits too; every payload is stored once; the files are valid gzip with records end to end."""
    raw = warc.archived(pages, f"file://{tmp_path}/raw")
    final = warc.deduplicated(spark, raw, f"file://{tmp_path}/final")
    want = sorted(((r.page_id, (r.html or "").encode()) for r in pages.collect()), key=repr)
    for folder in (raw, final):
        rows = warc.payloads(spark, folder).collect()
        assert sorted(((r.page_id, bytes(r.payload)) for r in rows), key=repr) == want
        heads = warc.records(spark, folder).collect()
        assert len({r.record_id for r in heads}) == len(want) and all(r.intact is not False for r in heads)
    stored = [r.payload_digest for r in warc.records(spark, final).where("record_type = 'response'").collect()]
    assert len(stored) == len(set(stored)) == len({h or "" for h in NASTY})
    revisit = warc.records(spark, final).where("record_type = 'revisit' and page_id = 3").first()
    assert revisit.refers_to == 2 and revisit.refers_to_uri == "http://b.net/%0D%0AWARC-Type: revisit" and revisit.refers_to_date
    for file in Path(f"{tmp_path}/final").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        assert not data or (data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n"))


def test_archives_of_others(spark, tmp_path):
    """An archive made elsewhere: other record types stay out of the way, its revisits refer to originals of other files, a wrong digest shows."""
    def record(kind, block, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "Content_Length": len(block), **more}.items())
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    name = "sha1:" + warc.digest(b"hello")
    one = record("warcinfo", b"software: x\r\n") + record("response", http + b"hello", WARC_Payload_Digest=name, WARC_Record_ID="<urn:a>", X_Page=7)
    two = record("revisit", http, WARC_Payload_Digest=name, WARC_Record_ID="<urn:b>", X_Page=3) + record("response", http + b"hellO", WARC_Payload_Digest=name, WARC_Record_ID="<urn:c>", X_Page=9)
    for n, data in enumerate((one, two)):
        (tmp_path / f"{n}.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
    heads = warc.records(spark, f"file://{tmp_path}")
    rows = {r.record_id: r for r in warc.resolved(heads).collect()}
    assert len(rows) == 4 and rows[None].record_type == "warcinfo"
    assert (rows["urn:a"].record_type, rows["urn:b"].record_type, rows["urn:b"].refers_to, rows["urn:b"].refers_to_id) == ("response", "revisit", 7, "urn:a")
    assert rows["urn:c"].intact is False and rows["urn:c"].record_type == "response" and rows["urn:a"].intact
    assert rows["urn:c"].payload_digest == warc.digest(b"hellO")


def test_damage(spark, tmp_path):
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    list(warc.cut(iter([x for x in whole.split(b"\r\n\r\n")[:-1]])))
    for data in (whole[:-9], whole.replace(b": 5", b": 4"), whole.replace(b": 5", b": x"), b"junk\r\n\r\n", whole + b"junk"):
        pieces = data.split(b"\r\n\r\n")
        with pytest.raises(warc.Damaged):
            list(warc.cut(iter(pieces if pieces[-1] else pieces[:-1])))


def test_base32(spark):
    rows = spark.range(50).select("id", warc.base32(F.sha1(F.col("id").cast("string"))).alias("x")).collect()
    assert all(r.x == warc.digest(str(r.id).encode()) for r in rows)
