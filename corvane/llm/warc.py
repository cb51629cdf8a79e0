"""Web archives: a record per page, revisits resolved by payload digest, deduplicated archives with fresh headers.

Archives are gzip files that Spark's text writer makes and Spark's text reader streams: CR LF CR LF ends every record and stands between headers and
block, so it's the line separator of both. A reader's task gets a file's pieces in order and cuts records by their Content-Length, whatever
the block holds; at most one record is held at a time, and archives may be of any size."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import new_path, written

LINE, END = "\r\n", "\r\n\r\n"
#: Digits of base 32 as conv() writes them and as RFC 4648 does: fixed values.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The profile of a revisit record whose payload equals that of an earlier one: a fixed value.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADS = "archive string, offset long, record_type string, record_id string, page_id long, uri string, date string, payload_digest string, payload_bytes long, refers_to long, refers_to_id string, refers_to_uri string, refers_to_date string, intact boolean"
#: Bytes of payload that a reader's batch holds before it is handed on.
BATCH = 4 << 20


def base32(hexadecimal: Column) -> Column:
    """40 hexadecimal digits as 32 of base 32: each five of them make four."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Line ends within a value are written as in addresses."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(LINE)), F.lit(""))


def record(kind: str, payload: Column | None) -> Column:
    """A record, without the CR LF CR LF that ends it, out of the columns record_id, page_id, uri, date, payload_digest and payload_bytes.

    A response holds the payload; a revisit (payload None) holds the same HTTP headers and says which record has it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.octet_length(http) + (F.col("payload_bytes") if payload is not None else 0)
    referred = [] if payload is not None else [
        header("WARC-Profile", F.lit(IDENTICAL)), header("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))), header("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        header("WARC-Refers-To-Date", F.col("refers_to_date")), header("X-Refers-To-Page", F.col("refers_to")),
    ]
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: {kind}{LINE}"), header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))), header("WARC-Date", F.col("date")),
        header("WARC-Target-URI", F.col("uri")), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), header("X-Page", F.col("page_id")), *referred,
        F.lit(f"Content-Type: application/http; msgtype=response{LINE}"), header("Content-Length", block), F.lit(LINE),
    )
    return F.concat(head, http, *([payload] if payload is not None else []))


def store(records: DataFrame, path: str, level: str = "DEFAULT_COMPRESSION") -> str:
    """Writes a column of records as gzip archives, one a task. level: Hadoop's name of the effort of compression."""
    records.select(records.columns[0]).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", level).text(path)
    return path


def archived(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", seed: int = 0, level: str = "DEFAULT_COMPRESSION") -> str:
    """Writes a response record per page: payload is the html in UTF-8, empty where it's null. No shuffle.

    A null page_id or url has no header. Record ids follow from the rows' place in the table, so equal rows have different ones and a repeated task writes the same."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digits = F.md5(F.concat_ws("|", F.lit(seed), F.monotonically_increasing_id(), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    uuid = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = pages.select(
        F.concat(F.lit("urn:uuid:"), uuid).alias("record_id"), "page_id", F.col("url").alias("uri"), F.lit(date).alias("date"),
        base32(F.sha1(payload)).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"),
    )
    return store(rows.select(record("response", F.col("payload")).alias("value")), path, level)


class Damaged(ValueError):
    """An archive whose records can't be cut."""


def cut(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a file, given its pieces between CR LF CR LF in order."""
    end, held, at = END.encode(), bytearray(), 0

    def filled(least: int) -> bool:
        while len(held) < least:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece + end)
        return True

    while filled(1):
        while (size := held.find(end)) < 0:
            if not filled(len(held) + 1):
                raise Damaged(f"no end of headers at {at}")
        first, *lines = bytes(held[:size]).decode("utf-8", "replace").split(LINE)
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        if not first.startswith("WARC/") or not headers.get("content-length", "").isdigit():
            raise Damaged(f"no record at {at}")
        start, length = size + len(end), int(headers["content-length"])
        if not filled(start + length + len(end)) or held[start + length : start + length + len(end)] != end:
            raise Damaged(f"the record at {at} is longer or shorter than it says")
        yield at, headers, bytes(held[start : start + length])
        del held[: start + length + len(end)]
        at += start + length + len(end)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parsed(archive: str, offset: int, headers: dict[str, str], block: bytes) -> tuple[tuple, bytes]:
    """A record's row and its payload: what follows the HTTP headers. A revisit's payload is empty; its length is the one that its HTTP headers name."""
    http, _, payload = block.partition(END.encode())
    kind, own = headers.get("warc-type", ""), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    number = lambda name: int(headers[name]) if headers.get(name, "").lstrip("-").isdigit() else None
    length = len(payload)
    if kind == "revisit":
        named = [v for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split(LINE)) if k.strip().lower() == "content-length"]
        length = int(named[0]) if named and named[0].strip().isdigit() else None
    else:
        made = digest(payload)
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    row = (
        archive, offset, kind, bare("warc-record-id"), number("x-page"), headers.get("warc-target-uri"), headers.get("warc-date"), own if kind == "revisit" else made, length,
        number("x-refers-to-page"), bare("warc-refers-to"), headers.get("warc-refers-to-target-uri"), headers.get("warc-refers-to-date"), None if kind == "revisit" else own in (None, made),
    )
    return row, payload


def records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of a folder of archives, a row each; with their payloads if asked for. `intact`: whether a response's payload has the digest that its header names.

    A damaged archive fails the job. Other record types are rows too."""
    schema = HEADS + (", payload binary" if payloads else "")
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        rows: list[tuple] = []
        size, source = 0, pieces()
        ahead = next(source, None)
        while ahead is not None:
            archive = ahead[0]

            def of_file() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == archive:  # noqa: B023
                    yield ahead[1]
                    ahead = next(source, None)

            for offset, headers, block in cut(of_file()):
                row, payload = parsed(archive, offset, headers, block)
                rows.append((*row, payload) if payloads else row)
                size += 500 + len(payload) * payloads
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    read = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").schema("value string").text(path)
    named = read.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("archive"), F.col("value").cast("binary").alias("value"))
    return named.mapInArrow(each, schema)


def resolved(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows of `records` with record_type and refers_to... as they should be: of records with equal payloads of at least least_bytes, the response with
    the smallest page_id (nulls last; ties by place) is the response, and the others, revisits of other archives among them, refer to it.

    Headers alone are shuffled, by payload digest. A revisit whose original isn't there stays as it is."""
    key = ["payload_digest", "payload_bytes"]
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "offset", "record_id", "uri", "date")).alias("first")
    originals = heads.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)).groupBy(*key).agg(first)
    joined = heads.join(originals, key, "left")
    mine = (F.col("first.archive") == F.col("archive")) & (F.col("first.offset") == F.col("offset"))
    again = F.coalesce(F.col("record_type").isin("response", "revisit") & ~mine, F.lit(False))
    put = lambda old, new: F.when(again, F.col(new)).otherwise(F.col(old)).alias(old)
    changed = {"record_type": F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"), "refers_to": put("refers_to", "first.page_id"), "refers_to_id": put("refers_to_id", "first.record_id")}
    changed |= {"refers_to_uri": put("refers_to_uri", "first.uri"), "refers_to_date": put("refers_to_date", "first.date")}
    return joined.select(*[changed.get(c, F.col(c)) for c in heads.columns])


def deduplicated(spark: SparkSession, source: str, path: str, least_bytes: int = 0) -> str:
    """Writes the records of the archives in source anew: each payload once, revisits of it without, all with fresh headers.

    Payloads of responses meet their new headers by archive and offset; those of revisits are not read again."""
    rows = written(resolved(records(spark, source), least_bytes), "headers")
    full = records(spark, source, payloads=True).select("archive", "offset", "payload")
    kept = rows.where("record_type = 'response'").join(full, ["archive", "offset"])
    responses = kept.select(record("response", F.col("payload").cast("string")).alias("value"))
    return store(responses.unionByName(rows.where("record_type = 'revisit'").select(record("revisit", None).alias("value"))), path)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, payload) of every response and revisit; a revisit's payload is that of the record it refers to, or null where that isn't in the folder."""
    every = records(spark, path, payloads=True)
    own = every.where("record_type = 'response'").select("record_id", "page_id", "payload")
    referred = every.where("record_type = 'revisit'").select("record_id", "page_id", "refers_to_id")
    originals = own.select(F.col("record_id").alias("refers_to_id"), "payload")
    return own.unionByName(referred.join(originals, "refers_to_id", "left").select("record_id", "page_id", "payload"))


def pages_in_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives the pages, deduplicates the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, a row per page.

    Null html is an empty payload; empty payloads equal each other; repeated rows are records of their own, one of which is the response. refers_to is null where the response has no page_id."""
    spark = pages.sparkSession
    raw = archived(pages.select("page_id", "url", "html"), new_path(spark, "archives"), level="BEST_SPEED")  # these are read and gone soon
    final = deduplicated(spark, raw, new_path(spark, "archives"), least_bytes)
    return records(spark, final).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
