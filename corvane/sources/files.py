"""Files as tables: listing, packing into batches, checksums, and normalisation into documents and warnings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.functions.extract import safe_filename
from corvane.operators import snapshots, storage
from corvane.sources import formats

SPAN = "struct<page: int, start_offset: int, end_offset: int, text: string, table_block_id: string, source_type: string>"
TABLE = "struct<id: string, page: int, headers: array<string>, rows: array<array<string>>>"
DOCUMENT = f"struct<document_id: string, source_type: string, title: string, content: string, spans: array<{SPAN}>, tables: array<{TABLE}>, parser: string>"
#: Limits of an archive: fixed values of a deployment, here as defaults.
MOST_ENTRIES, MOST_BYTES = 1000, 500_000_000
#: Characters of contents, spans and tables that are handed on together.
BATCH_CHARACTERS = 2_000_000


def listed(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (".tmp", ".part"), content: bool = True) -> DataFrame:
    """Every file under a folder, at any depth: path, length, content. Hidden files and excluded suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    kept = files.where(~F.startswith(name, F.lit(".")))
    for end in excluded:
        kept = kept.where(~F.endswith(F.lower(name), F.lit(end)))
    return kept.select("path", "length", *(["content"] if content else []))


def batches(files: DataFrame, most_bytes: int) -> DataFrame:
    """files (path, length) -> path, length, batch: all files in order of their path fill batches up to most_bytes; a larger file is a batch of its own.

    Where a batch that began at each file would end is found for all files at once by running sums; the batches that there are follow from
    the first file by pointer doubling, whose rounds are the logarithm of their number. No fold, no group, nothing at the driver."""
    numbered = storage.running(files.select("path", F.coalesce("length", F.lit(0)).cast("long").alias("length")), ["path", "length"], pos=F.lit(1), upto=F.col("length"))
    rows = storage.written(numbered, "sizes")
    ends = storage.first_beyond(rows.select(F.col("upto").alias("value"), "pos"), rows.select((F.col("upto") - F.col("length") + most_bytes).alias("target"), F.col("pos").alias("key")))
    # a file beyond the size ends its own batch: the next begins after it at the earliest
    leads = ends.where("pos is not null").select("key", F.greatest("pos", F.col("key") + 1).alias("pos"))
    last = rows.agg(F.max("pos")).first()[0] or 0
    leads = storage.written(leads.where(F.col("pos") <= last), "leads")
    starts = storage.written(rows.where("pos = 1").select(F.col("pos").alias("key")), "starts")
    while True:
        new = starts.join(leads, "key").select(F.col("pos").alias("key")).join(starts, "key", "left_anti").distinct()
        grown = storage.written(starts.unionByName(new), "starts")
        if grown.count() == starts.count():
            break
        starts = grown
        twice = leads.select(F.col("key").alias("pos"), F.col("pos").alias("next"))
        leads = storage.written(leads.join(twice, "pos").select("key", F.col("next").alias("pos")), "leads")
    marked = rows.join(starts.select(F.col("key").alias("pos"), F.lit(1).alias("begins")), "pos", "left").select("path", "length", "pos", F.coalesce("begins", F.lit(0)).alias("begins"))
    return storage.running(marked, ["pos"], batch=F.col("begins")).select("path", "length", (F.col("batch") - 1).alias("batch"))


def still_to_do(packed: DataFrame, done: DataFrame) -> DataFrame:
    """The batches of which done (path) lacks a file, whole: what a run that was cut off has to do when it goes on."""
    undone = packed.join(done.select("path").distinct(), "path", "left_anti").select("batch").distinct()
    return packed.join(undone, "batch", "left_semi").select(*packed.columns)


def with_checksums(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def stored_once(files: DataFrame) -> DataFrame:
    """One row for each content: the first path of it."""
    first = F.row_number().over(W.partitionBy("sha256").orderBy("path"))
    return with_checksums(files).withColumn("_rank", first).where("_rank = 1").drop("_rank")


def received(files: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """files (request, path, content) -> (objects (object_key, request, path, length, sha256, content), refused (request, reason, total)).

    A request is taken whole or not at all: refused if its files together exceed most_bytes, or if one is empty or has no name. Keys are made
    from request, content and name, so a repeated request writes the same objects."""
    name = F.substring_index("path", "/", -1)
    sized = files.select("request", "path", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("length"), (F.coalesce(name, F.lit("")) == "").alias("unnamed"))
    totals = sized.groupBy("request").agg(F.sum("length").alias("total"), F.min("length").alias("least"), F.max("unnamed").alias("unnamed"))
    reason = F.when(F.col("unnamed"), "invalid_file").when(F.col("least") == 0, "empty_file").when(F.col("total") > most_bytes, "upload_too_large")
    refused = totals.select("request", reason.alias("reason"), "total").where("reason is not null")
    taken = with_checksums(files.join(refused, "request", "left_anti"))
    key = F.concat_ws("/", F.lit("uploads"), F.col("request").cast("string"), F.concat_ws("-", F.substring("sha256", 1, 32), safe_filename(F.col("path"))))
    return taken.select(key.alias("object_key"), "request", "path", F.length("content").cast("long").alias("length"), "sha256", "content").dropDuplicates(["object_key"]), refused


def stored(files: DataFrame, folder: str, most_bytes: int) -> DataFrame:
    """Writes the objects and refusals of requests as one snapshot in folder (see snapshots.committed) and gives the refused; a failure leaves nothing visible."""
    objects, refused = received(files, most_bytes)
    snapshots.committed({"objects": objects, "refused": refused}, folder)
    return snapshots.opened(files.sparkSession, folder)["refused"]


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """The stored objects, each with whether its content is still what was received: object_key, request, length, intact."""
    objects = snapshots.opened(spark, folder)["objects"]
    same = (F.length("content") == F.col("length")) & (F.sha2("content", 256) == F.col("sha256"))
    return objects.select("object_key", "request", "length", same.alias("intact"))


def intact(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files (path, content), expected (path, sha256, length) -> path, intact: whether the content is what was stored."""
    own = files.select("path", F.sha2("content", 256).alias("own"), F.length("content").alias("size"))
    return expected.join(own, "path", "left").select("path", F.coalesce((F.col("own") == F.col("sha256")) & (F.col("size") == F.col("length")), F.lit(False)).alias("intact"))


def characters(document: dict) -> int:
    """Of content, spans and tables: a document given with its spans may have no content."""
    cells = [c for t in document["tables"] for r in [t["headers"], *t["rows"]] for c in r]
    return len(document["content"]) + sum(len(s["text"]) for s in document["spans"]) + sum(map(len, cells))


def normalised(files: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, blanks: str | None = None) -> DataFrame:
    """files (path, content) -> path, document (null on a row of warnings), warnings. A file is a row, an archive as many as it has documents.

    blanks: what is taken off the ends of a text; without it all white space. Each file is parsed where it is; batches hold a few files at a time, whose size the reader bounds. An archive's files leave one by one."""

    def parts_of(name: str, data: bytes) -> Iterator[tuple[list[dict], list[str]]]:
        checksum = hashlib.sha256(data).hexdigest()
        try:
            if formats.suffix(name) == ".zip":
                yield from formats.unpacked(checksum, data, most_entries, most_bytes, blanks)
            else:
                yield formats.normalised(checksum, name, data, blanks=blanks)
        except formats.Unreadable as error:
            yield [], [f"{error.code}:{name}"]

    kinds = f"path string, document {DOCUMENT}, warnings array<string>"
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one file at a time as an object of Python
                path = path.as_py()
                for documents, warnings in parts_of(path.rsplit("/", 1)[-1], content.as_py() or b""):
                    rows += [{"path": path, "document": d, "warnings": []} for d in documents]
                    rows += [{"path": path, "document": None, "warnings": warnings}] if warnings else []
                    size += sum(map(characters, documents))
                    if size > BATCH_CHARACTERS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(parsed, kinds)


def documents(normal: DataFrame) -> DataFrame:
    return normal.where("document is not null").select("path", "document.*")


def warnings(normal: DataFrame) -> DataFrame:
    return normal.select("path", F.explode("warnings").alias("warning"))


def spans(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.inline("spans"))


def invalid_entries(entries: DataFrame, key: str = "path") -> DataFrame:
    """entries (path, kind, sha256, canonical, aliases) -> (key, problem) for each rule that an entry breaks."""
    rules = {
        "path": F.trim(F.coalesce("path", F.lit(""))) != "",
        "kind": F.coalesce("kind", F.lit("")).isin("entities", "aliases", "units", "geographies"),
        "sha256": F.coalesce("sha256", F.lit("")).rlike("^[0-9a-f]{64}$"),
        "canonical": F.trim(F.coalesce("canonical", F.lit(""))) != "",
        "aliases": F.coalesce(F.forall("aliases", lambda a: a.isNotNull() & (F.trim(a) != "")), F.lit(True)),
    }
    broken = F.array_compact(F.array(*[F.when(~holds, name) for name, holds in rules.items()]))
    return entries.select(key, F.explode(broken).alias("problem"))


def questions(objects: DataFrame, whole: str, official_only: bool = False) -> DataFrame:
    """Gold objects (JSON in column whole, with lists questions and corpus_regression_questions) -> their other columns, pos, id, question (its JSON), in the order given."""
    lists = [F.coalesce(F.from_json(F.get_json_object(whole, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("questions", "corpus_regression_questions")]
    others = [c for c in objects.columns if c != whole]
    rows = objects.select(*others, F.posexplode(F.concat(*lists)).alias("pos", "question")).withColumn("id", F.get_json_object("question", "$.id"))
    return rows.where(F.startswith("id", F.lit("official-"))) if official_only else rows


def gold_questions(spark: SparkSession, path: str, official_only: bool = False) -> DataFrame:
    """The questions of gold files, each file one object: path, pos, question, id."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return questions(raw.select(F.col("_metadata.file_path").alias("path"), "value"), "value", official_only)
