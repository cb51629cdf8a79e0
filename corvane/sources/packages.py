"""Dictionary packages: archives with a manifest, read whole or refused, and one version of the dictionary active at a time.

A package is a small archive: manifest.json names its version and its files, each with a kind and a checksum; a file is a list of entries in JSON or
YAML. YAML needs the yaml module; without it a package with such a file is refused. Aliases within YAML are refused, as they can grow without bound."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import snapshots
from corvane.sources import formats

#: The kinds of files, the schema's name and the codes below: fixed values.
KINDS = ("entities", "aliases", "units", "geographies")
SCHEMA = "dictionary-package.v1"
FOUND = "path string, code string, package_sha256 string, version string, member string, kind string, sha256 string, pos int, entry string"


def from_yaml(text: str):
    try:
        import yaml
    except ImportError as error:
        raise formats.Unreadable("dictionary_yaml_unavailable") from error
    try:
        if any(isinstance(t, yaml.AliasToken) for t in yaml.scan(text)):
            raise formats.Unreadable("dictionary_file_invalid")
        return yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ValueError("yaml") from error


def values(data: bytes, path: str):
    try:
        text = data.decode("utf-8")
        return from_yaml(text) if path.lower().endswith((".yaml", ".yml")) else json.loads(text)
    except (ValueError, RecursionError) as error:  # not UTF-8, not JSON, nested without end
        raise formats.Unreadable("dictionary_file_invalid") from error


def required(holds: object, code: str) -> None:
    if not holds:
        raise formats.Unreadable(code)


def members(content: bytes, most_entries: int, most_bytes: int) -> dict[str, bytes]:
    """The files of a package by path."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            own = [e for e in archive.infolist() if not e.is_dir()]
            required(own and len(own) <= most_entries and sum(e.file_size for e in own) <= most_bytes, "dictionary_zip_limit")
            paths = {formats.plain_path(e) for e in own}
            required(len(paths) == len(own) and not any(map(formats.leads_out, own)), "dictionary_zip_path_invalid")
            return {formats.plain_path(e): archive.read(e) for e in own}
    except (RuntimeError, NotImplementedError, OSError, zlib.error, zipfile.BadZipFile) as error:
        raise formats.Unreadable("invalid_dictionary_zip") from error


def parsed(content: bytes, most_entries: int, most_bytes: int) -> Iterator[tuple]:
    """(version, member, kind, sha256, pos, entry as JSON) of a package's entries; Unreadable with the code of the first rule that it breaks."""
    files = members(content, most_entries, most_bytes)
    required("manifest.json" in files, "dictionary_manifest_missing")
    manifest = values(files["manifest.json"], "manifest.json")
    manifest = manifest if isinstance(manifest, dict) else {}
    version, declared = str(manifest.get("version") or "").strip(), manifest.get("files")
    required(manifest.get("schema_version") == SCHEMA, "dictionary_schema_unsupported")
    required(version, "dictionary_version_missing")
    required(isinstance(declared, list) and declared and all(isinstance(d, dict) for d in declared), "dictionary_manifest_invalid")
    names = [str(d.get("path") or "") for d in declared]
    required(len(set(names)) == len(names) and set(names) <= files.keys() and all(d.get("kind") in KINDS for d in declared), "dictionary_manifest_invalid")
    for name, d in zip(names, declared, strict=True):
        own = hashlib.sha256(files[name]).hexdigest()
        required(own == d.get("sha256"), "dictionary_checksum_mismatch")
        body = values(files[name], name)
        entries = body.get("entries") if isinstance(body, dict) else body
        required(isinstance(entries, list) and all(isinstance(e, dict) for e in entries), "dictionary_file_invalid")
        yield from ((version, name, d["kind"], own, i, json.dumps(e, ensure_ascii=False, sort_keys=True, default=str)) for i, e in enumerate(entries))


def read(files: DataFrame, most_entries: int = 1000, most_bytes: int = 100_000_000) -> DataFrame:
    """files (path, content) -> a row for each entry of a sound package (code null), one with its code for each that is refused."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content) if content is not None else b""
                digest = hashlib.sha256(data).hexdigest()
                try:
                    out += [(path, None, digest, *e) for e in list(parsed(data, most_entries, most_bytes))]
                except formats.Unreadable as error:
                    out.append((path, error.code, digest, *[None] * 6))
            yield pd.DataFrame(out, columns=columns).astype({"pos": "Int32"})

    return files.select("path", "content").mapInPandas(rows, FOUND)


def refused(found: DataFrame) -> DataFrame:
    return found.where("code is not null").select("path", "package_sha256", "code")


def names(found: DataFrame) -> DataFrame:
    """(package_sha256, version, kind, alias, canonical): each entry's name and its aliases, without blanks around them, as a dictionary that texts are held against."""
    e = F.from_json("entry", "canonical string, canonical_name string, name string, aliases array<string>")
    rows = found.where("code is null").select("package_sha256", "version", "kind", e.alias("e"))
    rows = rows.withColumn("canonical", F.trim(F.coalesce("e.canonical", "e.canonical_name", "e.name")))
    each = rows.withColumn("alias", F.explode(F.concat(F.array("canonical"), F.coalesce("e.aliases", F.array().cast("array<string>")))))
    return each.select("package_sha256", "version", "kind", F.trim("alias").alias("alias"), "canonical").where("alias <> '' and canonical <> ''").distinct()


def activated(found: DataFrame, folder: str, version: str) -> int:
    """Makes one version of the packages found the active dictionary in folder, its names and what it was made of together (see snapshots.committed).

    Refused if no sound package has the version, or several that differ have it. An older version is made active again in the same way."""
    own = found.where(F.col("code").isNull() & (F.col("version") == version))
    made_of = own.select("version", "package_sha256", "member", "kind", "sha256").distinct()
    packages = [r[0] for r in made_of.select("package_sha256").distinct().limit(2).collect()]
    if len(packages) != 1:
        raise ValueError(f"{'no sound package has' if not packages else 'packages that differ have'} the version {version}")
    return snapshots.committed({"names": names(own), "package": made_of}, folder)


def active(spark: SparkSession, folder: str) -> DataFrame | None:
    """The names of the active version; None before the first."""
    return snapshots.opened(spark, folder).get("names")
