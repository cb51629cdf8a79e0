"""Dictionary packages and their versions, gold files, and the life of an index."""

import hashlib
import io
import json
import zipfile

import pytest

from corvane.operators import retrieval, snapshots
from corvane.sources import files, packages

ENTRIES = json.dumps([{"canonical": " Nickel ", "aliases": ["Ni", " ", None]}, {"name": "Copper"}, {"aliases": ["nameless"]}])


def package(members: dict, version="1", schema=packages.SCHEMA, files=None, **more) -> bytes:
    described = [{"path": p, "kind": "entities", "sha256": hashlib.sha256(d.encode()).hexdigest()} for p, d in members.items()] if files is None else files
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, data in ({"manifest.json": json.dumps({"schema_version": schema, "version": version, "files": described})} | members | more).items():
            z.writestr(path, data)
    return out.getvalue()


def test_packages_are_sound_or_refused(spark):
    own = {"e.json": ENTRIES}
    entry = {"path": "e.json", "kind": "entities", "sha256": hashlib.sha256(ENTRIES.encode()).hexdigest()}
    cases = {
        "good": (package(own), None),
        "more": (package(own, **{"unused.txt": "x"}), None),
        "zip": (b"no", "invalid_dictionary_zip"),
        "null": (None, "invalid_dictionary_zip"),
        "many": (package(own, a="1", b="2", c="3"), "dictionary_zip_limit"),
        "path": (package(own, **{"../x": "1"}), "dictionary_zip_path_invalid"),
        "schema": (package(own, schema="other"), "dictionary_schema_unsupported"),
        "version": (package(own, version=" "), "dictionary_version_missing"),
        "none": (package(own, files=[]), "dictionary_manifest_invalid"),
        "kind": (package(own, files=[entry | {"kind": "odd"}]), "dictionary_manifest_invalid"),
        "twice": (package(own, files=[entry, entry]), "dictionary_manifest_invalid"),
        "absent": (package(own, files=[entry | {"path": "x.json"}]), "dictionary_manifest_invalid"),
        "sum": (package(own, files=[entry | {"sha256": "0"}]), "dictionary_checksum_mismatch"),
        "later": (package(own | {"z.json": "["}), "dictionary_file_invalid"),
        "rows": (package({"e.json": '["odd"]'}), "dictionary_file_invalid"),
        "json": (package(own, **{"manifest.json": "{"}), "dictionary_file_invalid"),
    }
    raw = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "path string, content binary")
    found = packages.read(raw, most_entries=4).collect()
    assert {r.path: r.code for r in found} == {k: code for k, (_, code) in cases.items()}
    assert sum(r.path == "good" for r in found) == 3 and sum(r.path == "later" for r in found) == 1  # a refused package gives no entry
    assert packages.read(raw.limit(0)).count() == 0


def test_yaml(spark):
    pytest.importorskip("yaml")
    good, bomb = "entries:\n- canonical: Никель\n  aliases: [Ni]\n", "a: &a [x]\nentries: [*a, *a]\n"
    raw = spark.createDataFrame([("a", package({"e.yml": good})), ("b", package({"e.yaml": bomb})), ("c", package({"e.yaml": "- {"}))], "path string, content binary")
    found = packages.read(raw)
    assert sorted((r.path, r.code) for r in packages.refused(found).collect()) == [("b", "dictionary_file_invalid"), ("c", "dictionary_file_invalid")]
    assert sorted((r.alias, r.canonical) for r in packages.names(found).collect()) == [("Ni", "Никель"), ("Никель", "Никель")]


def test_one_version_is_active(spark, tmp_path):
    at = f"file://{tmp_path}/dictionary"
    other = package({"e.json": '{"entries": [{"canonical": "Slag"}]}'}, version="2")
    raw = spark.createDataFrame([("a", package({"e.json": ENTRIES})), ("a again", package({"e.json": ENTRIES})), ("b", other), ("c", b"no")], "path string, content binary")
    found = packages.read(raw).cache()
    assert packages.active(spark, at) is None
    with pytest.raises(ValueError, match="no sound package"):
        packages.activated(found, at, "3")
    assert packages.active(spark, at) is None  # what is refused activates nothing
    packages.activated(found, at, "1")
    want = {("Nickel", "Nickel"), ("Ni", "Nickel"), ("Copper", "Copper")}
    names = lambda: {(r.alias, r.canonical) for r in packages.active(spark, at).collect()}
    assert names() == want
    packages.activated(found, at, "2")
    assert names() == {("Slag", "Slag")} and [r.version for r in snapshots.opened(spark, at)["package"].collect()] == ["2"]
    packages.activated(found, at, "1")
    assert names() == want and snapshots.damaged(spark, at) == []
    artifacts = spark.createDataFrame([("ni",), ("other",)], "value string")
    assert [r.canonical for r in retrieval.canonical(artifacts, packages.active(spark, at)).orderBy("value").collect()] == ["Nickel", "other"]
    clash = spark.createDataFrame([("d", package({"e.json": "[]", "f.json": ENTRIES}, version="1"))], "path string, content binary")
    with pytest.raises(ValueError, match="differ"):
        packages.activated(found.unionByName(packages.read(clash)), at, "1")


def test_gold_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"questions": [{"id": "official-1", "question": "é?"}, {"id": 7}], "corpus_regression_questions": [{"id": "official-2"}, {}]}))
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.json").write_text("broken")
    every = files.gold_questions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.id for r in every] == ["official-1", "7", "official-2", None] and json.loads(every[0].question)["question"] == "é?"
    assert [r.pos for r in files.gold_questions(spark, str(tmp_path), official_only=True).orderBy("pos").collect()] == [0, 2]


def test_reset_without_an_index(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    assert not retrieval.reset(spark, at) and retrieval.reset(spark, at) and not retrieval.bootstrapped(spark, at, "a int")
