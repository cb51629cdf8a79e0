"""Commits of several tables with failures between them, bundles of every family, and requests stored whole or not at all."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import bundles, snapshots, storage
from corvane.sources import files


def shown(tables):
    return {name: sorted(map(tuple, df.collect())) for name, df in tables.items()}


def test_failure_between_tables(spark):
    path = storage.new_path(spark, "test")
    assert snapshots.opened(spark, path) == {} and snapshots.manifest(spark, path) == []
    a, b = spark.range(5).toDF("x"), spark.createDataFrame([(1, {"k": "v"})], "x int, m map<string, string>")
    assert snapshots.committed({"a": a, "b": b}, path) == 1
    fails = a.withColumn("x", F.when(F.col("x") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        snapshots.committed({"a": spark.range(9).toDF("x"), "b": fails}, path)
    assert shown({"a": snapshots.opened(spark, path)["a"]}) == {"a": [(i,) for i in range(5)]} and len(snapshots.manifest(spark, path)) == 2
    left = snapshots.leftovers(spark, path).collect()
    assert left and all("/data/a-" in r.path or "/data/b-" in r.path for r in left)
    assert snapshots.committed({"a": spark.range(2).toDF("x")}, path) == 2
    now = snapshots.opened(spark, path)
    assert now["a"].count() == 2 and now["b"].count() == 1 and snapshots.opened(spark, path, 1)["a"].count() == 5
    assert snapshots.damaged(spark, path) == []


def test_damage_and_conflict(spark):
    path = storage.new_path(spark, "test")
    snapshots.committed({"a": spark.range(5).toDF("x"), "empty": spark.range(0).toDF("x")}, path)
    place = next(r["place"] for r in snapshots.manifest(spark, path) if r["name"] == "a")
    spark.createDataFrame([(1,)], "x long").write.mode("append").parquet(f"{path}/{place}")
    assert snapshots.damaged(spark, path) == ["a"]
    spark.createDataFrame([(1, "other", "a", place, 5, "0")], snapshots.MANIFEST).write.mode("append").parquet(f"{path}/manifest")
    with pytest.raises(snapshots.Conflict):
        snapshots.opened(spark, path)


ARTIFACTS = "id string, kind string, value string, status string, confidence double, source_span_ids array<string>, metadata map<string, string>, entity_names array<string>"


def test_families(spark):
    """Each kind goes to its tables; repeated rows are one; nulls in any column; a second commit makes versions, a failed one nothing."""
    s = ["s1"]
    rows = [
        ("c1", "claim", " Copper dissolves ", "confirmed", 0.95, s, None, ["Copper", "copper ", ""]),
        ("c1", "claim", " Copper dissolves ", "confirmed", 0.95, s, None, ["Copper"]),
        ("m1", "measurement", "5 mg/l", "candidate", 0.5, s, None, ["Copper"]),
        ("m2", "measurement", "7 mg/l", "candidate", 0.5, s, None, ["copper"]),
        ("m3", "measurement", "7 mg/l", "candidate", 0.5, None, None, ["copper"]),
        ("o1", "conclusion", "Hotter is faster", "candidate", 0.4, [], {"context_raw": "ctx"}, None),
        ("o2", "recommendation", "Heat it", "confirmed", 0.9, s, None, None),
        ("a1", "alias", "Cu", "confirmed", 0.9, s, {"canonical": "Copper"}, None),
        ("r1", "relation", "x->y", None, None, None, {"relation_type": "uses"}, None),
        ("d1", "review_decision", "fine", None, None, None, {"reviewer_id": "u7", "claim_id": "c1"}, None),
        ("g1", "geography", "Norilsk", "confirmed", 0.9, s, None, None),
        ("e1", "material", "Nickel", "candidate", 0.5, s, None, None),
        ("e2", "property", "Hardness", "confirmed", 0.9, s, None, None),
        ("u1", "gadget", "Thing", "candidate", 0.5, s, None, None),
        ("u2", "gadget", "Thing", "confirmed", 0.5, s, None, None),
        ("b1", "claim", "  ", "confirmed", 0.9, s, None, None),
        ("n1", None, "x", None, None, None, None, None),
        (None, "claim", None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame([("d1", "t")], "document_id string, title string")
    spans = spark.createDataFrame([("s1", "d1")], "span_id string, document_id string")
    df = spark.createDataFrame(rows, ARTIFACTS)
    path = storage.new_path(spark, "graph")
    assert bundles.written(spark, path, bundles.families(df, docs, spans, "t1")) == 1
    now = snapshots.opened(spark, path)
    assert set(now) == {*bundles.KEYS, "contradictions"} and len(bundles.KEYS) == 15
    ids = lambda name: sorted(r[0] for r in now[name].select(bundles.KEYS[name][0]).collect())
    assert ids("claims") == ["c1", "e2", "g1", "m1", "m2", "o1", "o2"] and ids("observations") == ["oo1"] and ids("candidates") == ["e1", "u1"]
    assert ids("aliases") == ["a1"] and ids("review_decisions") == ["d1"] and ids("relations") == ["r1"] and len(ids("measurements")) == 3
    assert sorted((r.domain_type, r.canonical_name.lower()) for r in now["entities"].collect()) == [("Entity", "copper"), ("Material", "copper"), ("Material", "nickel"), ("Property", "hardness")]
    kinds = {r.rel_type for r in now["edges"].collect()}
    assert kinds == {"DESCRIBED_IN", "QUANTIFIED_BY", "APPLIED_IN_GEOGRAPHY", "PRODUCES_OUTPUT", "PART_OF", "HAS_ALIAS", "DEGRADED_TO", "VALIDATED_BY", "HAS_VERSION"}
    assert sorted((r.claim, r.unit, r.others) for r in now["contradictions"].collect()) == [("m1", "mg/l", 1), ("m2", "mg/l", 1)]
    second = bundles.families(df.where("id = 'c1'"), docs, spans, "t2", now["claims"])
    fails = second | {"edges": second["edges"].withColumn("dst", F.raise_error(F.lit("lost")).cast("string"))}
    with pytest.raises(Exception, match="lost"):
        bundles.written(spark, path, fails)
    assert {r.version for r in snapshots.opened(spark, path)["claims"].collect()} == {1}
    assert bundles.written(spark, path, second) == 2
    now = snapshots.opened(spark, path)
    assert {r.claim_id: r.version for r in now["claims"].collect() if r.version > 1} == {"c1": 2} and now["fact_versions"].count() == 8
    assert now["edges"].where("rel_type = 'SUPERSEDES'").count() == 1 and now["review_decisions"].count() == 1


def test_bundle_of_nothing(spark):
    none = spark.createDataFrame([], ARTIFACTS)
    out = bundles.families(none, spark.createDataFrame([], "document_id string"), spark.createDataFrame([], "span_id string, document_id string"), "t")
    path = storage.new_path(spark, "graph")
    bundles.written(spark, path, out)
    assert all(df.count() == 0 for df in snapshots.opened(spark, path).values())


def test_requests(spark):
    rows = [(1, "/a/x y.txt", b"abc"), (1, "/b/x y.txt", b"abc"), (2, "/a", b"12345"), (2, "/b", b"123456"), (3, "/a", b""), (4, "/a/", b"1"), (5, None, b"1"), (6, "/q", None), (7, "/r", b"1234567890")]
    df = spark.createDataFrame(rows, "request int, path string, content binary")
    folder = storage.new_path(spark, "objects")
    refused = {r.request: r.reason for r in files.stored(df, folder, 10).collect()}
    assert refused == {2: "upload_too_large", 3: "empty_file", 4: "invalid_file", 5: "invalid_file", 6: "empty_file"}
    found = files.read_back(spark, folder).collect()
    assert sorted((r.request, r.length, r.intact) for r in found) == [(1, 3, True), (7, 10, True)]
    assert all(r.object_key.startswith(f"uploads/{r.request}/") for r in found)
