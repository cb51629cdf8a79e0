"""Order-preserving packing, running sums, state machines, the stored index and graph, and one-pass extraction, each against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import aliases, quantities
from corvane.functions.terms import OPERATORS, UNITS
from corvane.operators import graph, patterns, retrieval, state, storage
from corvane.sources import files


def packed(sizes, most):
    out, number, total, count = [], 0, 0, 0
    for size in sizes:
        if count and total + size > most:
            number, total, count = number + 1, 0, 0
        total, count = total + size, count + 1
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batches(spark, seed):
    """Empty files, files larger than a batch, files that just fit; one folder of all."""
    chance = random.Random(seed)
    sizes = [chance.choice([0, 0, 1, 5, 9, 10, 11, 40]) for _ in range(400)]
    rows = [(f"/in/{i:05d}", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(chance.sample(rows, len(rows)), "path string, length long").repartition(7)
    found = files.batches(df, 10)
    assert [r.batch for r in sorted(found.collect(), key=lambda r: r.path)] == packed(sizes, 10)
    done = spark.createDataFrame([(p,) for p, _ in rows[:57]], "path string")
    want = {b for (p, _), b in zip(rows, packed(sizes, 10), strict=True) if p not in {p for p, _ in rows[:57]}}
    left = files.still_to_do(found, done).collect()
    assert {r.batch for r in left} == want and len(left) == sum(b in want for b in packed(sizes, 10))


def test_batches_of_nothing(spark):
    assert files.batches(spark.createDataFrame([], "path string, length long"), 10).collect() == []
    assert [tuple(r) for r in files.batches(spark.createDataFrame([("a", 0)], "path string, length long"), 10).collect()] == [("a", 0, 0)]


def test_running(spark):
    rows = [(i % 37, i, i * 3 % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, x int").repartition(9)
    total, want = 0, {}
    for a, b, x in sorted(rows):
        total += x
        want[(a, b)] = total
    assert {(r.a, r.b): r.s for r in storage.running(df, ["a", "b"], s=F.col("x")).collect()} == want


def test_first_beyond(spark):
    chance = random.Random(1)
    marks = [(v, i) for i, v in enumerate(sorted(chance.randint(0, 50) for _ in range(60)))]
    asked = [(chance.randint(-2, 55), k) for k in range(80)]
    got = storage.first_beyond(spark.createDataFrame(marks, "value long, pos long"), spark.createDataFrame(asked, "target long, key long"))
    assert {r.key: r.pos for r in got.collect()} == {k: next((p for v, p in marks if v > t), None) for t, k in asked}


@pytest.mark.parametrize("machine, ongoing", [(state.DELETION, state.ONGOING), (state.REVIEW, set())])
def test_state_machines(spark, machine, ongoing):
    """Every event of interleaved keys in order: accepted, a repeat, or refused; null and unknown events are refused."""
    chance = random.Random(3)
    names = [*{e for _, e in machine}, "odd", None]
    rows = [(chance.choice([1, 2, 3, None]), i, chance.choice(names)) for i in range(600)]
    log = state.folded(spark.createDataFrame(rows, "key long, at long, event string").repartition(5), "key", ["at"], "event", machine, ongoing)
    got = {r.at: (r.before, r.after, r.verdict, r.run) for r in log.collect()}
    now, run = {}, {}
    for key, at, event in rows:
        before = now.get(key, "")
        after = machine.get((before, event))
        repeat = any(e == event and to == before for (_, e), to in machine.items())
        verdict = "accepted" if after or (before, event) in ongoing else "repeated" if repeat else "refused"
        if after:
            now[key] = after
            run[key] = run.get(key, 0) + (before in ("", "failed"))
        assert got[at] == (before, after or before, verdict, run.get(key, 0))
    last = {r.key: r for r in state.present(log, "key", ["at"]).collect()}
    assert {k: r.state for k, r in last.items()} == {k: now.get(k, "") for k in {r[0] for r in rows}}
    assert sum(r.accepted + r.repeated + r.refused for r in last.values()) == len(rows)


def test_upsert_is_the_same_each_time(spark):
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "c"), (1, "b")], "id int, v string")
    for rows in (new, new.orderBy("v"), new.orderBy(F.desc("v"))):
        assert state.upserted(old, rows, ["id"]).first().v == "b"


def test_index_is_read_and_not_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} common w{i % 3}") for i in range(300)], "id long, text string")
    path = f"{tmp_path}/index"
    retrieval.token_index(docs, "id", "text", path)
    index = spark.read.parquet(path)
    found = retrieval.lexical_from_index(index, "id", ["common", "word7"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]
    assert [(r.id, r.score) for r in found.collect()] == [(7, 1.0), (0, 0.5), (1, 0.5), (2, 0.5), (3, 0.5)]
    changed = spark.createDataFrame([(7, None), (8, "word7 common"), (999, "word7")], "id long, text string")
    again = retrieval.lexical_from_index(retrieval.index_after(index, changed, "id", "text"), "id", ["common", "word7"], 3)
    assert [(r.id, r.score) for r in again.collect()] == [(8, 1.0), (0, 0.5), (1, 0.5)]


@pytest.fixture(scope="module")
def small_graph(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = [("c1", "VALIDATED_BY", "p1"), ("c1", "VALIDATED_BY", "p1"), ("c1", "USES_MATERIAL", "m1"), ("c1", "DESCRIBED_IN", "s1"), ("s1", "PART_OF", "d1"), ("c1", "QUANTIFIED_BY", "q1"), ("c2", "RELATED_TO", "p2"), ("c2", "DESCRIBED_IN", "s2"), ("s2", "PART_OF", "d2")]
    return patterns.Graph(
        claims=of([("c1", "verified", 0.9, "2020", "1"), ("c2", "candidate", 0.5, "2021", "2")], "claim_id string, status string, confidence double, published string, updated string"), spans=of([("s1",), ("s2",)], "span_id string"),
        documents=of([("d1", "public"), ("d2", "restricted")], "document_id string, access_level string"), entities=of([("p1", "Flotation", "Process"), ("p2", "Leaching", "Process"), ("m1", "Nickel", "Material"), ("m2", "Slag", "Material")], "entity_id string, canonical_name string, domain_type string"),
        measurements=of([("q1", "mg/l", 5.0)], "measurement_id string, unit string, value double"), geographies=of([], "geo_id string, name string"), observations=of([], "observation_id string"), edges=of(edges, "src string, rel_type string, dst string"),
    )


def test_exact_search(spark, small_graph, tmp_path):
    """Patterns that can't run leave no rows and no crash; gaps stand beside the claims; a stored graph gives the same."""
    patterns.stored(small_graph, f"{tmp_path}/graph")
    for g in (small_graph, patterns.opened(spark, f"{tmp_path}/graph")):
        assert patterns.exact_search(g, patterns.Spec(patterns=["missing_data"])).collect() == [] and patterns.gaps(g, patterns.Spec(patterns=["missing_data"])).collect() == []
        assert patterns.exact_search(g, patterns.Spec()).collect() == []
        spec = patterns.Spec(hints=["flotation"], patterns=["missing_data", "entity_property", "comparison"])
        assert [tuple(r) for r in patterns.exact_search(g, spec).collect()] == [("c1", "s1", "entity_property", "q1")]
        assert [tuple(r) for r in patterns.gaps(g, spec).collect()] == [("p1", "m2"), ("p2", "m1"), ("p2", "m2")]
        assert [tuple(r) for r in patterns.gaps(g, patterns.Spec(hints=["x"], patterns=["missing_data"], limit=1)).collect()] == [("p1", "m2")]
    plan = patterns.opened(spark, f"{tmp_path}/graph").linked("PART_OF", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel_type" in plan and "Exchange" not in plan


def test_neighbours(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "src string, dst string")
    graph.stored_adjacency(edges, f"{tmp_path}/near")
    both = spark.read.parquet(f"{tmp_path}/near")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graph.neighbours(both, seeds, 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [(r.node, r.hop) for r in graph.neighbours(both, seeds, 2, limit=2).collect()] == [("a", 0), ("b", 1)]


PIECES = ["до", "не более", "НЕ  МЕНЕЕ", "<=", "<", "<<=", "≥", " ", "\n ", "5", "12,5", "3.", "10-20", "7 – 9", "-", "mg/l", "Г/Л", "%", "м/с", "kg/t", "x", "é", "мг/дм3", "более", "."]


def test_quantities_in_one_pass(spark):
    """The gated scanner finds what the plain pattern does, on texts put together from its parts."""
    chance = random.Random(11)
    texts = ["".join(chance.choice(PIECES) + chance.choice(["", " "]) for _ in range(chance.randint(0, 14))) for _ in range(3000)] + [None, ""]
    plain = re.compile(quantities.QUANTITY.replace(r"\s", r"[ \t\n\x0B\f\r]"), re.I)

    def expected(text):
        number = lambda x: float(x.replace(",", ".")) if x else None
        return [(number(a), UNITS.get(u.lower(), u.lower()), "range" if b else OPERATORS.get((o or "").lower(), "eq"), *((min(number(a), number(b)), max(number(a), number(b))) if b else (None, None))) for o, a, b, u in plain.findall(text or "")]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [tuple(q) for q in r.q] for r in df.select("i", quantities.quantities(F.col("t")).alias("q")).collect()}
    assert [(t, got[i], expected(t)) for i, t in enumerate(texts) if got[i] != expected(t)][:3] == []
    plan = df.select(quantities.quantities(F.col("t")).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_bracketed_in_one_pass(spark):
    chance = random.Random(12)
    parts = ["Long name", "x", " ", "  ", "(", ")", "(AB)", "(ab-1)", "(A)", "-", "word " * 30, ".", "é", "\n"]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 12))) for _ in range(2000)]
    plain = re.compile(aliases.BRACKETED, re.A)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [tuple(x) for x in r.a] for r in df.select("i", aliases.refs(F.col("t")).alias("a")).collect()}
    want = {i: [(m[2], " ".join(m[1].split())[-80:].strip(" -")) for m in plain.finditer(t)] for i, t in enumerate(texts)}
    assert [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]][:3] == []


def test_a_million_names(spark):
    """Names anywhere in a text, in one reading; a dictionary that is split gives the same."""
    from corvane.operators import dictionaries

    names = spark.range(1_000_000).select(F.concat(F.lit("Name "), F.col("id").cast("string"), F.lit(";")).alias("name")).union(spark.createDataFrame([(None,), ("",), ("überall",)], "name string"))
    rows = [(1, "a name 17; and NAME 999999;, ÜBERALL"), (2, None), (3, ""), (4, "name 17"), (5, "xname 17;name 18;name 17;")]
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = {(1, "name 17;"), (1, "name 999999;"), (1, "überall"), (5, "name 17;"), (5, "name 18;")}
    found = dictionaries.contained(texts, "id", "text", names, "name", most_bytes=1 << 30).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    few = names.where("name rlike ' 1[78];$' or name = 'überall'")
    parts = dictionaries.contained(texts, "id", "text", few, "name", most_bytes=100).collect()
    assert len(parts) == 4 and {tuple(r) for r in parts} == {w for w in want if "999999" not in w[1]}
    assert dictionaries.contained(texts, "id", "text", names.limit(0), "name").collect() == []


def test_joined_texts(spark):
    """No text is dropped unless the caller names a number."""
    from corvane.operators import catalog

    rows = spark.createDataFrame([("q", i, f"t{i}") for i in range(150)] + [("q", 150, None)], "q string, rank int, t string")
    assert catalog.joined_texts(rows, "q", "rank", "t").first().text == " ".join([*(f"t{i}" for i in range(150)), ""])
    assert catalog.joined_texts(rows, "q", "rank", "t", 2).first().text == "t0 t1"


def test_queries_of_the_graph_read_what_they_follow(spark):
    """Names are looked up without any line, claims without edges, and edges are narrow projections: no query writes the whole graph first."""
    from corvane.plans import graphs
    from corvane.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    read = lambda df: {f.rsplit("/", 1)[1] for f in df.inputFiles()}
    assert read(QUERIES["j14_resolve_alias"](spark, sf)) == {"supplier.parquet", "part.parquet"}
    assert read(QUERIES["j15_claims_by_id"](spark, sf)) == {"lineitem.parquet", "orders.parquet"}
    plan = graphs.graph(spark, sf).linked(("VALIDATED_BY", "RELATED_TO"), "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan
