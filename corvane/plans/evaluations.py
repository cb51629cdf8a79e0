"""Queries of evaluation and of state: orders are questions and runs, line items answers and claims, events an audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.operators import metrics, state
from corvane.plans.extraction import NOTES, joined, notes
from corvane.plans.queries import query, read


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions: expected and actual spans out of their returned and accepted parts."""
    of = lambda flag: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_partkey").cast("string")))))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(of("R").alias("expected"), of("A").alias("actual"))


ANSWERS = """a AS (SELECT l_orderkey AS id, coalesce(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'R'))), []) AS expected, coalesce(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'A'))), []) AS actual FROM lineitem GROUP BY 1)"""
BOTH = "len(list_intersect(expected, actual))"


@query(f"""WITH {ANSWERS} SELECT id, round(CASE WHEN len(expected) > 0 THEN {BOTH} / len(expected) WHEN len(actual) > 0 THEN 1.0 ELSE 0.0 END, 6) AS citation_coverage, round({BOTH} / nullif(len(expected), 0), 6) AS leak,
 round(len(list_intersect(expected, actual[:1])) / nullif(len(expected), 0), 6) AS recall_at_1, CASE WHEN len(expected) > 0 THEN round(2 * {BOTH} / (len(expected) + len(actual)), 6) END AS f1 FROM a""")
def e01_e04_e06_e12_sets(spark, sf_dir):
    e, a = F.col("expected"), F.col("actual")
    six = lambda c, name: F.round(c, 6).alias(name)
    return answers(spark, sf_dir).select("id", six(metrics.citation_coverage(e, a), "citation_coverage"), six(metrics.leak_rate(e, a), "leak"), six(metrics.recall_at(e, a, 1), "recall_at_1"), six(metrics.linking_f1(e, a), "f1"))


@query(f"""WITH {NOTES} SELECT doc_id, round((CAST(contains(low, '%') AND contains(low, '5') AS INTEGER) + CAST(contains(low, 'mg/l') AND contains(low, '10') AND contains(low, '23') AS INTEGER)) / 2.0, 6) AS numeric,
 round(CASE doc_id % 3 WHEN 0 THEN (0.5 + 1.0) / 2 WHEN 1 THEN 0.0 END, 6) AS recall, round(len(list_filter(['flotation', 'slag', 'norsk'], lambda p: contains(low, p))) / 3.0, 6) AS completeness,
 round(len(list_filter(['norilsk', 'россия', 'kola'], lambda p: p = 'kola' OR contains(low, p))) / 3.0, 6) AS geo FROM notes""")
def e02_e03_e08_e09_texts(spark, sf_dir):
    text = lambda v: F.lit(v).cast("string")
    quantity = lambda v, u, a, b: F.struct(text(v).alias("value"), text(u).alias("unit"), text(a).alias("range_min"), text(b).alias("range_max"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none, q = F.array().cast("array<string>"), F.col("doc_id") % 3
    time = lambda y: F.struct(F.lit(y).alias("start_year"))
    recall = metrics.constraint_recall(F.when(q == 0, words("MG/L", "%")).otherwise(none), words("mg/l"), none, none, F.when(q == 0, time(2019)).when(q == 1, time(2020)), F.when(q == 0, time(2019)))
    six = lambda c, name: F.round(c, 6).alias(name)
    return notes(spark, sf_dir).select(
        "doc_id",
        six(metrics.numeric_correctness(F.array(quantity("5", "%", None, None), quantity(None, "mg/l", "10", "23")), F.col("note")), "numeric"),
        six(recall, "recall"),
        six(metrics.completeness(words("Flotation", "slag", "norsk"), F.col("note")), "completeness"),
        six(metrics.geo_correctness(words("Norilsk", "Россия", "kola"), words("KOLA"), F.col("note")), "geo"),
    )


@query("""SELECT doc_id, round((doc_id % 4) / greatest(1, length(regexp_replace(coalesce(text, ''), '[^.;]', '', 'g'))), 6) AS unsupported, CASE WHEN doc_id % 5 > 0 THEN round(least(1.0, (doc_id % 3 + doc_id % 2) / (doc_id % 5)), 6) END AS review,
 CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 1 THEN CASE WHEN doc_id % 2 = 1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS conflict, round((2 + CAST(doc_id % 2 = 0 AS INTEGER)) / 3.0, 6) AS trace,
 CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 0.0 WHEN doc_id % 4 = 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS gap, CASE WHEN doc_id % 3 > 0 THEN 0.5 END::DOUBLE AS provenance FROM documents""")
def e05_e07_e10_e11_e13_e14(spark, sf_dir):
    d = F.col("doc_id")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.array().cast("array<string>")
    expected_gaps = F.when(d % 4 == 1, words("missing flow")).when(d % 4 == 3, words("no flow data"))
    gaps = F.when(d % 4 == 2, words("other")).when(d % 4 == 3, words("Flow unknown", "else here")).otherwise(none)
    item = lambda i, x: F.struct(F.lit(i).alias("id"), F.lit(x).alias("document_id"))
    evidence = F.when(d % 3 > 0, F.array(item("a", "d"), item("b", "")))
    six = lambda c, name: F.round(c, 6).alias(name)
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        six(metrics.unsupported_claim_rate(F.col("text"), d % 4), "unsupported"),
        six(metrics.review_rate(d % 5, d % 3, d % 2), "review"),
        metrics.conflict_accuracy(F.when(d % 3 == 0, d % 2 == 0).when(d % 3 == 1, d % 2 == 1), F.lit(True)).alias("conflict"),
        six(metrics.trace_completeness(F.lit(True), F.lit(True), d % 2 == 0), "trace"),
        six(metrics.gap_precision(expected_gaps, gaps), "gap"),
        six(metrics.provenance(evidence), "provenance"),
    )


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(['i' || doc_id % 3, CASE WHEN doc_id % 2 = 0 THEN 'm' END, substr(sha1(doc_id || ':1:0:' || n_chars || ':'), 1, 16)], lambda x: x IS NOT NULL))), '|') AS ids FROM documents")
def e15_span_ids(spark, sf_dir):
    d = F.col("doc_id")
    item = F.struct(F.concat(F.lit("i"), (d % 3).cast("string")).alias("id"), F.when(d % 2 == 0, "m").alias("metadata_id"), d.cast("string").alias("document_id"), F.lit(1).alias("page"), F.lit(0).alias("start_offset"), F.col("n_chars").alias("end_offset"), F.lit(None).cast("string").alias("table_block_id"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(metrics.span_ids(F.array(item)), "|").alias("ids"))


MEANS = f"""WITH {ANSWERS}, m AS (SELECT round(avg(CASE WHEN len(expected) > 0 THEN {BOTH} / len(expected) WHEN len(actual) > 0 THEN 1.0 ELSE 0.0 END), 6) AS citation_coverage, round(avg({BOTH} / nullif(len(expected), 0)), 6) AS access_leak_rate FROM a)"""
GATE_ROWS = ", ".join(f"('{m}', {t}::DOUBLE, {str(more).lower()})" for m, (t, more) in metrics.GATES.items())
GATED = f"""{MEANS}, r AS (SELECT 'citation_coverage' AS metric, citation_coverage AS value FROM m UNION ALL SELECT 'access_leak_rate', access_leak_rate FROM m), g AS (SELECT metric, value, threshold, CASE WHEN value IS NULL THEN 'blocked'
 WHEN CASE WHEN more THEN value >= threshold ELSE value <= threshold END THEN 'pass' ELSE 'fail' END AS status FROM (VALUES {GATE_ROWS}) AS t(metric, threshold, more) LEFT JOIN r USING (metric))"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a = F.col("expected"), F.col("actual")
    rows = answers(spark, sf_dir).select(metrics.citation_coverage(e, a).alias("citation_coverage"), metrics.leak_rate(e, a).alias("access_leak_rate"))
    return metrics.gated(metrics.long(metrics.means(rows, ["citation_coverage", "access_leak_rate"])))


@query(f"{GATED} SELECT * FROM g")
def e16_e17_gates(spark, sf_dir):
    return gates(spark, sf_dir)


@query(f"{GATED} SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'blocked') THEN 'blocked' ELSE 'pass' END AS status FROM g")
def a21_overall_status(spark, sf_dir):
    return metrics.overall(gates(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS answered, count(*) FILTER (o_totalprice > 1000) AS with_evidence, count(*) FILTER (o_orderpriority LIKE '1%') AS official,
 count(*) FILTER (o_orderpriority LIKE '1%' AND (o_orderstatus = 'F' OR o_totalprice <= 1000)) AS blocked FROM orders""")
def a18_dashboard(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").startswith("1").alias("official"), F.when(F.col("o_orderstatus") == "F", 500).otherwise(200).alias("status_code"), (F.col("o_totalprice") > 1000).alias("has_evidence"))
    return metrics.dashboard(rows)


@query("""WITH b AS (SELECT o_orderstatus AS metric, round(avg(o_totalprice), 6) AS v, count(*) > 100 AS p FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT o_orderstatus AS metric, round(avg(o_totalprice), 6) AS v, count(*) > 1000000 AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
 SELECT metric, round(a.v - b.v, 6) AS delta, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' WHEN b.p AND NOT a.p THEN 'worse' ELSE 'same' END AS change FROM b FULL JOIN a USING (metric)""")
def a19_regressions(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    report = lambda df, least: df.groupBy(F.col("o_orderstatus").alias("metric")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"), F.when(F.count("*") > least, "pass").otherwise("fail").alias("status"))
    return metrics.regressions(report(orders.where("o_orderkey % 2 = 0 and o_orderstatus <> 'P'"), 100), report(orders.where("o_orderkey % 2 = 1"), 1_000_000))


@query("SELECT user_id, CASE WHEN bool_or(d = 2) THEN 'new' ELSE 'resolved' END AS change FROM (SELECT DISTINCT user_id, CASE WHEN event_id < 2000 THEN 1 ELSE 2 END AS d FROM events WHERE event_type = 'error' AND event_id < 4000) GROUP BY 1 HAVING count(*) = 1")
def u05_blockers(spark, sf_dir):
    errors = read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id")
    return metrics.blockers(errors.where("event_id < 2000").select("user_id"), errors.where("event_id between 2000 and 3999").select("user_id"), "user_id")


OUTCOME = """CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 11 = 0 THEN 'stream_error' WHEN event_id % 7 = 0 THEN 'degraded_fallback' WHEN event_id % 5 = 0 OR event_id % 13 = 0 THEN 'degraded' WHEN event_type = 'view' THEN 'legacy_ok' WHEN event_type = 'click' THEN 'scientific_ok' ELSE 'ok' END"""


@query(f"SELECT {OUTCOME} AS outcome, count(*) AS calls, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def a20_v21_reliability(spark, sf_dir):
    from corvane.functions.verify import outcome

    e, kind = F.col("event_id"), F.col("event_type")
    warnings = F.array_compact(F.array(F.when(e % 7 == 0, "a fallback"), F.when(e % 13 == 0, "in conflict")))
    mode = F.when(kind == "view", "legacy").when(kind == "click", "top1_scientific")
    phase = F.when(e % 11 == 0, "error").when(e % 5 == 0, "degraded")
    return metrics.reliability(read(spark, sf_dir, "events").select(outcome(F.when(kind == "error", 500).otherwise(200), mode, warnings, phase).alias("outcome")))


@query("SELECT CASE WHEN event_id % 9 = 0 OR event_id % 7 = 0 OR value < 60 THEN 'degraded' ELSE 'done' END AS phase, count(*) AS n FROM events GROUP BY 1")
def v20_terminal_phases(spark, sf_dir):
    from corvane.functions.verify import terminal_phase

    e = F.col("event_id")
    phase = terminal_phase(F.col("value") / 100, F.array_compact(F.array(F.when(e % 7 == 0, "insufficient evidence"))), e % 9 == 0)
    return read(spark, sf_dir, "events").groupBy(phase.alias("phase")).agg(F.count("*").alias("n"))


@query("""SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS rows, 'pass' AS status UNION ALL SELECT 'region', (SELECT count(*) FROM region), 'fail' UNION ALL SELECT 'part', (SELECT count(*) FROM part), 'unchecked'""")
def a11_a12_inventory(spark, sf_dir):
    return metrics.inventory({t: read(spark, sf_dir, t) for t in ("nation", "region", "part")}, {"nation": 25, "region": 6})


@query("""SELECT o_orderkey AS claim_id, CASE WHEN o_custkey % 10 = 0 THEN 3 ELSE 2 END AS version, CASE WHEN o_custkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -c_custkey, 1, 'new' FROM customer WHERE c_custkey BETWEEN 1 AND 49""")
def m03_claim_upsert(spark, sf_dir):
    return claims_and_edges(spark, sf_dir)[0]


@query("""SELECT rel_type, count(*) AS n FROM (SELECT 'SUPERSEDES' AS rel_type FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT 'DESCRIBED_IN' FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT 'VALIDATED_BY' FROM orders, range(2) WHERE o_custkey % 10 = 0
 UNION ALL SELECT 'DESCRIBED_IN' FROM customer WHERE c_custkey BETWEEN 1 AND 49 UNION ALL SELECT 'VALIDATED_BY' FROM customer, range(2) WHERE c_custkey BETWEEN 1 AND 49) GROUP BY 1""")
def m03_claim_edges(spark, sf_dir):
    return claims_and_edges(spark, sf_dir)[1].groupBy("rel_type").agg(F.count("*").alias("n"))


def claims_and_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    old = orders.select(F.col("o_orderkey").alias("claim_id"), F.lit(2).alias("version"), F.col("o_orderstatus").alias("status"))
    again = orders.where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("claim_id"))
    new = again.union(read(spark, sf_dir, "customer").where("c_custkey between 1 and 49").select(-F.col("c_custkey")))
    words = lambda *w: F.array(*[F.concat(F.lit(x), F.col("claim_id").cast("string")) for x in w])
    return state.upserted_claims(old, new.select("claim_id", F.lit("new").alias("status"), words("s").alias("span_ids"), words("e", "f", "e").alias("entity_ids")))


@query("SELECT rel_type, semantic_type, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'USES_MATERIAL' ELSE 'RELATED_TO' END AS rel_type, CASE WHEN l_returnflag <> 'A' THEN lower(l_returnflag) END AS semantic_type FROM lineitem WHERE l_partkey % 2 = 0) GROUP BY 1, 2")
def m05_relations(spark, sf_dir):
    raw = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.when(F.col("l_returnflag") == "A", "uses_material").otherwise(F.lower("l_returnflag")).alias("type"), F.col("l_partkey").alias("dst"))
    targets = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))
    return state.relations(raw, targets).groupBy("rel_type", "semantic_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce('label ' || quality, source) AS title FROM documents LEFT JOIN labels USING (doc_id)")
def m06_catalog_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"))
    new = read(spark, sf_dir, "labels").join(old.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("title"))
    return state.upserted(old, new, ["doc_id"])


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'even' ELSE role END AS role FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2)")
def m07_span_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return state.upserted(old, old.where("turn % 2 = 0").withColumn("role", F.lit("even")), ["conv_id", "turn"])


LAST = "SELECT user_id, event_type AS state, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(LAST)
def m09_m10_m11_latest_state(spark, sf_dir):
    """Reviews, deletions and policies alike: the state is that of the last event."""
    events = read(spark, sf_dir, "events").withColumnRenamed("event_type", "state").withColumn("id", F.col("event_id"))
    return state.latest(events, ["user_id"], ["ts", "id"], "state", "event_id").select("user_id", "state", "event_id")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'active' WHEN n_nationkey = 3 THEN 'inactive' ELSE 'draft' END AS status FROM nation")
def m12_t13_activation(spark, sf_dir):
    versions = read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") == 3, "active").otherwise("draft").alias("status"))
    return state.activated(versions, "n_nationkey", 7)


@query("SELECT user_id, count(*) FILTER (event_id > coalesce(seen, -1)) AS unread FROM events LEFT JOIN (SELECT user_id, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id) GROUP BY 1")
def m14_a09_unread(spark, sf_dir):
    """A view marks all before it read: what is unread is counted against each user's last mark."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    seen = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("seen"))
    return events.join(seen, "user_id").groupBy("user_id").agg(F.count_if(F.col("event_id") > F.coalesce("seen", F.lit(-1))).alias("unread"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority AS label FROM orders WHERE o_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 0, c_mktsegment FROM customer WHERE c_custkey % 4 = 0")
def m15_replaced_children(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("label"))
    new = read(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(0).cast("long").alias("o_orderkey"), F.col("c_mktsegment").alias("label"))
    return state.replaced_children(old, new, "o_custkey")


@query("""SELECT user_id, CAST(floor(epoch_us(ended) / 1000.0) - floor(epoch_us(started) / 1000.0) AS BIGINT) - CASE WHEN epoch_us(ended) % 1000 < epoch_us(started) % 1000 THEN 1 ELSE 0 END AS latency_ms, state FROM (SELECT user_id, min(ts) FILTER (s = 'processing') AS started, max(ts) FILTER (s IN ('completed', 'failed')) AS ended, arg_max(s, (ts, s)) AS state
 FROM (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS s FROM events) GROUP BY 1) WHERE ended >= started""")
def m16_lifecycle(spark, sf_dir):
    kinds = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    runs = state.lifecycle(read(spark, sf_dir, "events").select("user_id", "ts", kinds.alias("s")), "user_id", "ts", "s")
    return runs.where("ended >= started").select("user_id", "latency_ms", "state")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def m19_cache_misses(spark, sf_dir):
    return state.missing_from(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents"), "doc_id")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey * 100 + l_orderkey % 100 AS p FROM lineitem), g AS (SELECT * FROM l WHERE o % 5 = 0), c AS (SELECT p FROM g EXCEPT SELECT p FROM l WHERE o % 5 <> 0)
 SELECT 'document' AS kind, count(DISTINCT o) AS n FROM g UNION ALL SELECT 'span', count(DISTINCT o) FROM g UNION ALL SELECT 'claim', count(*) FROM c UNION ALL SELECT 'node', count(*) FROM c ORDER BY 1""")
def j29_a25_cascade(spark, sf_dir):
    from corvane.plans.graphs import cascade_edges

    edges = cascade_edges(spark, sf_dir)
    gone = edges.where("rel_type = 'PART_OF'").select(F.col("dst").alias("document_id")).where("cast(substring(document_id, 2) as int) % 5 = 0").distinct()
    return state.cascade(gone, edges, gone)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT n.user_id, n.event_id AS notification, m.event_id AS match FROM (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1) n LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) m USING (user_id)""")
def j25_latest_match(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    notes_ = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("notification"))
    last = state.latest(events.where("event_type = 'purchase'").withColumn("match", F.col("event_id")), ["user_id"], ["ts", "event_id"], "match")
    return notes_.join(last, "user_id", "left")


@query("SELECT item_id, count(doc_id) AS reviews, coalesce(max(quality), -1) AS best FROM benchmark LEFT JOIN labels ON doc_id % 40 = item_id GROUP BY 1")
def j28_gold_reviews(spark, sf_dir):
    reviews = read(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 40).alias("item_id")).agg(F.count("*").alias("n"), F.max("quality").alias("q"))
    gold = read(spark, sf_dir, "benchmark").select("item_id").join(reviews, "item_id", "left")
    return gold.select("item_id", F.coalesce("n", F.lit(0)).alias("reviews"), F.coalesce("q", F.lit(-1)).alias("best"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT unnest([vec_id, vec_id + 1]) FROM embeddings WHERE label = 3) THEN 'conflicting_values' ELSE '' END AS codes FROM documents")
def j30_flagged(spark, sf_dir):
    signals = read(spark, sf_dir, "embeddings").where("label = 3").select(F.explode(F.array("vec_id", F.col("vec_id") + 1)).alias("doc_id")).distinct().withColumn("flag", F.lit("conflicting_values"))
    return read(spark, sf_dir, "documents").select("doc_id").join(signals, "doc_id", "left").select("doc_id", F.coalesce("flag", F.lit("")).alias("codes"))


@query("SELECT l_orderkey AS block, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS span FROM lineitem GROUP BY 1")
def j21_last_span_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_partkey").alias("span"), "l_linenumber", "l_partkey", "l_suppkey")
    return state.latest(rows, ["block"], ["l_linenumber", "l_partkey", "l_suppkey"], "span")


def machine(transitions: dict[tuple[str, str], str], ongoing: set[tuple[str, str]], action: str) -> str:
    """The same machine as a recursive query: an event after the other of each user."""
    rule = " ".join(f"WHEN {{s}} = '{s}' AND {{e}} = '{e}' THEN '{after}'" for (s, e), after in transitions.items())
    stays = " OR ".join(f"({{s}} = '{s}' AND {{e}} = '{e}')" for s, e in ongoing) or "false"
    repeats = " OR ".join(f"({{s}} = '{after}' AND {{e}} = '{e}')" for (_, e), after in dict.fromkeys(transitions.items()))
    step = lambda s, run: f"""{s} AS before, coalesce({f'CASE {rule} END'.format(s=s, e='e.action')}, {s}) AS after, CASE WHEN {f'CASE {rule} END'.format(s=s, e='e.action')} IS NOT NULL OR {stays.format(s=s, e='e.action')} THEN 'accepted'
 WHEN {repeats.format(s=s, e='e.action')} THEN 'repeated' ELSE 'refused' END AS verdict, {run} + CASE WHEN {f'CASE {rule} END'.format(s=s, e='e.action')} IS NOT NULL AND {s} IN ('', 'failed') THEN 1 ELSE 0 END AS run"""  # noqa: E731
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, {action} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 m AS (SELECT e.user_id, e.event_id, e.action, e.i, {step("''", '0')} FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.action, e.i, {step('m.after', 'm.run')} FROM m JOIN e ON e.user_id = m.user_id AND e.i = m.i + 1)"""


DELETE_ACTION = "CASE event_id % 8 WHEN 0 THEN 'begin' WHEN 1 THEN 'step' WHEN 2 THEN 'step' WHEN 3 THEN 'finalize' WHEN 4 THEN 'begin' WHEN 5 THEN 'step_failed' WHEN 6 THEN 'abort' ELSE 'purge' END"
REVIEW_ACTION = "CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'odd' END"


def events_as(spark, sf_dir, action: str):
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(action).alias("action"))


@query(f"{machine(state.DELETION, state.ONGOING, DELETE_ACTION)} SELECT user_id, event_id, action, before, after, verdict, run FROM m")
def m10_deletion_sagas(spark, sf_dir):
    """Interleaved and repeated steps of many deletions: each event with what it did, refused ones too."""
    log = state.folded(events_as(spark, sf_dir, DELETE_ACTION), "user_id", ["ts", "event_id"], "action", state.DELETION)
    return log.select("user_id", "event_id", "action", "before", "after", "verdict", "run")


@query(f"""{machine(state.DELETION, state.ONGOING, DELETE_ACTION)}, l AS (SELECT user_id, max(run) AS run FROM m GROUP BY 1)
 SELECT user_id, run, event_type AS step, count(*) AS times FROM m JOIN l USING (user_id, run) JOIN (SELECT event_id, event_type FROM events) USING (event_id) WHERE verdict = 'accepted' GROUP BY 1, 2, 3""")
def m10_steps_done(spark, sf_dir):
    log = state.folded(events_as(spark, sf_dir, DELETE_ACTION), "user_id", ["ts", "event_id"], "action", state.DELETION)
    return state.steps_done(log, read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("event_type", "step")


@query(f"""{machine(state.REVIEW, set(), REVIEW_ACTION)} SELECT user_id, arg_max(after, i) AS state, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'repeated') AS repeated, count(*) FILTER (verdict = 'refused') AS refused FROM m GROUP BY 1""")
def m09_reviews(spark, sf_dir):
    """A second request of what is pending is a repeat, a decision replaces the one before, and one on nothing is refused."""
    log = state.folded(events_as(spark, sf_dir, REVIEW_ACTION), "user_id", ["ts", "event_id"], "action", state.REVIEW, set())
    return state.present(log, "user_id", ["ts", "event_id"])


@query("SELECT user_id, arg_max(CASE WHEN event_id % 3 = 0 THEN event_type END, ts) FILTER (event_id % 3 = 0) AS level, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL AND event_id % 2 = 0) AS threshold, count(*) AS patches FROM (SELECT user_id, event_id, event_type, value, (ts, event_id) AS ts FROM events) GROUP BY 1")
def m11_patched_policies(spark, sf_dir):
    patches = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("level"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("threshold"))
    return state.patched(patches, "user_id", ["ts", "event_id"], ["level", "threshold"])
