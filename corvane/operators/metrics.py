"""Metrics of answers against gold questions: a row for each question, then their means, gates and differences.

A metric that does not apply to a question is null, and means pass over nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import ids

#: Metric, threshold, and whether more is better: fixed values.
GATES = {"citation_coverage": (0.8, True), "unsupported_claim_rate": (0.1, False), "answer_completeness": (0.8, True), "query_trace_completeness": (1.0, True), "access_leak_rate": (0.0, False), "latency_ms_p95": (5000.0, False)}
NONE = "array<string>"


def low(values: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(values, F.array().cast(NONE)), F.lower))


def share(expected: Column, actual: Column) -> Column:
    """The share of expected values among the actual ones; null where nothing is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, actual)) / F.size(expected))


def span_ids(items: Column) -> Column:
    """items (array of struct(id, metadata_id, document_id, page, start_offset, end_offset, table_block_id)) -> every id that an item goes by, sorted."""
    own = lambda x: ids.span_id(x["document_id"], x["page"], x["start_offset"], x["end_offset"], x["table_block_id"])
    known = lambda x: x["document_id"].isNotNull() & x["page"].isNotNull() & x["start_offset"].isNotNull() & x["end_offset"].isNotNull()
    each = F.transform(items, lambda x: F.array(F.nullif(x["id"], F.lit("")), F.nullif(x["metadata_id"], F.lit("")), F.when(known(x), own(x))))
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(each))))


def citation_coverage(expected: Column, actual: Column) -> Column:
    """The share of expected spans among the actual ones; without expectation 1 where there is evidence, else 0."""
    return F.coalesce(share(expected, actual), F.when(F.size(actual) > 0, 1.0).otherwise(0.0))


def recall_at(expected: Column, ranked: Column, k: int = 10) -> Column:
    return share(expected, F.slice(ranked, 1, k))


def numeric_correctness(expected: Column, response: Column) -> Column:
    """The share of expected quantities (struct: value, unit, range_min, range_max as text) whose unit and value, or both bounds, the response has."""
    text = F.lower(response)
    has = lambda x: F.contains(text, F.lower(x))

    def right(q: Column) -> Column:
        unit = (F.coalesce(q["unit"], F.lit("")) == "") | has(q["unit"])
        both = q["range_min"].isNotNull() & q["range_max"].isNotNull()
        value = F.when(both, has(q["range_min"]) & has(q["range_max"])).when(q["value"].isNotNull(), has(q["value"])).otherwise(True)
        return unit & value

    return F.when(F.size(expected) > 0, F.size(F.filter(expected, right)) / F.size(expected))


def mean_of(*parts: Column) -> Column:
    """The mean of the parts that are not null; null where all are."""
    every = F.array_compact(F.array(*parts))
    return F.when(F.size(every) > 0, F.aggregate(every, F.lit(0.0), lambda s, x: s + x) / F.size(every))


def constraint_recall(units: Column, actual_units: Column, places: Column, actual_places: Column, time: Column, actual_time: Column) -> Column:
    """The mean over what is expected: units, places, and years (structs; all or nothing)."""
    right = F.when(time.isNotNull(), F.when(time.eqNullSafe(actual_time), 1.0).otherwise(0.0))
    return mean_of(share(low(units), low(actual_units)), share(low(places), low(actual_places)), right)


def unsupported_claim_rate(answer: Column, warnings: Column) -> Column:
    return warnings / F.greatest(F.lit(1), F.regexp_count(F.coalesce(answer, F.lit("")), F.lit("[.;]")))


def linking_f1(expected: Column, actual: Column) -> Column:
    e, a = low(expected), low(actual)
    both = F.size(F.array_intersect(e, a))
    return F.when(F.size(e) > 0, F.when(both == 0, 0.0).otherwise(2 * both / (F.size(e) + F.size(a))))


def review_rate(candidates: Column, with_codes: Column, warnings: Column) -> Column:
    return F.when(candidates > 0, F.least(F.lit(1.0), (with_codes + warnings) / candidates))


def completeness(outline: Column, answer: Column) -> Column:
    text = F.lower(F.coalesce(answer, F.lit("")))
    points = F.transform(F.coalesce(outline, F.array().cast(NONE)), F.lower)
    return F.when(F.size(points) > 0, F.when(text == "", 0.0).otherwise(F.size(F.filter(points, lambda p: F.contains(text, p))) / F.size(points)))


def geo_correctness(expected: Column, actual: Column, response: Column) -> Column:
    e, text = low(expected), F.lower(response)
    return F.when(F.size(e) > 0, F.size(F.filter(e, lambda p: F.array_contains(low(actual), p) | F.contains(text, p))) / F.size(e))


def conflict_accuracy(expected: Column, actual: Column) -> Column:
    return F.when(expected.isNotNull(), F.when(expected == F.coalesce(actual, F.lit(False)), 1.0).otherwise(0.0))


def gap_precision(expected: Column, gaps: Column) -> Column:
    """The share of gaps with a word that the expected gaps' text contains."""
    own = F.coalesce(gaps, F.array().cast(NONE))
    text = F.lower(F.array_join(expected, " "))
    hits = F.size(F.filter(own, lambda g: F.exists(F.filter(F.split(F.lower(g), r"\s+"), lambda w: w != ""), lambda w: F.contains(text, w))))
    some, wanted = F.size(own) > 0, expected.isNotNull() & (F.size(F.coalesce(expected, F.array().cast(NONE))) > 0)
    return F.when(~some, F.when(wanted, 0.0)).when(~wanted, 0.0).otherwise(hits / F.size(own))


def leak_rate(forbidden: Column, actual: Column) -> Column:
    return share(F.coalesce(forbidden, F.array().cast(NONE)), actual)


def provenance(evidence: Column) -> Column:
    """evidence (array of struct(id, document_id)) -> the share with both."""
    good = lambda x: (F.coalesce(x["id"], F.lit("")) != "") & (F.coalesce(x["document_id"], F.lit("")) != "")
    return F.when(F.size(evidence) > 0, F.size(F.filter(evidence, good)) / F.size(evidence))


def trace_completeness(*present: Column) -> Column:
    return sum((p.cast("int") for p in present), F.lit(0)) / len(present)


def means(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row of the names' means over rows that have them, to six digits."""
    return rows.agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def long(report: DataFrame) -> DataFrame:
    """A report of one row -> (metric, value)."""
    return report.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in report.columns])))


def gated(report: DataFrame, gates: dict[str, tuple[float, bool]] | None = None) -> DataFrame:
    """report (metric, value) -> (metric, value, threshold, status): pass or fail by its threshold, blocked where the report lacks it."""
    rows = [(m, float(t), more) for m, (t, more) in (GATES if gates is None else gates).items()]
    wanted = report.sparkSession.createDataFrame(rows, "metric string, threshold double, more boolean")
    passed = F.when(F.col("more"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    joined = F.broadcast(wanted).join(report, "metric", "left")
    return joined.select("metric", "value", "threshold", F.when(F.col("value").isNull(), "blocked").when(passed, "pass").otherwise("fail").alias("status"))


def overall(checks: DataFrame) -> DataFrame:
    """checks (status) -> one row (status): the worst of fail, blocked, warn and pass."""
    has = lambda s: F.count_if(F.col("status") == s) > 0
    return checks.agg(F.when(has("fail"), "fail").when(has("blocked"), "blocked").when(has("warn"), "warn").otherwise("pass").alias("status"))


def threshold_status(value: Column, threshold: Column, more: bool = True) -> Column:
    """pass, warn, or unknown without a value."""
    return F.when(value.isNull(), "unknown").when(value >= threshold if more else value <= threshold, "pass").otherwise("warn")


def dashboard(rows: DataFrame) -> DataFrame:
    """rows (question_id, official, status_code, has_evidence) -> totals, and how many official questions are blocked: failed or without evidence."""
    blocked = F.col("official") & ((F.col("status_code") != 200) | ~F.col("has_evidence"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status_code") == 200).alias("answered"), F.count_if("has_evidence").alias("with_evidence"), F.count_if("official").alias("official"), F.count_if(blocked).alias("blocked"))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two reports (metric, value, status) -> metric, delta, change: better, worse or same status; added or removed metrics say so."""
    order = F.create_map(*[F.lit(x) for pair in {"fail": 0, "blocked": 1, "warn": 2, "unknown": 2, "pass": 3}.items() for x in pair])
    b, a = (df.select("metric", F.col("value").alias(f"v{i}"), F.try_element_at(order, F.col("status")).alias(f"s{i}")) for i, df in enumerate((before, after)))
    joined = b.withColumn("in0", F.lit(True)).join(a.withColumn("in1", F.lit(True)), "metric", "full")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(F.col("s1") < F.col("s0"), "worse").when(F.col("s1") > F.col("s0"), "better").otherwise("same")
    return joined.select("metric", F.round(F.col("v1") - F.col("v0"), 6).alias("delta"), change.alias("change"))


def blockers(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Two lists (key) -> (key, change): new ones and resolved ones."""
    new = after.select(key).distinct().join(before, key, "left_anti").select(key, F.lit("new").alias("change"))
    return new.unionByName(before.select(key).distinct().join(after, key, "left_anti").select(key, F.lit("resolved").alias("change")))


def reliability(calls: DataFrame) -> DataFrame:
    """calls (outcome) -> (outcome, calls, share)."""
    counted = calls.groupBy("outcome").agg(F.count("*").alias("calls"))
    total = calls.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("outcome", "calls", F.round(F.col("calls") / F.col("total"), 6).alias("share"))  # one row


def inventory(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(name, rows, status): how many rows each table has, and whether that is as many as expected."""
    rows = None
    for name, df in tables.items():
        own = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(least.get(name)).cast("long").alias("least"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.select("name", "rows", F.when(F.col("least").isNull(), "unchecked").when(F.col("rows") >= F.col("least"), "pass").otherwise("fail").alias("status"))
