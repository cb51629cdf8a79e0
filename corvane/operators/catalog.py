"""Catalogs and projections for readers: documents with their state, gaps, chats, audits, coverage and ontology checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NONE = "array<string>"
#: Words that class a process, by direction; names of places by bucket; fields that an audit's details must have, by action: fixed values.
HYDRO = ["выщелач", "leach", "hydro", "гидро", "обессол", "флотац", "flotation"]
PYRO = ["плав", "smelt", "pyro", "пиро", "обжиг", "конверт"]
BUCKETS = {"domestic": ["отечественная", "domestic", "россия", "russia"], "foreign": ["зарубежная", "foreign", "international"], "unknown": ["неизвестно", "unknown"]}
REQUIRED = {"access_denied": ["reason", "required_level"], "policy_changed": ["before", "after"]}
#: Questions that only name a placeholder for a gap: a fixed value.
GAP = "Пробел знаний "


def item_status(spans: Column, points: Column) -> Column:
    """no_source_spans without spans, else no_index without points, else completed."""
    return F.when(spans == 0, "no_source_spans").when(points == 0, "no_index").otherwise("completed")


def items(documents: DataFrame) -> DataFrame:
    """documents (document_id, title, source_spans_count, indexed_points_count, deletion_status) -> the catalog's items, without those that are being deleted."""
    return documents.where(F.coalesce("deletion_status", F.lit("none")) == "none").withColumn("status", item_status(F.col("source_spans_count"), F.col("indexed_points_count"))).drop("deletion_status")


def in_status(status: str | None) -> Column:
    """A condition on documents for a status; without points also holds where there are no spans."""
    return {None: F.lit(True), "completed": (F.col("source_spans_count") > 0) & (F.col("indexed_points_count") > 0), "no_index": F.col("indexed_points_count") == 0, "no_source_spans": F.col("source_spans_count") == 0}[status]


def with_failed(catalog: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """The catalog and, as items of status failed, those sources of failed tasks that it lacks."""
    new = failed.join(catalog.select(key), key, "left_anti")
    return catalog.unionByName(new.withColumn("status", F.lit("failed")), allowMissingColumns=True)


def gap_labels(gaps: DataFrame) -> DataFrame:
    """gaps (i, gap_id, description, expected_relation, entity_ids, priority) -> (i, id, title, description, tags): titles of 80 characters, names where there are none."""
    text = F.trim(F.coalesce("description", F.lit("")))
    default = F.concat(F.lit(GAP), (F.col("i") + 1).cast("string"))
    title = F.when(text != "", F.substring(text, 1, 80)).otherwise(default)
    some = F.filter(F.coalesce("entity_ids", F.array().cast(NONE)), lambda e: e != "")
    named = F.when(F.size(some) > 0, F.concat(F.lit("Сущности: "), F.array_join(F.slice(some, 1, 3), ", ")))
    tags = F.array_compact(F.array(F.nullif(F.trim(F.coalesce("expected_relation", F.lit(""))), F.lit("")), F.coalesce("priority", F.lit("medium")), named))
    return gaps.select("i", F.coalesce("gap_id", F.concat(F.lit("gap-"), F.col("i").cast("string"))).alias("id"), title.alias("title"), F.when(text != "", text).otherwise(title).alias("description"), tags.alias("tags"))


def evidence_rows(evidence: DataFrame, run: str, rank: str, most: int = 8) -> DataFrame:
    """evidence (run, rank, span_id, document_id, page, text) -> the first `most` rows of a run that have text: run, rank, page, snippet of 160 characters, span_id."""
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = evidence.withColumn("snippet", F.substring(text, 1, 160)).where("snippet <> ''")
    place = F.row_number().over(W.partitionBy(run).orderBy(rank))
    page = F.concat(F.lit("Стр. "), F.coalesce(F.col("page").cast("string"), F.lit("—")))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(run, "place", page.alias("page"), "snippet", F.coalesce("span_id", "document_id", F.lit("source")).alias("span_id"))


def trace_steps(trace: Column) -> Column:
    """trace (array of struct(profile, selected, reason)) -> array<string>: a line for each step that was taken, then how many were not."""
    taken = F.transform(F.filter(trace, lambda t: t["selected"]), lambda t: F.concat_ws(": ", t["profile"], t["reason"]))
    return F.concat(taken, F.array(F.concat(F.lit("skipped: "), F.size(F.filter(trace, lambda t: ~t["selected"])).cast("string"))))


def ingestion_report(spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """spans (document_id, source_type), artifacts (document_id, status) -> a row a document of counts."""
    s = spans.groupBy("document_id").agg(F.count("*").alias("spans"), F.count_if(F.col("source_type") == "table").alias("table_spans"))
    a = artifacts.groupBy("document_id").agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") != "confirmed").alias("candidates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(a, "document_id", "full").select("document_id", zero("spans"), zero("table_spans"), zero("confirmed"), zero("candidates"))


def notifiable(artifacts: DataFrame) -> DataFrame:
    """Artifacts with an id, a kind and a value; rank: the confirmed ones first."""
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return artifacts.where(there("id") & there("kind") & there("value")).withColumn("rank", F.when(F.col("status") == "confirmed", 0).otherwise(1))


def verification_artifacts(evidence: DataFrame) -> DataFrame:
    """evidence (span_id, text, score) -> (id, kind, value, confidence, status): claims of confidence 0.1 at least."""
    return evidence.select(F.col("span_id").alias("id"), F.lit("claim").alias("kind"), F.col("text").alias("value"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.1)).alias("confidence"), F.lit("confirmed").alias("status"))


def evidence_records(rows: DataFrame) -> DataFrame:
    """Claims joined with spans and documents -> records: nulls as the readers expect them."""
    return rows.select("claim_id", F.coalesce("statement", F.lit("")).alias("statement"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("status", F.lit("candidate")).alias("status"), "span_id", F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)).alias("page"), F.coalesce("source_type", F.lit("text")).alias("source_type"), "document_id", "access_level")


def table_method(source_type: Column, method: Column) -> Column:
    return F.when((source_type == "table") & (method == "semantic"), "table").otherwise(method)


def graph_candidates(rows: DataFrame) -> DataFrame:
    """Claims of the graph that are not confirmed, with a statement -> (id, value, confidence, reason_code). Verified ones count as confirmed."""
    status = F.coalesce("status", F.lit("confirmed"))
    open_ = ~status.isin("confirmed", "verified", "auto_verified") & (F.coalesce("statement", F.lit("")) != "")
    return rows.where(open_).select(F.col("claim_id").alias("id"), F.col("statement").alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(status == "candidate", "schema_candidate").otherwise("unsupported_claim").alias("reason_code"))


def missing_details(events: DataFrame, required: dict[str, list[str]] | None = None) -> DataFrame:
    """events (id, action, details: map) -> (id, error): fields that an action's details lack, and actions that are unknown."""
    required = REQUIRED if required is None else required
    known = F.col("action").isin(*required)
    lacking = [F.when((F.col("action") == action) & (F.coalesce(F.try_element_at("details", F.lit(f)), F.lit("")) == ""), F.concat("action", F.lit(f" audit details missing '{f}'"))) for action, fields in required.items() for f in fields]
    errors = F.array_compact(F.array(F.when(~known, F.concat(F.lit("unsupported access audit action: "), "action")), *lacking))
    return events.select("id", F.explode(errors).alias("error"))


def audit(events: DataFrame, action: str | None = None, user=None, resource_type: str | None = None, since=None, until=None) -> DataFrame:
    """events (action, user_id, resource_type, created_at) by what is given; since counts, until doesn't."""
    for column, value in (("action", action), ("user_id", user), ("resource_type", resource_type)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if since is not None:
        events = events.where(F.col("created_at") >= F.lit(since))
    return events if until is None else events.where(F.col("created_at") < F.lit(until))


def of_owner(rows: DataFrame, user, is_admin: bool, column: str = "user_id") -> DataFrame:
    return rows if is_admin else rows.where(F.col(column) == user)


def facets(rows: DataFrame, query: str = "", material: str = "all", process: str = "all", geo: str = "all") -> DataFrame:
    """rows (title, material, process, geo) by facets; geo by any of a bucket's names; the query in any column."""
    if material != "all":
        rows = rows.where(F.col("material") == material)
    if process != "all":
        rows = rows.where(F.col("process") == process)
    if geo != "all":
        place = F.lower(F.coalesce("geo", F.lit("")))
        rows = rows.where(F.exists(F.array(*[F.lit(n) for n in BUCKETS.get(geo, [])]), lambda n: F.contains(place, n)))
    word = query.strip().lower()
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "material", "process", "geo")), F.lit(word))) if word else rows


def directions(processes: DataFrame, hydro: list[str] | None = None, pyro: list[str] | None = None) -> DataFrame:
    """processes (name, claim_count, document_count) -> (id, coverage to two digits, documents) of hydro and pyro; no rows where both are empty."""
    from corvane.functions.entities import any_of

    group = F.when(any_of(F.col("name"), hydro or HYDRO), "hydro").when(any_of(F.col("name"), pyro or PYRO), "pyro")
    counts = processes.select(group.alias("id"), "claim_count", "document_count").where("id is not null").groupBy("id").agg(F.bround(F.count_if(F.col("claim_count") > 0) / F.count("*"), 2).alias("coverage"), F.sum("document_count").alias("documents"))
    both = processes.sparkSession.createDataFrame([("hydro",), ("pyro",)], "id string").join(counts, "id", "left").select("id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("documents", F.lit(0)).alias("documents"))
    some = F.max((F.col("coverage") > 0) | (F.col("documents") > 0)).over(W.partitionBy())  # two rows
    return both.withColumn("some", some).where("some").drop("some")


def coverage_matrix(rows: DataFrame, row: str, column: str, names: list[str]) -> DataFrame:
    """How many rows there are of each pair, a column for each name."""
    return rows.groupBy(row).pivot(column, names).count().na.fill(0, names)


def requests(calls: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """calls -> keys, n and how many took up to each bound: counters and cumulative buckets by route and status."""
    return calls.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)])


def joined_texts(evidence: DataFrame, key: str, rank: str, text: str, most: int | None = None) -> DataFrame:
    """Evidence of a question as one text, joined by blanks in order of rank (ties: of text); the first `most` items where the caller names a number.

    The result is one text a question, as long as its evidence: name a number where evidence is not bounded otherwise."""
    rows = evidence.select(key, F.col(rank).alias("place"), F.coalesce(text, F.lit("")).alias("t"))
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("place", "t"))).where(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("place", "t")))
    return rows.groupBy(key).agg(parts.alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def comparable_key(kind: Column, metadata: Column) -> Column:
    """The key by which artifacts are compared: kind and seven fields of the metadata (a map), in one form; empty ones are left out."""
    from corvane.functions.text import alias_form

    get = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(metadata, F.lit(n)), F.lit("")) for n in names])
    fields = {"kind": kind, "property": F.coalesce(get("property", "parameter"), kind), "material": get("material"), "process": get("process"), "equipment": get("equipment"), "geography": get("geography", "geo"), "time": get("time", "date"), "condition": get("condition", "conditions")}
    form = lambda v: alias_form(F.replace(v, F.lit("_"), F.lit(" ")))
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), form(v))) for n, v in fields.items()])), "|")


def conflict_signals(artifacts: DataFrame) -> DataFrame:
    """artifacts (id, kind, metadata: map, unit, value, reason_codes) -> (key, reason, artifacts): groups of several units, of values further apart
    than the unit's tolerance, or with candidates that are marked. Groups are counted, never gathered."""
    from corvane.functions.quantities import tolerance

    rows = artifacts.where(F.col("kind").isin("measurement", "claim", "property")).select(comparable_key(F.col("kind"), F.col("metadata")).alias("key"), F.nullif("unit", F.lit("")).alias("unit"), "value", F.array_contains(F.coalesce("reason_codes", F.array().cast(NONE)), "conflicting_values").alias("marked"))
    groups = rows.groupBy("key").agg(F.min("unit").alias("u0"), F.max("unit").alias("u1"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"), F.count_if("marked").alias("marked"))
    several = F.col("u0") < F.col("u1")
    apart = (F.col("n") > 1) & (F.col("high") - F.col("low") > tolerance(F.coalesce("u1", F.lit(""))))
    signal = lambda holds, reason, n: F.when(holds, F.struct(F.lit(reason).alias("reason"), F.col(n).alias("artifacts")))
    found = F.array_compact(F.array(signal(F.coalesce(several, F.lit(False)), "needs_unit_check", "n"), signal(~F.coalesce(several, F.lit(False)) & apart, "conflicting_values", "n"), signal(~F.coalesce(several, F.lit(False)) & (F.col("marked") > 0), "marked_conflict", "marked")))
    return groups.select("key", F.inline(found))


#: The checks of the ontology, by rule: the column that it reads, what must hold and how grave a breach is. Fixed values.
def ontology_rules(low: float, high: float) -> dict[str, tuple[str, str]]:
    empty = "trim(coalesce({}, '')) <> ''"
    return {
        "material_has_name": (empty.format("name"), "error"),
        "measurement_has_unit": (empty.format("unit"), "error"),
        "quantity_within_physical_range": (f"value between {low} and {high}", "warning"),
        "source_has_span": ("size(source_span_ids) > 0", "error"),
        "confidence_in_range": ("confidence between 0 and 1", "error"),
        "geo_has_location": (empty.format("location_name"), "error"),
        "document_has_title": (empty.format("title"), "error"),
    }


def wrong_ends(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """edges (src, rel_type, dst), nodes (id, node_type), allowed (rel_type, src_type, dst_type) -> edges whose ends no rule allows."""
    typed = edges.join(nodes.select(F.col("id").alias("src"), F.col("node_type").alias("src_type")), "src", "left").join(nodes.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type")), "dst", "left")
    return typed.join(F.broadcast(allowed), ["rel_type", "src_type", "dst_type"], "left_anti").select("src", "rel_type", "dst", "src_type", "dst_type")
