"""Answers, audits and reports as text, JSON and CSV: each is a column or a narrow table that Spark writes in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an audit export: fixed values.
AUDIT = ["created_at", "action", "user_id", "resource_type", "resource_id", "details"]


def section(title: str, items: Column) -> Column:
    """A heading and a list; null where there are no items."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), lines))


def markdown(title: Column, answer: Column, sources: Column, gaps: Column, conflicts: Column) -> Column:
    """An answer's document: title, answer, and sections for sources, gaps and conflicts where there are any."""
    parts = F.array_compact(F.array(F.concat(F.lit("# "), title), answer, section("Sources", sources), section("Gaps", gaps), section("Conflicts", conflicts)))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))


def jsonld(answer_id: Column, created: Column, answer: Column, confidence: Column, question: Column, intent: Column, entities: Column, gaps: Column, conflicts: Column, evidence: Column, namespace: str, prefix: str = "ex") -> Column:
    """An answer's provenance as JSON-LD text. evidence: array of struct(id, document_id, page, start_offset, end_offset, source_type, claim_ids,
    entity_ids, score, method, text). namespace: the ontology's address."""
    p = f"{prefix}:"
    context = F.struct(F.lit(namespace).alias(prefix), F.lit("https://schema.org/").alias("schema"))

    def item(e: Column) -> Column:
        names = {"documentId": "document_id", "page": "page", "startOffset": "start_offset", "endOffset": "end_offset", "sourceType": "source_type", "claimIds": "claim_ids", "entityIds": "entity_ids", "relevanceScore": "score", "extractionMethod": "method"}
        return F.struct(F.lit(f"{p}SourceSpan").alias("@type"), F.concat(F.lit(f"{p}source-span:"), e["id"]).alias("@id"), *[e[c].alias(p + n) for n, c in names.items()], e["text"].alias("schema:text"))

    query = F.struct(F.lit(f"{p}QueryIR").alias("@type"), question.alias("schema:text"), intent.alias(f"{p}intent"), entities.alias(f"{p}entities"))
    body = F.struct(
        context.alias("@context"),
        F.lit(f"{p}Answer").alias("@type"),
        F.concat(F.lit(f"{p}answer:"), answer_id).alias("@id"),
        created.alias("schema:dateCreated"),
        answer.alias("schema:text"),
        confidence.alias(f"{p}confidence"),
        query.alias(f"{p}query"),
        gaps.alias(f"{p}gaps"),
        conflicts.alias(f"{p}conflicts"),
        F.transform(evidence, item).alias(f"{p}evidence"),
    )
    return F.to_json(body)


def sorted_json(details: Column) -> Column:
    """A map as JSON with its keys in order."""
    entries = F.array_sort(F.map_entries(details))
    return F.to_json(F.map_from_entries(entries))


def audit_rows(events: DataFrame) -> DataFrame:
    """events with AUDIT's columns, details a map -> the columns as text, details as JSON in order of keys."""
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events.select(time.alias("created_at"), *[F.col(c).cast("string").alias(c) for c in AUDIT[1:-1]], sorted_json(F.coalesce("details", F.create_map().cast("map<string,string>"))).alias("details"))


def csv_cell(value: Column) -> Column:
    """A cell in quotes where it has a comma, a quote or a line end; quotes are doubled."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame) -> DataFrame:
    """rows -> (line): a line of CSV for each, by RFC 4180; the header is `header`."""
    return rows.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in rows.columns]).alias("line"))


def header(rows: DataFrame) -> str:
    return ",".join(rows.columns)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_report(report: DataFrame, path: str, version: str) -> None:
    """A report (metric, value, status) of few rows as JSON and as a table in Markdown, the current one and one by version."""
    lines = report.orderBy("metric").select(F.concat(F.lit("| "), F.concat_ws(" | ", "metric", F.col("value").cast("string"), "status"), F.lit(" |")).alias("value"))
    for folder in ("current", version):
        report.coalesce(1).write.mode("overwrite").json(f"{path}/{folder}/json")
        lines.coalesce(1).write.mode("overwrite").text(f"{path}/{folder}/markdown")
