"""The graph of extracted artifacts as a bundle of tables, merged into a graph and committed as one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.operators import graph, planning, snapshots

#: The families of a bundle, each with the key that its rows are merged by.
KEYS = {
    "documents": ["document_id"],
    "spans": ["span_id"],
    "entities": ["entity_id"],
    "aliases": ["alias_id"],
    "measurements": ["measurement_id"],
    "geographies": ["geo_id"],
    "observations": ["observation_id"],
    "experiments": ["experiment_id"],
    "candidates": ["candidate_id"],
    "relations": ["candidate_id"],
    "classes": ["candidate_id"],
    "review_decisions": ["decision_id"],
    "claims": ["claim_id"],
    "fact_versions": ["fact_version_id"],
    "edges": ["src", "rel_type", "dst"],
}
#: Kinds that have a family of their own; others that nobody has confirmed are candidates.
ROUTED = ["claim", "conclusion", "recommendation", "measurement", "geography", "alias", "relation", "review_decision"]
EXPERIMENT = "experiment_id string, description string, performed_at string"
CLASS = "candidate_id string, raw_data string"


def families(artifacts: DataFrame, documents: DataFrame, spans: DataFrame, at: str, before: DataFrame | None = None, experiments: DataFrame | None = None, classes: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a bundle. artifacts (id, kind, value, status, confidence, source_span_ids, metadata: map<string, string>, entity_names: array<string>),
    documents (document_id, ...), spans (span_id, document_id, ...); at: when it was recorded, a parameter so that reruns agree.

    A claim that `before` (claim_id, version) holds gets the next version, whose fact supersedes the former. Rows of one key are one row (the least)."""
    spark = artifacts.sparkSession
    out = planning.bundle(artifacts)
    value = F.trim("value")
    a = artifacts.where(value != "").select(F.substring("id", 1, 16).alias("short"), "kind", value.alias("value"), "status", "confidence", "source_span_ids", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("meta"), "entity_names")
    meta = lambda name, default: F.coalesce(F.try_element_at("meta", F.lit(name)), default)
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("rel_type"), dst.alias("dst"))
    short, degraded = F.col("short"), a.where("kind in ('conclusion', 'recommendation') and coalesce(status, 'candidate') <> 'confirmed'")
    observation = F.concat(F.lit("o"), short)

    aliases = a.where("kind = 'alias'").withColumn("target", F.trim(meta("canonical", F.col("value"))))
    named = a.where("kind in ('claim', 'measurement')").withColumn("name", F.explode("entity_names")).withColumn("name", F.trim("name")).where("name <> ''")
    sourced = named.where("kind = 'claim' or size(source_span_ids) > 0")
    target, entity = ids.entity_id(F.lit("Material"), F.col("target")), ids.entity_id(F.lit("Entity"), F.col("name"))
    new = aliases.select(target.alias("entity_id"), F.col("target").alias("canonical_name"), F.lit("Material").alias("domain_type"))
    new = new.unionByName(named.select(entity.alias("entity_id"), F.col("name").alias("canonical_name"), F.lit("Entity").alias("domain_type")))
    other = a.where(~F.col("kind").isin(*ROUTED, *planning.ENTITY_TYPES) & (F.coalesce("status", F.lit("candidate")) != "confirmed"))

    held = before.select("claim_id", F.col("version").alias("_before")) if before is not None else spark.createDataFrame([], "claim_id string, _before long")
    claims = once(out["claims"], ["claim_id"]).join(held, "claim_id", "left").withColumn("version", F.coalesce("_before", F.lit(0)).cast("long") + 1)
    fact = lambda version: F.substring(F.sha1(F.concat_ws(":", "claim_id", version.cast("string"))), 1, 16)
    facts = claims.select(fact(F.col("version")).alias("fact_version_id"), "claim_id", "version", "status", F.lit(at).alias("recorded_at"))
    again = claims.where("_before is not null")

    out["documents"], out["spans"] = documents, spans
    out["claims"] = claims.drop("_before")
    out["fact_versions"] = facts
    out["entities"] = out["entities"].unionByName(new)
    out["aliases"] = aliases.select(short.alias("alias_id"), F.col("value").alias("name"), target.alias("entity_id"), "confidence")
    out["observations"] = degraded.select(observation.alias("observation_id"), F.col("value").alias("description"), meta("context_raw", F.lit("")).alias("context_raw"))
    out["candidates"] = out["candidates"].unionByName(other.select(short.alias("candidate_id"), F.col("value").alias("raw_data")))
    out["relations"] = a.where("kind = 'relation'").select(short.alias("candidate_id"), F.col("value").alias("raw_data"), meta("relation_type", F.lit("unknown")).alias("relation_type"))
    out["review_decisions"] = a.where("kind = 'review_decision'").select(short.alias("decision_id"), meta("reviewer_id", F.lit("system")).alias("reviewer_id"), meta("status", F.coalesce("status", F.lit("pending"))).alias("status"), meta("comment", F.col("value")).alias("comment"), F.try_element_at("meta", F.lit("claim_id")).alias("claim_id"), F.lit(at).alias("decided_at"))
    out["experiments"] = experiments if experiments is not None else spark.createDataFrame([], EXPERIMENT)
    out["classes"] = classes if classes is not None else spark.createDataFrame([], CLASS)
    for more in (
        edge(spans, F.col("span_id"), "PART_OF", F.col("document_id").cast("string")),
        edge(aliases, target, "HAS_ALIAS", short),
        edge(degraded, short, "DEGRADED_TO", observation),
        edge(sourced, short, "VALIDATED_BY", entity),
        edge(claims, F.col("claim_id"), "HAS_VERSION", fact(F.col("version"))),
        edge(again, fact(F.col("version")), "SUPERSEDES", fact(F.col("_before"))),
    ):
        out["edges"] = out["edges"].unionByName(more)
    return {name: once(out[name], key) for name, key in KEYS.items()}


def once(df: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, the least by its other columns (maps left out of the order)."""
    rest = [f.name for f in df.schema if f.name not in key]
    if not rest:
        return df.distinct()
    order = F.struct(*[f.name for f in df.schema if f.name not in key and f.dataType.typeName() != "map"])
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*").select(*df.columns)


def contradictions(edges: DataFrame, measurements: DataFrame) -> DataFrame:
    """(claim, entity, unit, others): claims quantified in one unit and tied to one entity whose values differ, and with how many claims each does.

    The pairs themselves aren't listed: a hot entity has a row a claim."""
    quantified = edges.where("rel_type = 'QUANTIFIED_BY'").select(F.col("src").alias("claim"), F.col("dst").alias("measurement_id"))
    values = quantified.join(measurements.where("value is not null and unit <> ''"), "measurement_id").select("claim", "unit", "value")
    tied = edges.where("rel_type in ('VALIDATED_BY', 'RELATED_TO')").select(F.col("src").alias("claim"), F.col("dst").alias("entity"))
    return graph.contradicting(values.join(tied, "claim").select("claim", "entity", "unit", "value").distinct())


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those that have their keys."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new)


def written(spark: SparkSession, path: str, bundle: dict[str, DataFrame]) -> int:
    """Merges a bundle into the graph at path and commits all its tables, contradictions among them, as the next snapshot: all or nothing.

    The bundle may have been made from the snapshot it is merged into: snapshots never change, so a failed commit can be done again."""
    now = snapshots.opened(spark, path)
    tables = {name: merged(now[name], df, KEYS[name]) if name in now else df for name, df in bundle.items()}
    tables["contradictions"] = contradictions(tables["edges"], tables["measurements"])
    return snapshots.committed(tables, path)
