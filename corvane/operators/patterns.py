"""Patterns over a property graph held as tables: a table for each kind of node, and one of edges (src, rel_type, dst).

Every pattern is a chain of equi-joins that starts from its most selective side; optional parts are left joins, conditions on them
semi-joins, and access is filtered before any limit. Limits have a total order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.storage import written

ABOUT = ("VALIDATED_BY", "RELATED_TO")
CONFLICTING = (*ABOUT, "OPERATES_AT_CONDITION", "USES_MATERIAL")
PROCESS = (*CONFLICTING, "PRODUCES_OUTPUT")
EVERY = (*PROCESS, "USES_EQUIPMENT", "EXPERT_IN")
MATERIALS = ("Material", "Substance")


@dataclass
class Graph:
    """claims (claim_id, status, confidence, published, updated), spans (span_id), documents (document_id, access_level), entities (entity_id,
    canonical_name, domain_type), measurements (measurement_id, unit, value), geographies (geo_id, name), observations (observation_id), edges."""

    claims: DataFrame
    spans: DataFrame
    documents: DataFrame
    entities: DataFrame
    measurements: DataFrame
    geographies: DataFrame
    observations: DataFrame
    edges: DataFrame
    #: Whether no edge is there twice, as in a graph that `stored` wrote.
    once: bool = False
    #: The edges (src, dst) of each type, where they are at hand as tables of their own; `edges` holds the same.
    by_type: dict[str, DataFrame] | None = None

    def linked(self, types: tuple[str, ...] | str, src: str, dst: str, to: DataFrame | None = None) -> DataFrame:
        """The distinct edges of these types as (src, dst) under other names; with `to`, a table of dst, only those that lead there."""
        types = (types,) if isinstance(types, str) else types
        if self.by_type is not None and any(t in self.by_type for t in types):
            types = tuple(t for t in types if t in self.by_type)
            found = reduce(DataFrame.unionByName, [self.by_type[t] for t in types]).select(F.col("src").alias(src), F.col("dst").alias(dst))
        else:
            found = self.edges.where(F.col("rel_type").isin(*types)).select(F.col("src").alias(src), F.col("dst").alias(dst))
        if to is not None:
            found = found.join(to, dst, "left_semi")
        return found if self.once and len(types) == 1 else found.distinct()

    def described(self, claims: DataFrame, levels: list[str], few: bool = False) -> DataFrame:
        """claims (claim_id, ...) with span_id and document_id: a row for each span that describes one, in documents of these access levels.

        `few` says that the claims are a small part of all: each step is then written, so that its size is known and the large side of the next join isn't shuffled."""
        step = (lambda df: written(df, "step")) if few else (lambda df: df)
        documents = self.documents.where(F.col("access_level").isin(*levels)).select("document_id")
        spans = step(step(claims).join(self.linked("DESCRIBED_IN", "claim_id", "span_id"), "claim_id"))
        placed = step(spans.join(self.linked("PART_OF", "span_id", "document_id"), "span_id"))
        if few:
            documents = documents.join(placed.select("document_id").distinct(), "document_id", "left_semi")
        return placed.join(documents, "document_id", "left_semi")

    def measured(self, claims: DataFrame | None = None) -> DataFrame:
        """(claim_id, measurement_id, unit, value) of claims that are quantified; with `claims`, a written table of claim_id, of those only."""
        edges = self.linked("QUANTIFIED_BY", "claim_id", "measurement_id")
        if claims is not None:
            edges = written(edges.join(claims.select("claim_id"), "claim_id", "left_semi"), "quantified")
        return edges.join(self.measurements, "measurement_id")


TABLES = ("claims", "spans", "documents", "entities", "measurements", "geographies", "observations")


def stored(g: Graph, path: str) -> None:
    """Writes the graph: its tables, and each edge once, in a folder for each type and sorted by src, so that a pattern reads the types that it follows."""
    for name in TABLES:
        getattr(g, name).write.parquet(f"{path}/{name}")
    edges = g.edges.select("src", "rel_type", "dst").distinct()
    edges.repartitionByRange("rel_type", "src").sortWithinPartitions("rel_type", "src", "dst").write.partitionBy("rel_type").parquet(f"{path}/edges")


def opened(spark: SparkSession, path: str) -> Graph:
    """The graph that `stored` wrote."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return Graph(**tables, edges=spark.read.schema("src string, dst string, rel_type string").parquet(f"{path}/edges").select("src", "rel_type", "dst"), once=True)


@dataclass
class Spec:
    """What a search asks for. None and empty lists ask for nothing."""

    entity_ids: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=lambda: ["public"])
    place: str | None = None
    low: float | None = None
    high: float | None = None
    after: str | None = None
    before: str | None = None
    groups: tuple[str, str] | None = None
    min_confidence: float | None = None
    status: str | None = None
    limit: int = 20
    patterns: list[str] = field(default_factory=list)


def seeds(g: Graph, spec: Spec, domain: str | None = None) -> DataFrame:
    """(entity_id) of the entities that the spec names by id or, without case, by name."""
    hints = [h.lower() for h in spec.hints]
    found = F.col("entity_id").isin(*spec.entity_ids) if spec.entity_ids else F.lit(False)
    found = found | (F.lower("canonical_name").isin(*hints) if hints else F.lit(False))
    return written(g.entities.where(found & (F.col("domain_type") == domain if domain else F.lit(True))).select("entity_id"), "seeds")


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def within(column: str, low, high) -> Column:
    """low <= column <= high, where an open side holds for all and null columns only meet open sides."""
    return every([F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None))


def in_place(g: Graph, claims: DataFrame, place: str | None) -> DataFrame:
    if place is None:
        return claims
    named = g.geographies.where(F.lower("name").contains(place.lower())).select("geo_id")
    return claims.join(g.linked("APPLIED_IN_GEOGRAPHY", "claim_id", "geo_id").join(named, "geo_id", "left_semi"), "claim_id", "left_semi")


def with_measures(g: Graph, claims: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Claims with some measurement from low on and some up to high: each bound by itself, as an existence."""
    bounds = [F.bool_or(F.col("_value") >= low)] * (low is not None) + [F.bool_or(F.col("_value") <= high)] * (high is not None)
    if not bounds:
        return claims
    claims = written(claims, "claims")
    held = g.measured(claims).select("claim_id", F.col("value").alias("_value")).groupBy("claim_id").agg(every(bounds).alias("_holds")).where("_holds")
    return claims.join(held.select("claim_id"), "claim_id", "left_semi").distinct()


def dated(claims: DataFrame, spec: Spec) -> DataFrame:
    return claims.where(within("published", spec.after, spec.before))


def cut(df: DataFrame, spec: Spec, *first: Column) -> DataFrame:
    return df.orderBy(*first, *[F.asc_nulls_last(c) for c in df.columns]).limit(spec.limit)


def subgraph_by_entity(g: Graph, spec: Spec) -> DataFrame:
    """(entity_id, claim_id, span_id, document_id) of claims on the entities named."""
    about = g.linked(ABOUT, "claim_id", "entity_id", seeds(g, spec))
    return cut(g.described(about, spec.levels, few=True).select("entity_id", "claim_id", "span_id", "document_id").distinct(), spec)


def subgraph_by_evidence(g: Graph, claim_ids: DataFrame, span_ids: DataFrame, levels: list[str]) -> DataFrame:
    """claim_ids (claim_id), span_ids (span_id) -> (claim_id, span_id, document_id, entity_id, measurement_id, geo_id, observation_id) around either."""
    described = g.linked("DESCRIBED_IN", "claim_id", "span_id")
    by_claim = written(described.join(written(claim_ids.select("claim_id"), "ids"), "claim_id", "left_semi"), "by_claim")
    span_ids = written(span_ids.select("span_id").distinct(), "ids")
    asked = written(by_claim.select("span_id").union(span_ids).distinct(), "asked")
    spans = written(g.linked("PART_OF", "span_id", "document_id").join(asked, "span_id", "left_semi"), "spans")
    documents = g.documents.where(F.col("access_level").isin(*levels)).select("document_id").join(spans.select("document_id").distinct(), "document_id", "left_semi")
    spans = written(spans.join(documents, "document_id", "left_semi"), "spans")
    by_span = spans.join(span_ids, "span_id", "left_semi").join(described.join(span_ids, "span_id", "left_semi"), "span_id", "left")
    seeded = by_claim.join(spans, "span_id").select("claim_id", "span_id", "document_id").union(by_span.select("claim_id", "span_id", "document_id")).distinct()
    seeded = written(seeded, "seeded")
    ids = seeded.select("claim_id").distinct()
    for types, name in ((EVERY, "entity_id"), ("QUANTIFIED_BY", "measurement_id"), ("APPLIED_IN_GEOGRAPHY", "geo_id"), ("DEGRADED_TO", "observation_id")):
        seeded = seeded.join(g.linked(types, "claim_id", name).join(ids, "claim_id", "left_semi"), "claim_id", "left")
    return seeded.distinct()


def filtered_claims(g: Graph, spec: Spec) -> DataFrame:
    """(claim_id, span_id, document_id) by confidence, status, place, measure and date; what is None filters nothing."""
    claims = g.claims.where(every([F.col("confidence") >= spec.min_confidence] * (spec.min_confidence is not None) + [F.col("status") == spec.status] * (spec.status is not None)))
    claims = with_measures(g, in_place(g, dated(claims, spec), spec.place), spec.low, spec.high)
    return cut(g.described(claims.select("claim_id").distinct(), spec.levels, few=True).select("claim_id", "span_id", "document_id").distinct(), spec)


def evidence(g: Graph, spec: Spec) -> DataFrame:
    """(claim_id, span_id, document_id, confidence, updated), the surest and latest first, of claims on the entities named, if any are."""
    claims = g.claims.select("claim_id", "confidence", "updated", "published")
    if spec.entity_ids or spec.hints:
        claims = claims.join(g.linked(ABOUT, "claim_id", "entity_id", seeds(g, spec)), "claim_id", "left_semi")
    claims = with_measures(g, in_place(g, dated(claims, spec), spec.place), spec.low, spec.high)
    rows = g.described(claims, spec.levels, few=True).select("claim_id", "span_id", "document_id", "confidence", "updated")
    return cut(rows, spec, F.desc_nulls_first("confidence"), F.desc_nulls_first("updated"))


def entity_property(g: Graph, spec: Spec) -> DataFrame:
    about = g.linked((*ABOUT, "EXPERT_IN"), "claim_id", "entity_id", seeds(g, spec))
    claims = g.claims.select("claim_id", "confidence", "published").join(about.select("claim_id").distinct(), "claim_id", "left_semi")
    claims = with_measures(g, in_place(g, dated(claims, spec), spec.place), spec.low, spec.high)
    return found(g, claims, spec, about, few=True)


def entity_process_measurement(g: Graph, spec: Spec) -> DataFrame:
    about = g.linked(PROCESS, "claim_id", "entity_id", seeds(g, spec, "Process"))
    claims = g.claims.select("claim_id", "confidence").join(about.select("claim_id").distinct(), "claim_id", "left_semi")
    return found(g, claims, spec, about, within("value", spec.low, spec.high), few=True)


def geo_indicator(g: Graph, spec: Spec) -> DataFrame:
    placed = g.linked("APPLIED_IN_GEOGRAPHY", "claim_id", "geo_id").join(g.geographies.where(F.lower("name").contains((spec.place or "").lower())).select("geo_id"), "geo_id", "left_semi")
    claims = g.claims.select("claim_id", "confidence").join(placed, "claim_id", "left_semi")
    return found(g, claims, spec, g.linked(ABOUT, "claim_id", "entity_id"))


def period_observation(g: Graph, spec: Spec) -> DataFrame:
    claims = dated(g.claims.select("claim_id", "confidence", "published"), spec)
    return found(g, claims, spec, g.linked(ABOUT, "claim_id", "entity_id"), first=[F.desc_nulls_first("published")], extra=["published"])


def group_key(g: Graph) -> Column:
    dimension = F.nullif("dimension", F.lit("")) if "dimension" in g.measurements.columns else F.lit(None).cast("string")
    return F.coalesce(dimension, F.nullif("unit", F.lit("")), F.lit("default"))


def comparison(g: Graph, spec: Spec) -> DataFrame:
    asked = group_key(g).isin(*(spec.groups or ()))
    claims = g.claims.select("claim_id", "confidence").join(g.measured().where(asked), "claim_id", "left_semi")
    return found(g, claims, spec, g.linked(ABOUT, "claim_id", "entity_id"), asked)


def found(g: Graph, claims: DataFrame, spec: Spec, about: DataFrame, asked: Column | None = None, first: list[Column] | None = None, extra: list[str] | None = None, few: bool = False) -> DataFrame:
    """claims with their spans and documents, and with entities and those measurements that are asked for, where there are any; the surest first.

    Claims are cut to the limit before they meet their optional parts: each keeps at least one row. What is left is written, and the parts are of these claims only."""
    rows = g.described(claims.select("claim_id", "confidence", *(extra or [])).distinct(), spec.levels, few)
    order = (*(first or []), F.desc_nulls_first("confidence"))
    rows = written(cut(rows.select("claim_id", "span_id", "document_id", "confidence", *(extra or [])), spec, *order), "first")
    ids = rows.select("claim_id").distinct()
    measured = g.measured(ids) if asked is None else g.measured(ids).where(asked)
    rows = rows.join(about.select("claim_id", "entity_id").join(ids, "claim_id", "left_semi"), "claim_id", "left").join(measured.select("claim_id", "measurement_id", "unit", "value"), "claim_id", "left")
    return cut(rows.select("claim_id", "span_id", "document_id", "entity_id", "measurement_id", "confidence", *(extra or [])).distinct(), spec, *order)


def conflicts(g: Graph, spec: Spec) -> DataFrame:
    """(entity_id, claim_id, other_id): claims on one of the entities named that contradict each other, by an edge or by values of one unit.

    At most `limit` pairs are asked for, so only the first `limit` claims that have a partner at all are joined with their group:
    a hot entity costs its claims so many times, not their pairs."""
    about = g.described(g.linked(CONFLICTING, "claim_id", "entity_id", seeds(g, spec)), spec.levels, few=True).select("entity_id", "claim_id").distinct()
    about = written(about, "about")
    values = about.join(g.measured(about).where("unit <> '' and value is not null"), "claim_id").select("entity_id", "claim_id", "unit", "value").distinct()
    values = written(values, "values")  # read four times
    latest = values.groupBy("entity_id", "unit", "value").agg(F.max("claim_id").alias("latest"))
    best = latest.groupBy("entity_id", "unit").agg(F.max(F.struct("latest", "value")).alias("a")).select("entity_id", "unit", F.col("a.latest").alias("best"), F.col("a.value").alias("best_value"))
    second = latest.join(best, ["entity_id", "unit"]).groupBy("entity_id", "unit", "best", "best_value").agg(F.max(F.when(F.col("value") != F.col("best_value"), F.col("latest"))).alias("next"))
    partner = F.when(F.col("value") != F.col("best_value"), F.col("best")).otherwise(F.col("next"))
    has = values.join(second, ["entity_id", "unit"]).where(partner > F.col("claim_id")).select("entity_id", "unit", "value", "claim_id")
    has = has.orderBy("entity_id", "claim_id", "unit", "value").limit(spec.limit)
    by_value = has.join(values.select("entity_id", "unit", F.col("claim_id").alias("other_id"), F.col("value").alias("other")), ["entity_id", "unit"]).where("other_id > claim_id and other <> value")
    edges = g.linked("CONTRADICTS", "claim_id", "other_id").where("claim_id < other_id").join(about, "claim_id").join(about.select("entity_id", F.col("claim_id").alias("other_id")), ["entity_id", "other_id"], "left_semi")
    return cut(by_value.select("entity_id", "claim_id", "other_id").union(edges.select("entity_id", "claim_id", "other_id")).distinct(), spec)


def missing_data(g: Graph, spec: Spec) -> DataFrame:
    """(process_id, material_id) without a quantified claim on both, the first `limit` of them.

    Each process that lacks a material at all gives one pair or more, so the first `limit` such processes are enough: they alone meet the materials."""
    processes = g.entities.where("domain_type = 'Process'").select(F.col("entity_id").alias("process_id"))
    materials = g.entities.where(F.col("domain_type").isin(*MATERIALS)).select(F.col("entity_id").alias("material_id"))
    measured = g.measured().select("claim_id").distinct()
    used = g.linked(ABOUT, "claim_id", "process_id", processes).join(g.linked((*ABOUT, "USES_MATERIAL", "PRODUCES_OUTPUT"), "claim_id", "material_id", materials), "claim_id").join(measured, "claim_id", "left_semi")
    used = written(used.select("process_id", "material_id").distinct(), "used")
    every_material = F.broadcast(materials.agg(F.count("*").alias("_every")))  # one row
    counts = processes.join(used.groupBy("process_id").agg(F.count("*").alias("_used")), "process_id", "left").crossJoin(every_material)
    lacking = counts.where(F.coalesce("_used", F.lit(0)) < F.col("_every")).select("process_id").orderBy("process_id").limit(spec.limit)
    lacking = written(lacking, "lacking")
    used = written(used.join(lacking, "process_id", "left_semi"), "used")
    pairs_of = materials.crossJoin(F.broadcast(lacking)).select("process_id", "material_id")  # at most `limit` processes
    return cut(pairs_of.join(used, ["process_id", "material_id"], "left_anti"), spec)


def pairs(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """All pairs of two catalogs, which are counted first; beyond `most` pairs this is refused."""
    n, m = left.count(), right.count()
    if n * m > most:
        raise ValueError(f"{n} x {m} pairs are more than {most}: name fewer entities")
    small, large = (left, right) if n <= m else (right, left)
    return large.crossJoin(F.broadcast(small)).select(*left.columns, *right.columns)


def resolve_alias(g: Graph, aliases: DataFrame, mention: str, limit: int = 10) -> DataFrame:
    """aliases (entity_id, name) -> (entity_id, rank): entities whose alias or name is the mention (1), begins with it (2) or contains it (3)."""
    names = aliases.select("entity_id", F.lower("name").alias("name")).union(g.entities.select("entity_id", F.lower("canonical_name")))
    word = mention.lower()
    rank = F.when(F.col("name") == word, 1).when(F.startswith("name", F.lit(word)), 2).when(F.contains("name", F.lit(word)), 3)
    return names.select("entity_id", rank.alias("rank")).where("rank is not null").groupBy("entity_id").agg(F.min("rank").alias("rank")).orderBy("rank", "entity_id").limit(limit)


def claims_by_id(g: Graph, ids: DataFrame) -> DataFrame:
    """ids (claim_id; repeats count) -> the claims' rows, one for each id that there is."""
    return ids.select("claim_id").join(g.claims, "claim_id")


def fact_versions(g: Graph, ids: DataFrame) -> DataFrame:
    """ids (claim_id) -> (claim_id, status, versions, superseded): distinct ids of its versions and of the claims it supersedes, sorted."""
    claims = g.claims.join(ids.select("claim_id"), "claim_id", "left_semi").select("claim_id", "status")
    gathered = lambda types, name: g.linked(types, "claim_id", "x").join(ids.select("claim_id"), "claim_id", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("x")).alias(name))
    out = claims.join(gathered("HAS_VERSION", "versions"), "claim_id", "left").join(gathered("SUPERSEDES", "superseded"), "claim_id", "left")
    none = F.array().cast("array<string>")
    return out.select("claim_id", "status", F.coalesce("versions", none).alias("versions"), F.coalesce("superseded", none).alias("superseded"))


def subgraph(g: Graph, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with columns of node ids -> (nodes (id, label, node_type), edges (id, source, target, edge_type)): distinct, without loops, labels of 200 characters."""
    rows = written(rows, "rows")
    kinds = {"entity_id": (g.entities, "canonical_name", "Entity"), "claim_id": (g.claims, "statement", "Claim"), "span_id": (g.spans, "text", "SourceSpan"), "document_id": (g.documents, "title", "Document"), "measurement_id": (g.measurements, "raw_text", "Measurement")}
    nodes = []
    for key, (table, label, kind) in kinds.items():
        if key in rows.columns:
            ids = rows.select(F.col(key).alias("id")).where("id is not null").distinct()
            text = F.col(label) if label in table.columns else F.lit(None).cast("string")
            named = table.join(ids.select(F.col("id").alias(key)), key, "left_semi").select(F.col(key).alias("id"), F.substring(F.coalesce(text, F.lit(kind)), 1, 200).alias("label"))
            nodes.append(ids.join(named, "id", "left").select("id", F.coalesce("label", F.lit(kind)).alias("label"), F.lit(kind).alias("node_type")))
    ends = written(reduce(DataFrame.union, nodes).dropDuplicates(["id"]), "nodes")
    inside = g.edges.join(ends.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").distinct()
    return ends, inside.select(F.concat_ws(":", "src", "rel_type", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("edge_type"))


PATTERNS: dict[str, Callable[[Graph, Spec], DataFrame]] = {
    "geo_indicator": geo_indicator,
    "period_observation": period_observation,
    "comparison": comparison,
    "entity_process_measurement": entity_process_measurement,
    "entity_property": entity_property,
    "conflicts": conflicts,
    "missing_data": missing_data,
}
def asked_for(spec: Spec) -> list[str]:
    """The spec's patterns without those that lack what they need: names for missing_data, groups for comparison."""
    lacks = {"missing_data": not (spec.hints or spec.entity_ids), "comparison": not spec.groups}
    return [name for name in spec.patterns if not lacks.get(name, False)]


def exact_search(g: Graph, spec: Spec) -> DataFrame:
    """(pattern, claim_id, span_id, measurement_id): what the spec's patterns find, each claim and span once under the first pattern that finds it, with
    the least of its measurements. Patterns that find no claims are in `gaps`; without any pattern there are no rows."""
    rows = g.claims.sparkSession.createDataFrame([], "rank int, pattern string, claim_id string, span_id string, measurement_id string")
    for rank, name in enumerate(asked_for(spec)):
        if name != "missing_data":
            own = PATTERNS[name](g, spec)
            given = lambda c: F.col(c) if c in own.columns else F.lit(None).cast("string")  # noqa: B023, E731
            rows = rows.unionByName(own.select(F.lit(rank).alias("rank"), F.lit(name).alias("pattern"), "claim_id", given("span_id").alias("span_id"), given("measurement_id").alias("measurement_id")))
    found = rows.groupBy("claim_id", "span_id").agg(F.min(F.struct("rank", "pattern")).alias("r"), F.min("measurement_id").alias("measurement_id"))
    return found.select("claim_id", "span_id", "r.pattern", "measurement_id")


def gaps(g: Graph, spec: Spec) -> DataFrame:
    """(process_id, material_id) that exact_search's missing_data finds without a measurement: the gaps of its answer, beside its rows. No rows where it isn't asked."""
    if "missing_data" not in asked_for(spec):
        return g.claims.sparkSession.createDataFrame([], "process_id string, material_id string")
    return missing_data(g, spec)


def search_state(found_rows: DataFrame, fallback: bool = False) -> DataFrame:
    """exact_search's rows -> one row (state): contradiction, no_evidence, partial or none, the first that holds."""
    n = found_rows.agg(F.count("claim_id").alias("claims"), F.count("span_id").alias("spans"), F.count_if(F.col("pattern") == "conflicts").alias("conflicts"))
    state = F.when(F.col("conflicts") > 0, "contradiction").when((F.col("claims") == 0) & (F.col("spans") == 0), "no_evidence").when((F.col("spans") == 0) | F.lit(fallback), "partial").otherwise("none")
    return n.select(state.alias("state"))


def exact_search_or_neighbours(g: Graph, aliases: DataFrame, spec: Spec) -> tuple[DataFrame, bool]:
    """exact_search after names are resolved; where it finds nothing, again from the aliases of the first three entities, ten in all. (rows, whether it fell back)"""
    ids = list(spec.entity_ids)
    if not ids:
        for hint in spec.hints:
            ids += [r.entity_id for r in resolve_alias(g, aliases, hint).collect()]  # at most ten rows a hint
    spec = replace(spec, entity_ids=list(dict.fromkeys(ids)))
    first = exact_search(g, spec)
    if not first.isEmpty():
        return first, False
    for entity in spec.entity_ids[:3]:
        ids += [r.entity_id for r in resolve_alias(g, aliases, entity).collect()]
    ids = list(dict.fromkeys(ids))[:10]
    if not ids:
        return first, True
    return exact_search(g, replace(spec, entity_ids=ids, patterns=["entity_property", "entity_process_measurement"])), True
