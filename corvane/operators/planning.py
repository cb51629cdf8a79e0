"""From a question to a plan, as columns over any number of questions: its constraints, class, profiles, patterns and steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import aliases, entities, quantities, terms
from corvane.functions.entities import any_of
from corvane.functions.text import distinct_in_order, union_in_order

NONE = "array<string>"
#: Words that make a question comparative, or one about the graph; source types that are tables; words that ask for a pattern: fixed values.
COMPARATIVE = ["лучше", "хуже", "максимум", "минимум", "больше", "меньше", "vs", "versus", "между", "сравнен", "compare", "compared", "по сравнению", "выше", "ниже"]
GRAPH = ["связ", "граф", "claim", "противореч", "сосед", "цепочк", "отношен", "entity", "сущност"]
TABLES = ["table", "spreadsheet", "xlsx", "csv", "docx"]
PROCESS_HINTS = ["process", "процесс", "leaching", "выщелачивание", "flotation", "флотация"]
MATERIAL_HINTS = ["material", "substance", "материал", "вещество", "nickel", "никель", "cu", "медь"]
COMPARATIVE_HINTS = ["compare", "comparison", "сравн", "versus", "vs", "против"]
CONFLICT_HINTS = ["conflict", "contradict", "противореч", "расхожден"]
MISSING_HINTS = ["missing", "gap", "отсутств", "пробел", "нет данных"]
#: Abbreviations and formulas, which ask for the words themselves: fixed patterns.
ABBREVIATION = r"(?U)\b[A-ZА-Я]{2,6}\b"
FORMULA = r"[A-Z][a-z]?[0-9]*|[A-Z]{2,}"


def question_ir(questions: DataFrame, text: str) -> DataFrame:
    """questions with ir: what a question names and asks for (a struct). Deterministic: no model is called."""
    q = F.col(text)
    named = distinct_in_order(F.concat(entities.entities(q), entities.query_terms(q)))
    time = entities.time_constraint(q)
    known = F.transform(aliases.listed(q, aliases.CODES, 0.66), lambda k: F.substring_index(k["value"], " -> ", 1))
    own = F.transform(aliases.refs(q), lambda r: r["alias"])
    fields = {"raw_query": q, "entities": named, "intent": entities.intent(q), "numeric": quantities.quantities(q), "places": entities.places(q), "relative_years": time["relative_years"], "start_year": time["start_year"], "end_year": time["end_year"], "source_types": entities.source_types(q), "aliases": distinct_in_order(F.concat(own, known))}
    return questions.withColumn("ir", F.struct(*[c.alias(n) for n, c in fields.items()]))


def merged(rule: Column, other: Column) -> Column:
    """Two readings of a question: what the rules found comes first; entities are joined; what they lack is filled in."""
    filled = lambda n: F.when(F.size(rule[n]) > 0, rule[n]).otherwise(other[n])
    out = rule.withField("entities", distinct_in_order(F.concat(other["entities"], rule["entities"]))).withField("intent", F.coalesce(F.nullif(other["intent"], F.lit("")), rule["intent"]))
    for n in ("numeric", "places", "source_types", "aliases"):
        out = out.withField(n, filled(n))
    for n in ("relative_years", "start_year", "end_year"):
        out = out.withField(n, F.coalesce(rule[n], other[n]))
    return out


def window(ir: Column, now: int) -> Column:
    """struct<start_year, end_year>: the last n years up to `now`, a parameter so that reruns agree; else the years asked for."""
    last = ir["relative_years"]
    return F.struct(F.when(last.isNotNull(), now - last).otherwise(ir["start_year"]).alias("start_year"), F.when(last.isNotNull(), F.lit(now)).otherwise(ir["end_year"]).alias("end_year"))


def filters(ir: Column, legacy_types: Column | None = None, place: Column | None = None) -> Column:
    """struct<source_types, places, degraded>: older names of filters merged in, each value once; degraded names constraints that can't be met."""
    types = union_in_order(ir["source_types"], legacy_types) if legacy_types is not None else ir["source_types"]
    given = F.when(F.coalesce(place, F.lit("")) != "", F.array(place)).otherwise(F.array().cast(NONE)) if place is not None else F.array().cast(NONE)
    open_time = has_time(ir) & ir["relative_years"].isNull() & ir["start_year"].isNull() & ir["end_year"].isNull()
    degraded = F.when(open_time, F.array(F.lit("time_constraints_without_resolvable_interval"))).otherwise(F.array().cast(NONE))
    return F.struct(F.filter(types, lambda t: F.trim(t) != "").alias("source_types"), union_in_order(ir["places"], given).alias("places"), degraded.alias("degraded"))


def has_time(ir: Column) -> Column:
    return ir["relative_years"].isNotNull() | ir["start_year"].isNotNull() | ir["end_year"].isNotNull()


def query_class(ir: Column) -> Column:
    """semantic, numeric, geo, temporal, comparative, graph_centric or mixed: the first that the constraints and words ask for."""
    numeric, geo, time = F.size(ir["numeric"]) > 0, F.size(ir["places"]) > 0, has_time(ir)
    graph, compare = any_of(ir["raw_query"], GRAPH), any_of(ir["raw_query"], COMPARATIVE)
    families = reduce(lambda a, b: a + b, [x.cast("int") for x in (numeric, geo, time, graph)])
    return (
        F.when(numeric & compare, "comparative")
        .when(numeric & (families == 1), "numeric")
        .when(families >= 2, "mixed")
        .when(geo, "geo")
        .when(time, "temporal")
        .when(graph, "graph_centric")
        .otherwise("semantic")
    )


def profiles(ir: Column) -> Column:
    """array<struct<profile, selected, reason>> of the seven retrievers."""
    kind = query_class(ir)
    numeric, geo, time = F.size(ir["numeric"]) > 0, F.size(ir["places"]) > 0, has_time(ir)
    words = F.size(F.filter(F.split(ir["raw_query"], r"\s+"), lambda t: t != ""))
    lexical = (F.size(ir["entities"]) > 0) | words.between(1, 4) | ir["raw_query"].rlike(ABBREVIATION) | ir["raw_query"].rlike(FORMULA)
    table_hint = F.arrays_overlap(F.transform(ir["source_types"], F.lower), F.array(*[F.lit(t) for t in TABLES]))
    graph = kind.isin("graph_centric", "comparative", "mixed") | any_of(ir["raw_query"], GRAPH)
    rules = [
        ("semantic", (kind != "graph_centric") | numeric | geo | time, "semantic_fallback", "graph_only_lookup"),
        ("lexical", lexical, "lexical_entity_or_phrase_hint", "no_lexical_hint"),
        ("table", table_hint | kind.isin("numeric", "comparative", "mixed"), "table_or_numeric_source_hint", "no_table_hint"),
        ("numeric", numeric, "numeric_constraints_present", "no_numeric_constraints"),
        ("geo", geo, "geo_constraints_present", "no_geo_constraints"),
        ("time", time, "time_constraints_present", "no_time_constraints"),
        ("graph", graph, "graph_candidate_channel", "graph_not_requested"),
    ]
    return F.array(*[F.struct(F.lit(name).alias("profile"), on.alias("selected"), F.when(on, yes).otherwise(no).alias("reason")) for name, on, yes, no in rules])


def hinted(ir: Column, hints: list[str]) -> Column:
    """Whether a word of the question, an entity or the intent contains one of the hints, or is contained in one."""
    words = F.filter(F.split(F.replace(F.lower(ir["raw_query"]), F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    every = F.array_distinct(F.concat(words, F.transform(ir["entities"], F.lower), F.array(F.lower(ir["intent"]))))
    one = lambda w: reduce(lambda a, b: a | b, [F.contains(w, F.lit(h)) | F.contains(F.lit(h), w) for h in hints])
    return F.exists(every, one)


def graph_patterns(ir: Column, from_to: Column | None = None) -> Column:
    """array<string>: the graph patterns that a question asks for, in order; one by default."""
    named, numeric, geo = F.size(ir["entities"]) > 0, F.size(ir["numeric"]) > 0, F.size(ir["places"]) > 0
    time = has_time(ir) if from_to is None else from_to
    process = hinted(ir, PROCESS_HINTS)
    asked = [
        (geo, "geo_indicator"),
        (time, "period_observation"),
        (F.size(ir["entities"]) >= 2, "comparison"),
        (named & (process | hinted(ir, MATERIAL_HINTS) | numeric), "entity_process_measurement"),
        (named, "entity_property"),
        (named & (hinted(ir, CONFLICT_HINTS) | numeric), "conflicts"),
        (hinted(ir, MISSING_HINTS) | process, "missing_data"),
    ]
    found = F.array_compact(F.array(*[F.when(holds, name) for holds, name in asked]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("entity_property")))


def steps(ir: Column) -> Column:
    """array<string>: the operations of a plan, in order."""
    asked = [(F.size(ir["entities"]) > 0, "resolve_entities"), (F.size(ir["places"]) > 0, "geo_filter"), (F.size(ir["numeric"]) > 0, "numeric_filter"), (F.size(ir["source_types"]) > 0, "source_type_filter"), (has_time(ir), "time_filter")]
    return F.concat(F.array_compact(F.array(*[F.when(holds, name) for holds, name in asked])), F.array(F.lit("traverse_claims"), F.lit("rank_claims")))


#: Kinds of artifacts that become entities, the type of each, and the edge that a claim has to it: fixed values.
ENTITY_TYPES = {"entity": "Entity", "material": "Material", "substance": "Material", "process": "Process", "equipment": "Equipment", "property": "Property", "expert": "Expert", "source": "Source"}
ENTITY_EDGES = {"material": "USES_MATERIAL", "substance": "USES_MATERIAL", "process": "OPERATES_AT_CONDITION", "equipment": "USES_EQUIPMENT", "property": "PRODUCES_OUTPUT", "expert": "EXPERT_IN"}


def extracted(spans: DataFrame, key: str, text: str, document: str, threshold: float = 0.0, most: int | None = 120, nearly_spelt: bool = False) -> DataFrame:
    """spans -> artifacts (document, span, pos, kind, value, status, confidence, reason_codes) by rules, each (kind, value without case, status) once a document.

    Artifacts of a document are ranked by span and place, and cut at `most` for each status as the reports are, as are a span's values of a kind; with None nothing is cut. nearly_spelt: aliases are also
    transliterated names and those that a word nearly spells or is alike to (`aliases.every_alias`), each value once a span, the first of them."""
    from pyspark.sql import Window as W

    from corvane.functions.text import once, sentences

    t, none = F.col(text), F.array().cast(NONE)

    def rows(kind: str, values: Column, confidence: float, cap: int | None = None) -> Column:
        kept = F.slice(values, 1, cap) if cap and most is not None else values
        return F.transform(kept, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit("confirmed").alias("status"), F.lit(confidence).alias("confidence"), none.alias("reason_codes")))

    def alias_row(a: Column) -> Column:
        sure = F.size(a["reason_codes"]) == 0
        return F.struct(F.lit("alias").alias("kind"), a["value"].alias("value"), F.when(sure, "confirmed").otherwise("candidate").alias("status"), a["confidence"].alias("confidence"), a["reason_codes"].alias("reason_codes"))

    def claim_row(s: Column) -> Column:
        conflict = entities.has_conflict(s)
        return F.struct(F.lit("claim").alias("kind"), s.alias("value"), F.when(conflict, "candidate").otherwise("confirmed").alias("status"), F.when(conflict, 0.64).otherwise(0.82).alias("confidence"), F.when(conflict, F.array(F.lit("conflicting_values"))).otherwise(none).alias("reason_codes"))

    named = F.concat(aliases.judged(aliases.refs(t)), aliases.listed(t, aliases.CODES, 0.66))
    if nearly_spelt:
        spans = spans.withColumns({"_near": aliases.fuzzy(aliases.tokens_of(t, 4)), "_alike": aliases.alike(aliases.tokens_of(t, 3))})
        named = F.concat(aliases.known(t), aliases.spelt(F.col("_near")), aliases.spelt(F.col("_alike")))
    spans = once(spans, "_read", F.struct(sentences(t).alias("sentences"), entities.entities(t).alias("entities")))
    spans = once(spans, "_claims", F.filter("_read.sentences", entities.is_claim))
    claims, related = F.col("_claims"), entities.relation(t, F.col("_read.entities"))
    parts = [rows("entity", F.col("_read.entities"), 0.78, 8)]
    parts += [rows(kind, values, 0.79, 10) for kind, values in entities.domain_values(t, F.col("_read.sentences")).items()]
    parts += [F.transform(named, alias_row)]
    parts += [rows("measurement", F.transform(quantities.quantities(t), quantities.formatted), 0.88), F.transform(claims, claim_row)]
    parts += [rows("recommendation", F.filter(claims, lambda s: any_of(s, terms.RECOMMENDATIONS)), 0.8), rows("relation", F.when(related.isNotNull(), F.array(related)).otherwise(none), 0.74)]
    each = spans.select(F.col(document).alias("document"), F.col(key).alias("span"), F.posexplode(F.concat(*parts)).alias("pos", "a")).select("document", "span", "pos", "a.*")
    if nearly_spelt:  # an alias counts once a span, whatever its status
        once = ["document", "span", "kind", F.lower("value").alias("_low"), F.when(F.col("kind") != "alias", F.col("status")).alias("_status")]
        own = F.struct("pos", "value", "status", "confidence", "reason_codes")
        each = each.groupBy(*once).agg(F.min_by(own, "pos").alias("a")).select("document", "span", "a.pos", "kind", "a.value", "a.status", "a.confidence", "a.reason_codes")
    limit = max(0.72, threshold)
    low = (F.col("status") == "confirmed") & (F.col("confidence") < limit)
    each = each.withColumn("reason_codes", F.when(low, F.array(F.lit("low_confidence"))).otherwise(F.col("reason_codes"))).withColumn("status", F.when(low, "candidate").otherwise(F.col("status")))
    first = each.groupBy("document", "kind", F.lower("value").alias("_low"), "status").agg(F.min_by(F.struct("span", "pos", "value", "confidence", "reason_codes"), F.struct("span", "pos")).alias("a"))
    if most is not None:
        rank = F.row_number().over(W.partitionBy("document", "status").orderBy("a.span", "a.pos"))
        first = first.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return first.select("document", "a.span", "a.pos", "kind", "a.value", "status", "a.confidence", "a.reason_codes")


def unsourced(documents: DataFrame, key: str, text: str, most: int = 30) -> DataFrame:
    """Documents without spans -> (key, value, status, confidence, reason_codes): their claim sentences as candidates."""
    from corvane.functions.text import sentences

    kept = F.filter(F.slice(sentences(F.col(text)), 1, most), entities.is_claim)
    codes = F.array(F.lit("missing_source_span"), F.lit("low_confidence"))
    return documents.select(key, F.explode(kept).alias("value")).select(key, "value", F.lit("candidate").alias("status"), F.lit(0.42).alias("confidence"), codes.alias("reason_codes"))


def bundle(artifacts: DataFrame) -> dict[str, DataFrame]:
    """artifacts (id, kind, value, status, confidence, source_span_ids) -> the graph's tables, each routed by kind.

    claims (claim_id, statement, status, confidence), entities, candidates, relations, geographies, measurements, aliases and edges. Ids are
    made from the artifact's id and value, so a repeated run writes the same rows."""
    from corvane.functions import ids
    from corvane.functions.evidence import claim_status

    a = artifacts.where(F.trim("value") != "").withColumn("value", F.trim("value")).withColumn("short", F.substring("id", 1, 16))
    status = claim_status(F.col("status"), F.col("confidence"))
    sourced = F.size(F.coalesce("source_span_ids", F.array().cast(NONE))) > 0
    kinds = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    edges_of = F.create_map(*[F.lit(x) for pair in ENTITY_EDGES.items() for x in pair])
    type_ = F.try_element_at(kinds, F.col("kind"))
    entity = ids.entity_id(type_, F.col("value"))
    named = a.where(type_.isNotNull()).select(entity.alias("entity_id"), F.col("value").alias("canonical_name"), type_.alias("domain_type"), "short", "status", "kind", sourced.alias("sourced"), "source_span_ids", "confidence", status.alias("claim_status"))
    claims = a.where(F.col("kind").isin("claim", "conclusion", "recommendation") | (F.col("kind").isin("measurement", "geography") & sourced) | (type_.isNotNull() & sourced & (F.col("status") == "confirmed")))
    claims = claims.withColumn("claim_status", status)
    fan = claims.select(F.col("short").alias("src"), F.lit("DESCRIBED_IN").alias("rel_type"), F.explode("source_span_ids").alias("dst"))
    to_entity = named.where("sourced and status = 'confirmed'").select(F.col("short").alias("src"), F.coalesce(F.try_element_at(edges_of, F.col("kind")), F.lit("USES_MATERIAL")).alias("rel_type"), F.col("entity_id").alias("dst"))
    measured = a.where("kind = 'measurement'")
    to_measure = measured.where(sourced).select(F.col("short").alias("src"), F.lit("QUANTIFIED_BY").alias("rel_type"), F.concat(F.lit("q"), "short").alias("dst"))
    placed = a.where("kind = 'geography'")
    geo_id = F.substring(F.sha1(F.concat(F.lit("geo:"), F.lower("value"))), 1, 16)
    to_place = placed.where(sourced).select(F.col("short").alias("src"), F.lit("APPLIED_IN_GEOGRAPHY").alias("rel_type"), geo_id.alias("dst"))
    m = quantities.measurement(F.col("value"))
    return {
        "claims": claims.select(F.col("short").alias("claim_id"), F.col("value").alias("statement"), F.col("claim_status").alias("status"), "confidence"),
        "entities": named.groupBy("entity_id").agg(F.min("canonical_name").alias("canonical_name"), F.first("domain_type").alias("domain_type")),
        "candidates": a.where((F.col("status") != "confirmed") & (type_.isNotNull())).select(F.col("short").alias("candidate_id"), F.col("value").alias("raw_data")),
        "relations": a.where("kind = 'relation'").select(F.col("short").alias("candidate_id"), F.col("value").alias("raw_data")),
        "geographies": placed.select(geo_id.alias("geo_id"), F.col("value").alias("name")).distinct(),
        "measurements": measured.select(F.concat(F.lit("q"), "short").alias("measurement_id"), F.col("value").alias("raw_text"), m["value"].alias("value"), m["unit"].alias("unit")),
        "aliases": a.where("kind = 'alias'").select(F.col("short").alias("alias_id"), F.col("value").alias("name")),
        "edges": fan.unionByName(to_entity).unionByName(to_measure).unionByName(to_place).distinct(),
    }


def mined(spans: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """spans -> (key, rank, entities, quantities): the first `limit` spans that name an entity or a quantity, as gold questions."""
    rows = spans.select(key, F.size(entities.entities(F.col(text))).alias("entities"), F.size(quantities.quantities(F.col(text))).alias("quantities")).where("entities > 0 or quantities > 0")
    return rows.orderBy(key).limit(limit)
