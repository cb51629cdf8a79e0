"""Verification of evidence against what a question asks: coverage, reason codes, layers, scores, gaps and answers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import entities, quantities, terms
from corvane.functions.text import alias_form, distinct_in_order, let

NONE = "array<string>"
#: Artifacts below this confidence are never confirmed, and a candidate has this confidence at most: fixed values.
CONFIRMED, CANDIDATE = 0.72, 0.68
#: Words of an answer: fixed values.
NO_EVIDENCE = "Недостаточно подтвержденных источников для фактического ответа. Неподтвержденные кандидаты оставлены для экспертной проверки."
ANSWER, WITH_GAPS, WITH_CONFLICTS = "По подтвержденным источникам найдены опорные фрагменты: ", " Есть пробелы в доказательствах.", " Есть признаки конфликта источников."


def asked(numeric: Column | None = None, places: Column | None = None, start_year: Column | None = None, end_year: Column | None = None, has_time: Column | None = None, source_types: Column | None = None, named: Column | None = None, aliases: Column | None = None) -> Column:
    """A struct of what a question asks for; what is left out asks for nothing."""
    none = F.array().cast(NONE)
    no_numbers = F.array().cast("array<struct<value: double, unit: string, operator: string, range_min: double, range_max: double>>")
    parts = {"numeric": (numeric, no_numbers), "places": (places, none), "start_year": (start_year, F.lit(None).cast("int")), "end_year": (end_year, F.lit(None).cast("int")), "has_time": (has_time, F.lit(False)), "source_types": (source_types, none), "named": (named, none), "aliases": (aliases, none)}
    return F.struct(*[F.coalesce(given, default).alias(n) if given is not None else default.alias(n) for n, (given, default) in parts.items()])


def contains_any(text: Column, words: Column) -> Column:
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.exists(words, lambda w: (w != "") & F.contains(low, F.lower(w))))


def time_covered(text: Column, start: Column, end: Column) -> Column:
    """Whether the text has a year within the range, or any year where the range is open."""
    closed = start.isNotNull() & end.isNotNull()
    return let(entities.years(text), lambda found: F.when(F.size(found) == 0, False).when(closed, F.exists(found, lambda y: y.between(start, end))).otherwise(True))


def places_covered(text: Column, places: Column) -> Column:
    """Whether the text has every place, as it is written or by a name that it goes by."""
    covered = lambda form, extracted: F.forall(places, lambda p: F.contains(form, alias_form(p)) | F.array_contains(extracted, alias_form(p)))
    return let(alias_form(text), lambda form: let(F.transform(entities.places(text), alias_form), lambda extracted: covered(form, extracted)))


def reason_codes(span_id: Column, text: Column, ask: Column) -> Column:
    """array<string>: why a span is no evidence for what is asked; empty where it is. The text's quantities are read once."""
    return let(quantities.quantities(text), lambda found: _reason_codes(span_id, text, ask, found))


def _reason_codes(span_id: Column, text: Column, ask: Column, found: Column) -> Column:
    asked_units = F.transform(F.filter(ask["numeric"], lambda a: F.coalesce(a["unit"], F.lit("")) != ""), lambda a: quantities.unit_name(a["unit"]))
    own = F.array_distinct(F.transform(found, lambda q: q["unit"]))
    other = let(asked_units, lambda units: let(own, lambda has: (F.size(units) > 0) & (F.size(has) > 0) & ~F.arrays_overlap(units, has)))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    codes = [
        F.when(F.coalesce(span_id, F.lit("")).eqNullSafe("") | blank, "missing_source_span"),
        F.when((F.size(ask["numeric"]) > 0) & ~quantities.covers_all(found, ask["numeric"]), F.when(other, "unit_mismatch").otherwise("unsupported_claim")),
        F.when((F.size(ask["places"]) > 0) & ~places_covered(text, ask["places"]), "geo_mismatch"),
        F.when(ask["has_time"] & ~time_covered(text, ask["start_year"], ask["end_year"]), "outside_time_range"),
        F.when((F.size(ask["source_types"]) > 0) & ~contains_any(text, ask["source_types"]), "inaccessible_source"),
        F.when((F.size(ask["named"]) > 0) & ~contains_any(text, ask["named"]), "unresolved_alias"),
    ]
    return F.array_compact(F.array(*codes))


def local_codes(text: Column, ask: Column) -> Column:
    """array<string>: the quick check, by whether there is any number, any of the places, and any year."""
    body = F.coalesce(text, F.lit(""))
    codes = [
        F.when((F.size(ask["numeric"]) > 0) & ~body.rlike("[0-9]"), "unit_mismatch"),
        F.when((F.size(ask["places"]) > 0) & ~contains_any(text, ask["places"]), "geo_mismatch"),
        F.when(ask["has_time"] & ~body.rlike(entities.YEAR), "outside_time_range"),
    ]
    return F.array_compact(F.array(*codes))


def layer(codes: Column) -> Column:
    """verified without codes; else conflicting, unsupported or candidate, the first that a code asks for."""
    among = lambda names: F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))
    return F.when(F.size(codes) == 0, "verified").when(among(terms.CONFLICTING_CODES), "conflicting").when(among(terms.UNSUPPORTED_CODES), "unsupported").otherwise("candidate")


def constraint_score(text: Column, ask: Column) -> Column:
    """0.45 for any quantity where some are asked, 0.25 for a place, 0.15 for an alias, 0.15 for a year."""
    parts = [
        F.when((F.size(ask["numeric"]) > 0) & entities.has_quantity(text), 0.45),
        F.when(contains_any(text, ask["places"]), 0.25),
        F.when(contains_any(text, ask["aliases"]), 0.15),
        F.when(ask["has_time"] & F.coalesce(text, F.lit("")).rlike(r"(?U)\b20[0-9]{2}\b"), 0.15),
    ]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]))


def reranked_score(overlap: Column, constraint: Column, base: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.45 * overlap + 0.35 * constraint + 0.2 * F.greatest(base, F.lit(0.0))), 6)


def constraints_match(text: Column, ask: Column) -> Column:
    """Whether the text names a place that is asked, or has a digit where quantities are."""
    return contains_any(text, ask["places"]) | ((F.size(ask["numeric"]) > 0) & F.coalesce(text, F.lit("")).rlike("[0-9]"))


def evidence_score(overlap: Column, text: Column, ask: Column) -> Column:
    return F.least(F.lit(1.0), F.round(overlap + F.when(constraints_match(text, ask), 0.25).otherwise(0.0), 6))


def normalised(status: Column, confidence: Column, spans: Column, known: Column, codes: Column) -> Column:
    """An artifact from outside: struct<status, confidence, source_span_ids, reason_codes>. Confirmed only with known spans, confidence and no codes."""
    own = F.array_intersect(F.coalesce(spans, F.array().cast(NONE)), known)
    given = F.coalesce(codes, F.array().cast(NONE))
    sure = (status == "confirmed") & (F.size(own) > 0) & (confidence >= CONFIRMED) & (F.size(given) == 0)
    more = F.array_compact(F.array(F.when(F.size(own) == 0, "missing_source_span"), F.when(confidence < CONFIRMED, "low_confidence")))
    all_codes = distinct_in_order(F.concat(given, more))
    reasons = F.when(F.size(all_codes) > 0, all_codes).otherwise(F.array(F.lit("schema_candidate")))
    sure = F.coalesce(sure, F.lit(False))
    return F.struct(
        F.when(sure, "confirmed").otherwise("candidate").alias("status"),
        F.when(sure, confidence).otherwise(F.least(confidence, F.lit(CANDIDATE))).alias("confidence"),
        F.when(sure, own).otherwise(F.array().cast(NONE)).alias("source_span_ids"),
        F.when(sure, F.array().cast(NONE)).otherwise(reasons).alias("reason_codes"),
    )


def answer(snippets: Column, has_gaps: Column, has_conflicts: Column) -> Column:
    """The answer out of the first three snippets of verified evidence."""
    text = F.concat(F.lit(ANSWER), F.array_join(F.slice(snippets, 1, 3), " | "), F.when(has_gaps, WITH_GAPS).otherwise(""), F.when(has_conflicts, WITH_CONFLICTS).otherwise(""))
    return F.when(F.size(snippets) == 0, NO_EVIDENCE).otherwise(text)


def limitations(candidates: Column, unsupported: Column, conflicting: Column) -> Column:
    """array<string> by how many statements a layer has."""
    names = ((candidates, "candidate_evidence_requires_review"), (unsupported, "unsupported_claims_excluded"), (conflicting, "conflicting_evidence_requires_resolution"))
    return F.array_compact(F.array(*[F.when(n > 0, name) for n, name in names]))


def follow_up(gaps: Column, conflicts: Column, candidates: Column, unsupported: Column, conflicting: Column) -> Column:
    names = ((gaps | (unsupported > 0), "collect_or_link_missing_sources"), (conflicts | (conflicting > 0), "resolve_conflicting_measurements_or_conditions"), (candidates > 0, "review_candidate_reason_codes"))
    return F.array_compact(F.array(*[F.when(holds, name) for holds, name in names]))


def gaps(n_evidence: Column, text: Column, ask: Column, n_candidates: Column, has_conflicts: Column) -> Column:
    """array<struct<gap_type, priority>>: what the evidence, its texts joined by blanks, leaves open."""
    return let(quantities.quantities(text), lambda found: _gaps(n_evidence, text, ask, n_candidates, has_conflicts, found))


def _gaps(n_evidence: Column, text: Column, ask: Column, n_candidates: Column, has_conflicts: Column, found: Column) -> Column:
    missing = (F.size(ask["named"]) > 0) & (n_evidence > 0) & ~contains_any(text, ask["named"])
    rules = [
        (n_evidence == 0, "missing_evidence", "high"),
        ((F.size(ask["numeric"]) > 0) & ~quantities.covers_all(found, ask["numeric"]), "missing_numeric_constraint", "high"),
        ((F.size(ask["places"]) > 0) & ~places_covered(text, ask["places"]), "missing_geo", "medium"),
        (ask["has_time"] & ~time_covered(text, ask["start_year"], ask["end_year"]), "missing_time", "medium"),
        ((F.size(ask["source_types"]) > 0) & ~contains_any(text, ask["source_types"]), "candidate_review", "medium"),
        (missing, "candidate_review", "medium"),
        (n_candidates > 0, "candidate_review", "medium"),
        (has_conflicts, "conflict_review", "high"),
    ]
    return F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(kind).alias("gap_type"), F.lit(level).alias("priority"))) for holds, kind, level in rules]))


def warned(warnings: Column, *words: str) -> Column:
    return F.exists(F.coalesce(warnings, F.array().cast(NONE)), lambda w: reduce(lambda a, b: a | b, [F.contains(w, F.lit(x)) for x in words]))


def outcome(status_code: Column, mode: Column, warnings: Column, phase: Column) -> Column:
    """What became of a call, the first that holds."""
    degraded = phase.eqNullSafe("degraded") | warned(warnings, "insufficient", "unsupported", "conflict")
    kinds = F.when(status_code >= 500, "failed").when(phase == "error", "stream_error").when(warned(warnings, "fallback"), "degraded_fallback").when(degraded, "degraded")
    return kinds.when(mode == "legacy", "legacy_ok").when(mode == "top1_scientific", "scientific_ok").otherwise("ok")


def terminal_phase(confidence: Column, warnings: Column, has_conflicts: Column) -> Column:
    """How an answer ends: degraded by conflicts, confidence below 0.6 or too little evidence; else done."""
    low = has_conflicts | warned(warnings, "conflict", "insufficient") | (confidence < 0.6)
    return F.when(low, "degraded").otherwise("done")


#: Weights of a claim's status: fixed values; any other counts 0.4.
STATUS_WEIGHTS = {"verified": 1.0, "auto_verified": 0.9, "extracted": 0.7, "candidate": 0.5, "conflicting": 0.3, "deprecated": 0.1, "rejected": 0.0}


def status_weight(status: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in STATUS_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, status), F.lit(0.4))


def claim_score(confidence: Column, status: Column, recent: Column) -> Column:
    return F.round(F.least(F.lit(1.0), confidence * status_weight(status) + F.when(recent, 0.05).otherwise(0.0)), 6)
