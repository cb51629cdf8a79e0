"""Queries of extraction: what whole document texts, each with a closing note that names quantities, places and people, say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import aliases, entities, extract, quantities, terms, text
from corvane.operators import dictionaries, storage
from corvane.plans.queries import query, read

#: A closing sentence by the document's number, in the words that the extractors know; the same expression in both engines.
NOTE = """concat(coalesce(text, ''), '. Solution (PG', CAST(doc_id % 3 AS STRING), ') holds 10-', CAST(20 + doc_id % 5 AS STRING), ' mg/l, скорость не более 1,', CAST(doc_id % 10 AS STRING), ' м/с. ',
 CASE doc_id % 4 WHEN 0 THEN 'Flotation affects Ni and Cu in Norilsk, шлак Россия shows 5 % in 2019–2021.' WHEN 1 THEN 'Выщелачивание влияет на никель в России; показано >= 3 Г/Л в 2020 году.'
 WHEN 2 THEN 'Results conflict: slag (SL) and slag melt (SL) used between Au and Ag; see journal of 2020.' ELSE 'Патент за рубежом: штейн рекомендуется, 4 kg/t, Иванов И. И. 12.05.2018, nickl ok.' END)"""


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def listed(words) -> str:
    return f"[{', '.join(map(quoted, words))}]"


def case(value: str, names: dict[str, str], default: str) -> str:
    return f"CASE {value} {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in names.items())} ELSE {default} END"


def any_of(value: str, words: list[str]) -> str:
    return f"({' OR '.join(f'contains({value}, {quoted(w)})' for w in words)})"


def among(words: list[str]) -> str:
    return f"list_filter({listed(words)}, lambda w: contains(low, w))"


def named(names: dict[str, str]) -> str:
    return f"list_distinct(list_filter([{', '.join(f'CASE WHEN contains(low, {quoted(w)}) THEN {quoted(n)} END' for w, n in names.items())}], lambda n: n IS NOT NULL))"


def joined(values: str) -> str:
    return f"array_to_string(list_sort({values}), '|')"


NOTES = f"notes AS (SELECT doc_id, note, lower(note) AS low FROM (SELECT doc_id, {NOTE} AS note FROM documents))"
PATTERN = quoted("(?i)" + quantities.QUANTITY)
NUMBER = "TRY_CAST(replace({}, ',', '.') AS DOUBLE)"
FOUND = f"""found AS (SELECT doc_id, i, {NUMBER.format('a')} AS a, {NUMBER.format("nullif(b, '')")} AS b, {case('lower(u)', terms.UNITS, 'lower(u)')} AS unit, {case('lower(o)', terms.OPERATORS, "'eq'")} AS op
 FROM (SELECT doc_id, unnest(range(len(regexp_extract_all(note, {PATTERN}, 2)))) AS i, unnest(regexp_extract_all(note, {PATTERN}, 1)) AS o, unnest(regexp_extract_all(note, {PATTERN}, 2)) AS a,
  unnest(regexp_extract_all(note, {PATTERN}, 3)) AS b, unnest(regexp_extract_all(note, {PATTERN}, 4)) AS u FROM notes))"""
#: RE2 knows ASCII word edges only: letters beside a symbol are ruled out by hand, in a text whose separators are doubled.
SYMBOLS = rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])({'|'.join(terms.SUBSTANCES)})(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])"
SPACED = r"regexp_replace(note, '([^\p{L}\p{N}\p{M}_])', '\1\1', 'g')"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(NOTE).alias("note"))


def rows(df: DataFrame, values) -> DataFrame:
    """A row for each document: its values sorted and joined."""
    return df.select("doc_id", F.array_join(F.sort_array(values), "|").alias("found"))


@query(f"""WITH {NOTES}, {FOUND} SELECT doc_id, i, a AS value, unit, CASE WHEN b IS NULL THEN op ELSE 'range' END AS operator, CASE WHEN b IS NOT NULL THEN least(a, b) END AS range_min,
 CASE WHEN b IS NOT NULL THEN greatest(a, b) END AS range_max FROM found""")
def x06_quantities(spark, sf_dir):
    found = notes(spark, sf_dir).select("doc_id", F.posexplode(quantities.quantities(F.col("note"))).alias("i", "q"))
    return found.select("doc_id", F.col("i").cast("long").alias("i"), "q.*")


@query(f"""WITH {NOTES} SELECT doc_id, {joined(f"list_distinct(list_transform(regexp_extract_all(note, {quoted('(?i)' + quantities.UNIT)}), lambda u: {case('lower(u)', terms.UNITS, 'lower(u)')}))")} AS found FROM notes""")
def x05_units(spark, sf_dir):
    return rows(notes(spark, sf_dir), quantities.units(F.col("note")))


@query(f"WITH {NOTES}, {FOUND} SELECT unit, CASE WHEN b IS NULL THEN op ELSE 'range' END AS operator, count(*) AS n, min(a) AS low, max(a) AS high FROM found GROUP BY 1, 2")
def x07_x08_units_operators(spark, sf_dir):
    found = notes(spark, sf_dir).select(F.explode(quantities.quantities(F.col("note"))).alias("q")).select("q.*")
    return found.groupBy("unit", "operator").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


SHORT = "regexp_replace(regexp_replace(printf('%.6f', {}), '0+$', ''), '[.]$', '')"


@query(f"""WITH {NOTES}, {FOUND} SELECT doc_id, i, CASE WHEN b IS NOT NULL THEN {SHORT.format('least(a, b)')} || '-' || {SHORT.format('greatest(a, b)')} WHEN op = 'eq' THEN {SHORT.format('a')}
 ELSE op || ' ' || {SHORT.format('a')} END || ' ' || unit AS value FROM found""")
def x28_formatted(spark, sf_dir):
    found = notes(spark, sf_dir).select("doc_id", F.posexplode(quantities.quantities(F.col("note"))).alias("i", "q"))
    return found.select("doc_id", F.col("i").cast("long").alias("i"), quantities.formatted(F.col("q")).alias("value"))


@query(f"""WITH {NOTES}, r AS (SELECT doc_id, note, regexp_extract_all(note, '20[0-9][0-9]\\s*[-–—]\\s*20[0-9][0-9]') AS ranges FROM notes),
 p AS (SELECT doc_id, CASE WHEN len(ranges) > 0 THEN ranges ELSE regexp_extract_all(note, '\\b20[0-9][0-9]\\b') END AS found FROM r)
 SELECT doc_id, {joined("list_distinct(list_transform(found, lambda x: substr(x, 1, 4) || '-' || substr(x, -4)))")} AS found FROM p""")
def x10_periods(spark, sf_dir):
    spans = F.transform(extract.periods(F.col("note")), lambda p: F.concat_ws("-", p["start_year"].cast("string"), p["end_year"].cast("string")))
    return rows(notes(spark, sf_dir), spans)


@query(f"WITH {NOTES} SELECT doc_id, {joined(named(terms.DOCUMENT_PLACES))} AS found FROM notes")
def x11_document_places(spark, sf_dir):
    return rows(notes(spark, sf_dir), entities.document_places(F.col("note")))


@query(f"""WITH {NOTES} SELECT CASE WHEN {any_of('low', terms.DOMESTIC)} THEN 'domestic' WHEN {any_of('low', terms.FOREIGN)} THEN 'foreign' ELSE 'unknown' END AS bucket, count(*) AS n FROM notes GROUP BY 1""")
def x12_place_bucket(spark, sf_dir):
    return notes(spark, sf_dir).groupBy(entities.place_bucket(F.col("note"))["bucket"].alias("bucket")).agg(F.count("*").alias("n"))


REFS = f"""refs AS (SELECT doc_id, i, s AS alias, trim(right(trim(regexp_replace(l, '\\s+', ' ', 'g')), 80), ' -') AS hint FROM (SELECT doc_id, unnest(range(len(regexp_extract_all(note, {quoted(aliases.BRACKETED)}, 1)))) AS i,
 unnest(regexp_extract_all(note, {quoted(aliases.BRACKETED)}, 1)) AS l, unnest(regexp_extract_all(note, {quoted(aliases.BRACKETED)}, 2)) AS s FROM notes))"""


@query(f"WITH {NOTES}, {REFS} SELECT doc_id, i, alias, hint AS canonical_hint FROM refs")
def x13_alias_refs(spark, sf_dir):
    found = notes(spark, sf_dir).select("doc_id", F.posexplode(aliases.refs(F.col("note"))).alias("i", "r"))
    return found.select("doc_id", F.col("i").cast("long").alias("i"), "r.*")


@query(f"""WITH {NOTES}, {REFS}, w AS (SELECT *, lag(lower(hint)) OVER (PARTITION BY doc_id, lower(alias) ORDER BY i) AS before FROM refs)
 SELECT doc_id, i, alias || ' -> ' || hint AS value, CAST(CASE WHEN before <> lower(hint) THEN 0.56 WHEN length(alias) <= 2 THEN 0.58 ELSE 0.76 END AS DOUBLE) AS confidence,
 concat_ws(',', CASE WHEN length(alias) <= 2 THEN 'ambiguous_alias' END, CASE WHEN before <> lower(hint) THEN 'conflicting_values' END) AS codes FROM w""")
def w07_alias_conflicts(spark, sf_dir):
    found = notes(spark, sf_dir).select("doc_id", F.posexplode(aliases.judged(aliases.refs(F.col("note")))).alias("i", "r"))
    return found.select("doc_id", F.col("i").cast("long").alias("i"), "r.value", "r.confidence", F.array_join("r.reason_codes", ",").alias("codes"))


FORM = "trim(regexp_replace(translate(lower(note), '–—‑', '---'), '\\s+', ' ', 'g'))"


@query(f"WITH {NOTES}, f AS (SELECT doc_id, {FORM} AS low FROM notes) SELECT doc_id, {joined(among(list(aliases.CODES)))} AS found FROM f")
def x15_seed_aliases(spark, sf_dir):
    known = aliases.listed(F.col("note"), aliases.CODES, 0.66)
    return rows(notes(spark, sf_dir), F.transform(known, lambda k: F.substring_index(k["value"], " -> ", 1)))


@query(f"WITH {NOTES}, f AS (SELECT doc_id, {FORM} AS low FROM notes) SELECT doc_id, {joined(among([aliases.latin(c) for c in terms.TRANSLATED_ALIASES.values()]))} AS found FROM f")
def x16_transliterated_aliases(spark, sf_dir):
    names = {aliases.latin(c): c for c in terms.TRANSLATED_ALIASES.values()}
    return rows(notes(spark, sf_dir), F.transform(aliases.listed(F.col("note"), names, 0.62), lambda k: F.substring_index(k["value"], " -> ", 1)))


@query(f"WITH {NOTES} SELECT doc_id, {FORM} AS form FROM notes")
def x21_alias_form(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", text.alias_form(F.col("note")).alias("form"))


@query(None)
def x17_fuzzy_aliases(spark, sf_dir):
    """Names that a text nearly spells; difflib's ratio is beyond SQL, a test holds it against a plain loop."""
    found = notes(spark, sf_dir).select("doc_id", F.explode(aliases.fuzzy(aliases.tokens_of(F.col("note"), 4))).alias("a"))
    return found.select("doc_id", "a.*")


@query(None)
def x17_near_names(spark, sf_dir):
    """Each rare word of the documents with the frequent word (of 20 documents or more, by rank) that it nearly spells."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0)))
    counts = storage.written(read(spark, sf_dir, "documents").select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("docs")), "words")
    names = counts.where("docs >= 20").select("word", (-F.col("docs")).alias("rank"), F.xxhash64("word").alias("h"))
    return dictionaries.nearly(counts.where("docs < 20"), "word", names.select("word", F.struct("rank", "h").alias("place")), "word", "place")


@query(None)
def x18_alike_aliases(spark, sf_dir):
    """Names whose spelling vector is near a token's; a test holds the vectors against their definition."""
    found = notes(spark, sf_dir).select("doc_id", F.explode(aliases.alike(aliases.tokens_of(F.col("note"), 3))).alias("a"))
    return found.select("doc_id", "a.*")


@query(None)
def x14_all_aliases(spark, sf_dir):
    """Every kind of alias of a text, each once; its parts have twins or tests of their own."""
    found = aliases.every_alias(notes(spark, sf_dir), "note", "doc_id")
    return found.select("doc_id", "value", "confidence", F.array_join("reason_codes", ",").alias("codes"))


@query("""WITH h AS (SELECT doc_id, string_agg(sha256(i || ':' || coalesce(text, '')), '' ORDER BY i) AS digits FROM documents, (SELECT unnest(range(2)) AS i) GROUP BY doc_id),
 v AS (SELECT doc_id, d, CAST('0x' || substr(digits, 2 * d + 1, 2) AS INTEGER) / 127.5 - 1.0 AS x FROM h, (SELECT unnest(range(64)) AS d)),
 n AS (SELECT doc_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM v GROUP BY 1)
 SELECT doc_id, min(round(x / norm, 6)) AS low, max(round(x / norm, 6)) AS high, round(sum(round(x / norm, 6)), 6) AS total FROM v JOIN n USING (doc_id) GROUP BY 1""")
def x20_hash_vectors(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", aliases.hash_vector(F.col("text"), 64).alias("v"))
    return found.select("doc_id", F.array_min("v").alias("low"), F.array_max("v").alias("high"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


#: RE2 has no lookbehind: a mark is put after the ends of sentences, and the text is cut there.
FLAT = "trim(regexp_replace(note, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({FLAT}, '([.!?。]) ', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ;')), lambda p: length(p) >= 8)"


@query(f"WITH {NOTES} SELECT doc_id, len({SENTENCES}) AS n, list_sum(list_transform({SENTENCES}, lambda s: length(s))) AS chars FROM notes")
def x22_sentences(spark, sf_dir):
    found = notes(spark, sf_dir).select("doc_id", text.sentences(F.col("note")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


ENTITIES = f"""list_concat(regexp_extract_all({SPACED}, {quoted(SYMBOLS)}, 1), {among(terms.PROCESSES)}, list_filter({listed(dict.fromkeys(terms.PLACES.values()))}, lambda n: contains(low, lower(n))))"""


@query(f"WITH {NOTES} SELECT doc_id, {joined(f'list_distinct(list_transform({ENTITIES}, lambda e: lower(e)))')} AS found FROM notes")
def x23_entities(spark, sf_dir):
    return rows(notes(spark, sf_dir), F.transform(entities.entities(F.col("note")), F.lower))


EXPERT = r"(?:^|[^\p{L}\p{N}_])([А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ]\.){1,2}|[A-Z][a-z]+(?:\s+[A-Z]\.){1,2})"
DATE = r"(?:^|[^\p{L}\p{N}_])((?:19|20)[0-9]{2}\b|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}\b)"
KINDS = {
    "material": among(terms.MATERIALS), "substance": f"regexp_extract_all({SPACED}, {quoted(SYMBOLS)}, 1)", "process": among(terms.PROCESSES), "equipment": among(terms.EQUIPMENT), "property": among(terms.PROPERTIES),
    "date": f"regexp_extract_all(note, {quoted(DATE)}, 1)", "geography": named(terms.PLACES), "expert": f"regexp_extract_all(note, {quoted(EXPERT)}, 1)", "source": f"CASE WHEN {any_of('low', terms.SOURCES)} THEN ['x'] ELSE [] END",
    "conclusion": f"list_filter({SENTENCES}, lambda s: {any_of('lower(s)', terms.CONCLUSIONS)})",
}


@query(f"""WITH {NOTES}, k AS ({' UNION ALL '.join(f"SELECT doc_id, '{kind}' AS kind, len(list_distinct(list_transform({values}, lambda v: lower(v)))) AS n FROM notes" for kind, values in KINDS.items())})
 SELECT kind, count(*) AS documents, CAST(sum(n) AS BIGINT) AS n FROM k WHERE n > 0 GROUP BY kind""")
def x24_domain_values(spark, sf_dir):
    kinds = entities.domain_values(F.col("note"))
    found = notes(spark, sf_dir).select(F.explode(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.size(v))])).alias("kind", "n")).where("n > 0")
    return found.groupBy("kind").agg(F.count("*").alias("documents"), F.sum("n").alias("n"))


@query(f"""WITH {NOTES} SELECT doc_id, len(list_distinct(list_transform({ENTITIES}, lambda e: lower(e)))) >= 2 AND {any_of('low', terms.RELATIONS)} AS related, {any_of('low', terms.CONFLICTS)} AS conflict,
 NOT {any_of('low', list(terms.UNITS))} AS needs_unit FROM notes""")
def x25_x26_relations_conflicts(spark, sf_dir):
    note = F.col("note")
    return notes(spark, sf_dir).select("doc_id", entities.relation(note).isNotNull().alias("related"), entities.has_conflict(note).alias("conflict"), entities.needs_unit_check(note).alias("needs_unit"))


@query(f"""WITH {NOTES}, s AS (SELECT doc_id, unnest({SENTENCES}) AS s FROM notes) SELECT doc_id, s AS sentence FROM s WHERE {any_of('lower(s)', terms.CLAIMS)} OR regexp_matches(s, {PATTERN})""")
def x27_claims(spark, sf_dir):
    found = notes(spark, sf_dir).select("doc_id", F.explode(text.sentences(F.col("note"))).alias("sentence"))
    return found.where(entities.is_claim(F.col("sentence")))


def ladder(value: str, words: dict[str, list[str]], default: str) -> str:
    return f"CASE {' '.join(f'WHEN {any_of(value, w)} THEN {quoted(k)}' for k, w in words.items())} ELSE {quoted(default)} END"


@query(f"""WITH p AS (SELECT doc_id, lower(concat_ws(' ', coalesce(source, ''), CAST(doc_id AS VARCHAR), substr({NOTE}, 1, 2000))) AS low FROM documents)
 SELECT doc_id, {ladder('low', terms.PURPOSES, 'unknown')} AS purpose FROM p""")
def x29_purposes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", entities.purpose(F.col("source"), F.col("doc_id").cast("string"), F.expr(NOTE)).alias("purpose"))


@query(f"WITH {NOTES} SELECT {ladder('low', terms.INTENTS, 'evidence_lookup')} AS intent, count(*) AS n FROM notes GROUP BY 1")
def x30_intents(spark, sf_dir):
    return notes(spark, sf_dir).groupBy(entities.intent(F.col("note")).alias("intent")).agg(F.count("*").alias("n"))


QUESTION = "concat(CASE doc_id % 3 WHEN 0 THEN 'Патенты за последние 5 лет: ' WHEN 1 THEN 'Статьи 2019-2021: ' ELSE '' END, 'флотация и штейн, Норильск')"


@query(f"""WITH q AS (SELECT doc_id, lower({QUESTION}) AS low FROM documents) SELECT doc_id, {joined(named(terms.SOURCE_TYPES))} AS source_types, {joined(named(terms.PLACES))} AS places,
 {joined(f'list_concat({among(terms.PROCESSES)}, {among(terms.QUERY_TERMS)})')} AS words, TRY_CAST(nullif(regexp_extract(low, 'последн(?:ие|их|ими)?\\s+([0-9]+)\\s+лет', 1), '') AS INTEGER) AS relative_years,
 TRY_CAST(nullif(regexp_extract(low, '(20[0-9][0-9])\\s*[-–—]\\s*(20[0-9][0-9])', 2), '') AS INTEGER) AS end_year FROM q""")
def x31_question_constraints(spark, sf_dir):
    q = read(spark, sf_dir, "documents").select("doc_id", F.expr(QUESTION).alias("q"))
    sorted_ = lambda c: F.array_join(F.sort_array(c), "|")
    time = entities.time_constraint(F.col("q"))
    return q.select("doc_id", sorted_(entities.source_types(F.col("q"))).alias("source_types"), sorted_(entities.places(F.col("q"))).alias("places"), sorted_(entities.query_terms(F.col("q"))).alias("words"), time["relative_years"].alias("relative_years"), time["end_year"].alias("end_year"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, 'mg/l' AS unit FROM part")
def x35_measurements(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" mg/l")).alias("raw"))
    return parts.select("p_partkey", quantities.measurement(F.col("raw"))["value"].alias("value"), quantities.measurement(F.col("raw"))["unit"].alias("unit"))


@query(f"""WITH {NOTES}, {FOUND}, f AS (SELECT doc_id, a, unit FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)
 SELECT n.doc_id, CASE WHEN n.doc_id % 2 = 0 THEN f.unit ELSE 'mg/l' END AS unit, CASE WHEN n.doc_id % 2 = 0 THEN f.a ELSE CAST(n.doc_id AS DOUBLE) END AS value FROM notes n JOIN f USING (doc_id)""")
def x42_resolved_quantities(spark, sf_dir):
    own = F.when(F.col("doc_id") % 2 == 1, F.struct(F.lit("MG/L").alias("unit"), F.col("doc_id").cast("double").alias("value")))
    return notes(spark, sf_dir).select("doc_id", quantities.resolved(own, quantities.quantities(F.col("note")), F.col("note")).alias("q")).select("doc_id", "q.*")


@query("SELECT doc_id, TRY_CAST(replace(nullif(regexp_extract(coalesce(text, ''), '[0-9]+(?:[,.][0-9]+)?'), ''), ',', '.') AS DOUBLE) AS value FROM documents")
def x41_first_numbers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", quantities.first_number(F.col("text")).alias("value"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || event_id AS cursor, event_id AS key FROM events")
def x44_cursors(spark, sf_dir):
    found = read(spark, sf_dir, "events").select("event_id", extract.cursor(F.col("ts"), F.col("event_id")).alias("cursor"))
    return found.withColumn("key", extract.cursor_parts(F.col("cursor"))["key"].cast("long"))


@query("SELECT event_id, props ->> '$.k' AS k FROM events")
def x43_json_objects(spark, sf_dir):
    """The events' properties, found in what is said around them."""
    noisy = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Sure, a "), "event_type", F.lit(": ```json "), "props", F.lit(" ``` done")).alias("said"))
    return noisy.select("event_id", F.try_variant_get(extract.json_object(F.col("said")), "$.k", "string").alias("k"))


@query(f"""WITH {NOTES} SELECT doc_id, len({among(terms.MATERIALS)}) AS materials, round(CAST(least(1.0, 0.35 + 0.1 * len({among(list(terms.PLACES))})) AS DOUBLE), 6) AS geography FROM notes WHERE len({among(terms.MATERIALS)}) > 0 AND len({among(list(terms.PLACES))}) > 0""")
def x45_interests(spark, sf_dir):
    found = text.once(notes(spark, sf_dir), "i", entities.interests(F.col("note")))
    one = lambda label: F.get(F.filter("i", lambda x: x["label"] == label), F.lit(0))
    both = found.where(one("materials").isNotNull() & one("geography").isNotNull())
    return both.select("doc_id", F.size(one("materials")["source_terms"]).cast("long").alias("materials"), F.round(one("geography")["weight"], 6).alias("geography"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), {quoted(text.QUERY_TOKEN)}), lambda t: trim(t, '.,;:()[]{{}}')), lambda t: length(t) >= 2)) AS t FROM documents)
 SELECT doc_id, len(t) AS tokens, round(len(list_intersect(['the', 'que', 'der', 'les'], t)) / 4.0, 6) AS overlap FROM t""")
def x02_x03_query_tokens(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text"), text.QUERY_TOKEN).alias("t"))
    asked = F.array(*[F.lit(w) for w in ("the", "que", "der", "les")])
    return found.select("doc_id", F.size("t").cast("long").alias("tokens"), F.round(text.overlap(asked, F.col("t")), 6).alias("overlap"))


@query(f"""WITH {NOTES}, {FOUND}, t AS (SELECT doc_id, count(*) AS measurements FROM found GROUP BY 1), {REFS}, a AS (SELECT doc_id, count(*) AS aliases FROM (SELECT DISTINCT doc_id, lower(alias), lower(hint) FROM refs) GROUP BY 1)
 SELECT n.doc_id, len({named(terms.DOCUMENT_PLACES)}) AS places, coalesce(t.measurements, 0) AS measurements, coalesce(a.aliases, 0) AS aliases FROM notes n LEFT JOIN t USING (doc_id) LEFT JOIN a USING (doc_id)""")
def a15_coverage_counters(spark, sf_dir):
    refs = F.transform(aliases.refs(F.col("note")), lambda r: F.struct(F.lower(r["alias"]), F.lower(r["canonical_hint"])))
    size = lambda c: F.size(c).cast("long")
    return notes(spark, sf_dir).select("doc_id", size(entities.document_places(F.col("note"))).alias("places"), size(quantities.quantities(F.col("note"))).alias("measurements"), size(F.array_distinct(refs)).alias("aliases"))


@query("""SELECT doc_id, min(v) AS numeric_min, max(v) AS numeric_max FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[-+]?[0-9]+(?:[,.][0-9]+)?'), lambda x: TRY_CAST(replace(replace(x, ',', '.'), '+', '') AS DOUBLE))) AS v FROM documents) GROUP BY 1""")
def a13_numeric_range(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", extract.numbers(F.col("text")).alias("v")).where(F.size("v") > 0)
    return found.select("doc_id", F.array_min("v").alias("numeric_min"), F.array_max("v").alias("numeric_max"))
