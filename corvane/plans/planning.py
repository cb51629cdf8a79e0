"""Queries of planning, extraction as a whole, catalogs and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import terms, text, verify
from corvane.operators import bundles, catalog, evaluation, planning, snapshots, state, storage
from corvane.plans.extraction import ENTITIES, FOUND, KINDS, NOTES, PATTERN, REFS, SENTENCES, SHORT, any_of, among, joined, ladder, named, notes, quoted
from corvane.plans.queries import query, read

#: Questions of every class, by the document's number; the same expression in both engines.
ASKED = """CASE doc_id % 8 WHEN 0 THEN 'Какие методы: флотация никель, по сравнению с leaching, не более 5 мг/л?' WHEN 1 THEN 'Статьи о Норильск 2019-2021' WHEN 2 THEN 'Патенты за последние 5 лет: штейн' WHEN 3 THEN 'Диапазон скорости 2 м/с'
 WHEN 4 THEN 'граф claim связи между Ni и Cu, missing gap' WHEN 5 THEN 'что известно о реке и озере вообще и в целом' WHEN 6 THEN 'Противоречия: flotation в России, 10-20 mg/l, 2018–2020' ELSE 'temperature' END"""
Q = f"q AS (SELECT doc_id, note, low, {named(terms.PLACES)} AS places, regexp_matches(note, {PATTERN}) AS num, regexp_matches(low, 'последн(?:ие|их|ими)?\\s+([0-9]+)\\s+лет|20[0-9][0-9]\\s*[-–—]\\s*20[0-9][0-9]') AS tim, list_concat(regexp_extract_all(regexp_replace(note, '([^\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1\\1', 'g'), {quoted(f'(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({"|".join(terms.SUBSTANCES)})(?:$|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')}, 1), {among(terms.PROCESSES)}, list_filter({[*dict.fromkeys(terms.PLACES.values())]}, lambda n: contains(low, lower(n))), {among(terms.PROCESSES)}, {among(terms.QUERY_TERMS)}) AS ents FROM (SELECT doc_id, {ASKED} AS note, lower({ASKED}) AS low FROM documents))"
NAMED = "list_distinct(list_transform(ents, lambda e: lower(e)))"
FLAGS = f"f AS (SELECT *, len(places) > 0 AS geo, {any_of('low', planning.GRAPH)} AS gr, {any_of('low', planning.COMPARATIVE)} AS cmp, len({NAMED}) AS n FROM q)"
CLASS = "CASE WHEN num AND cmp THEN 'comparative' WHEN num AND NOT geo AND NOT tim AND NOT gr THEN 'numeric' WHEN num::INT + geo::INT + tim::INT + gr::INT >= 2 THEN 'mixed' WHEN geo THEN 'geo' WHEN tim THEN 'temporal' WHEN gr THEN 'graph_centric' ELSE 'semantic' END"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.question_ir(read(spark, sf_dir, "documents").select("doc_id", F.expr(ASKED).alias("q")), "q")


@query(f"WITH {Q} SELECT doc_id, {joined(NAMED)} AS entities, {ladder('low', terms.INTENTS, 'evidence_lookup')} AS intent, {joined('places')} AS places, num AS has_numbers, {joined(named(terms.SOURCE_TYPES))} AS source_types FROM q")
def v01_question_ir(spark, sf_dir):
    ir = F.col("ir")
    own = lambda c: F.array_join(F.sort_array(c), "|")
    return asked(spark, sf_dir).select("doc_id", own(F.transform(ir["entities"], F.lower)).alias("entities"), ir["intent"].alias("intent"), own(ir["places"]).alias("places"), (F.size(ir["numeric"]) > 0).alias("has_numbers"), own(ir["source_types"]).alias("source_types"))


@query(f"WITH {Q} SELECT doc_id, {joined(f"list_distinct(list_concat(['extra', 'ni'], {NAMED}))")} AS entities, CASE WHEN doc_id % 2 = 0 THEN 'model' ELSE {ladder('low', terms.INTENTS, 'evidence_lookup')} END AS intent, CASE WHEN len(places) > 0 THEN {joined('places')} ELSE 'Там' END AS places FROM q")
def v02_merged(spark, sf_dir):
    ir = F.col("ir")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    other = ir.withField("entities", words("Extra", "NI")).withField("intent", F.when(F.col("doc_id") % 2 == 0, "model").otherwise("")).withField("places", words("Там"))
    m = planning.merged(ir, other)
    return asked(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(F.transform(m["entities"], F.lower)), "|").alias("entities"), m["intent"].alias("intent"), F.array_join(F.sort_array(m["places"]), "|").alias("places"))


@query(f"WITH {Q} SELECT doc_id, {joined(f"list_distinct(list_concat({named(terms.SOURCE_TYPES)}, ['patent', 'book']))")} AS types, {joined("list_distinct(list_append(places, 'Россия'))")} AS places, CASE doc_id % 8 WHEN 2 THEN 2019 WHEN 1 THEN 2019 WHEN 6 THEN 2018 END AS start_year FROM q")
def v03_filters(spark, sf_dir):
    f = planning.filters(F.col("ir"), F.array(F.lit("patent"), F.lit(" "), F.lit("book")), F.lit("Россия"))
    own = lambda c: F.array_join(F.sort_array(c), "|")
    return asked(spark, sf_dir).select("doc_id", own(f["source_types"]).alias("types"), own(f["places"]).alias("places"), planning.window(F.col("ir"), 2024)["start_year"].alias("start_year"))


@query(f"WITH {Q}, {FLAGS} SELECT {CLASS} AS class, count(*) AS questions FROM f GROUP BY 1")
def v04_classes(spark, sf_dir):
    return asked(spark, sf_dir).groupBy(planning.query_class(F.col("ir")).alias("class")).agg(F.count("*").alias("questions"))


@query(f"""WITH {Q}, {FLAGS}, c AS (SELECT *, {CLASS} AS class FROM f) SELECT doc_id, concat_ws('|', CASE WHEN class <> 'graph_centric' OR num OR geo OR tim THEN 'semantic' END,
 CASE WHEN n > 0 OR len(string_split(note, ' ')) <= 4 OR regexp_matches(note, '[A-Z]') OR regexp_matches(note, '(^|[^\\p{{L}}\\p{{N}}_])[A-ZА-Я]{{2,6}}($|[^\\p{{L}}\\p{{N}}_])') THEN 'lexical' END, CASE WHEN class IN ('numeric', 'comparative', 'mixed') THEN 'table' END,
 CASE WHEN num THEN 'numeric' END, CASE WHEN geo THEN 'geo' END, CASE WHEN tim THEN 'time' END, CASE WHEN class IN ('graph_centric', 'comparative', 'mixed') OR gr THEN 'graph' END) AS profiles FROM c""")
def v05_profiles(spark, sf_dir):
    chosen = F.transform(F.filter(planning.profiles(F.col("ir")), lambda p: p["selected"]), lambda p: p["profile"])
    return asked(spark, sf_dir).select("doc_id", F.array_join(chosen, "|").alias("profiles"))


def hinted(hints: list[str]) -> str:
    one = " OR ".join(f"contains(w, {quoted(h)}) OR contains({quoted(h)}, w)" for h in hints)
    return f"len(list_filter(words, lambda w: {one})) > 0"


@query(f"""WITH {Q}, {FLAGS}, w AS (SELECT *, list_filter(list_concat(string_split(replace(low, ',', ' '), ' '), {NAMED}, [{ladder('low', terms.INTENTS, 'evidence_lookup')}]), lambda w: w <> '') AS words FROM f)
 SELECT doc_id, coalesce(nullif(concat_ws('|', CASE WHEN geo THEN 'geo_indicator' END, CASE WHEN tim THEN 'period_observation' END, CASE WHEN n >= 2 THEN 'comparison' END, CASE WHEN n > 0 AND ({hinted(planning.PROCESS_HINTS)} OR {hinted(planning.MATERIAL_HINTS)} OR num) THEN 'entity_process_measurement' END,
 CASE WHEN n > 0 THEN 'entity_property' END, CASE WHEN n > 0 AND ({hinted(planning.CONFLICT_HINTS)} OR num) THEN 'conflicts' END, CASE WHEN {hinted(planning.MISSING_HINTS)} OR {hinted(planning.PROCESS_HINTS)} THEN 'missing_data' END), ''), 'entity_property') AS patterns FROM w""")
def v06_patterns(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", F.array_join(planning.graph_patterns(F.col("ir")), "|").alias("patterns"))


@query(f"""WITH {Q}, {FLAGS} SELECT doc_id, concat_ws('|', CASE WHEN n > 0 THEN 'resolve_entities' END, CASE WHEN geo THEN 'geo_filter' END, CASE WHEN num THEN 'numeric_filter' END, CASE WHEN len({named(terms.SOURCE_TYPES)}) > 0 THEN 'source_type_filter' END, CASE WHEN tim THEN 'time_filter' END, 'traverse_claims', 'rank_claims') AS steps FROM f""")
def v07_steps(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", F.array_join(planning.steps(F.col("ir")), "|").alias("steps"))


SEEDS = f"list_filter({list(planning.aliases.CODES)}, lambda w: contains(trim(regexp_replace(translate(low, '–—‑', '---'), '\\s+', ' ', 'g')), w))"
VALUE = f"CASE WHEN b IS NOT NULL THEN {SHORT.format('least(a, b)')} || '-' || {SHORT.format('greatest(a, b)')} WHEN op = 'eq' THEN {SHORT.format('a')} ELSE op || ' ' || {SHORT.format('a')} END || ' ' || unit"
DOMAIN = " UNION ALL ".join(f"SELECT doc_id, '{kind}', unnest({values}), 'confirmed' FROM notes" for kind, values in KINDS.items())


@query(f"""WITH {NOTES}, {FOUND}, {REFS}, w AS (SELECT *, lag(lower(hint)) OVER (PARTITION BY doc_id, lower(alias) ORDER BY i) AS before FROM refs), s AS (SELECT doc_id, unnest({SENTENCES}) AS s FROM notes),
 c AS (SELECT doc_id, s, {any_of('lower(s)', terms.CONFLICTS)} AS x FROM s WHERE {any_of('lower(s)', terms.CLAIMS)} OR regexp_matches(s, {PATTERN})),
 a AS (SELECT doc_id, 'entity' AS kind, unnest({ENTITIES}) AS value, 'confirmed' AS status FROM notes UNION ALL {DOMAIN} UNION ALL SELECT doc_id, 'alias', alias || ' -> ' || hint, CASE WHEN length(alias) <= 2 OR before <> lower(hint) THEN 'candidate' ELSE 'confirmed' END FROM w
 UNION ALL SELECT doc_id, 'alias', unnest({SEEDS}) || ' ->', 'candidate' FROM notes UNION ALL SELECT doc_id, 'measurement', {VALUE}, 'confirmed' FROM found UNION ALL SELECT doc_id, 'claim', s, CASE WHEN x THEN 'candidate' ELSE 'confirmed' END FROM c
 UNION ALL SELECT doc_id, 'recommendation', s, 'confirmed' FROM c WHERE {any_of('lower(s)', terms.RECOMMENDATIONS)} UNION ALL SELECT doc_id, 'relation', 'r', 'confirmed' FROM notes WHERE len(list_distinct(list_transform({ENTITIES}, lambda e: lower(e)))) >= 2 AND {any_of('low', terms.RELATIONS)})
 SELECT kind, status, count(*) AS n FROM (SELECT DISTINCT doc_id, kind, lower(value) AS v, status FROM a) GROUP BY 1, 2""")
def v17_extracted(spark, sf_dir):
    found = planning.extracted(notes(spark, sf_dir), "doc_id", "note", "doc_id")
    return found.groupBy("kind", "status").agg(F.count("*").alias("n"))


@query(None)
def v17_every_alias(spark, sf_dir):
    """Extraction with every kind of alias, nothing cut; a test holds it against the aliases of each text and the extraction without them."""
    found = planning.extracted(notes(spark, sf_dir), "doc_id", "note", "doc_id", most=None, nearly_spelt=True)
    return found.select("document", "kind", "value", "status", "confidence", F.array_join("reason_codes", ",").alias("codes"))


@query(f"""WITH {NOTES}, s AS (SELECT doc_id, unnest({SENTENCES}[1:30]) AS s FROM notes) SELECT doc_id, s AS value FROM s WHERE {any_of('lower(s)', terms.CLAIMS)} OR regexp_matches(s, {PATTERN})""")
def v18_unsourced(spark, sf_dir):
    return planning.unsourced(notes(spark, sf_dir), "doc_id", "note").select("doc_id", "value")


@query(f"""WITH {NOTES}, {FOUND}, k AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1) SELECT doc_id, len(list_distinct(list_transform({ENTITIES}, lambda e: lower(e)))) AS entities, coalesce(n, 0) AS quantities FROM notes LEFT JOIN k USING (doc_id)
 WHERE len({ENTITIES}) > 0 OR coalesce(n, 0) > 0 ORDER BY doc_id LIMIT 25""")
def v23_mined(spark, sf_dir):
    return planning.mined(notes(spark, sf_dir), "doc_id", "note", 25)


LIST = ["claim", "measurement", "material", "process", "alias", "relation", "geography", "conclusion"]


@query(f"""WITH a AS (SELECT p_partkey, ({LIST})[p_partkey % 8 + 1] AS kind, p_name AS value, p_size % 2 = 0 AS sure, p_size % 3 <> 0 AS sourced FROM part), ent AS (SELECT *, kind IN ('material', 'process') AS e FROM a),
 c AS (SELECT * FROM ent WHERE kind IN ('claim', 'conclusion') OR kind IN ('measurement', 'geography') AND sourced OR e AND sourced AND sure)
 SELECT 'claims' AS part, count(*) AS n FROM c UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT kind, lower(value) FROM ent WHERE e) UNION ALL SELECT 'candidates', count(*) FROM ent WHERE e AND NOT sure UNION ALL SELECT 'relations', count(*) FROM a WHERE kind = 'relation'
 UNION ALL SELECT 'geographies', count(DISTINCT value) FROM a WHERE kind = 'geography' UNION ALL SELECT 'measurements', count(*) FROM a WHERE kind = 'measurement' UNION ALL SELECT 'aliases', count(*) FROM a WHERE kind = 'alias'
 UNION ALL SELECT 'edges', (SELECT count(*) FROM c WHERE sourced) + (SELECT count(*) FROM ent WHERE e AND sourced AND sure) + (SELECT count(*) FROM a WHERE kind IN ('measurement', 'geography') AND sourced)""")
def pr14_sc19_bundle(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in LIST]), (F.col("p_partkey") % 8 + 1).cast("int"))
    spans = F.when(F.col("p_size") % 3 != 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    artifacts = part.select(F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("id"), kind.alias("kind"), F.col("p_name").alias("value"), F.when(F.col("p_size") % 2 == 0, "confirmed").otherwise("candidate").alias("status"), F.lit(0.8).alias("confidence"), spans.alias("source_span_ids"))
    out = None
    for name, df in planning.bundle(artifacts).items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = own if out is None else out.unionByName(own)
    return out


ROUTES = ["claim", "measurement", "material", "process", "alias", "relation", "geography", "conclusion", "review_decision", "gadget"]


def artifacts_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as artifacts of ten kinds: confirmed if their size is even, with a span unless it is divisible by three, about their brand."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ROUTES]), (F.col("p_partkey") % 10 + 1).cast("int"))
    value = F.when(kind == "measurement", F.concat(F.col("p_size").cast("string"), F.lit(" mg/l"))).otherwise(F.col("p_name"))
    spans = F.when(F.col("p_size") % 3 != 0, F.array(F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")))).otherwise(F.array().cast("array<string>"))
    meta = F.create_map(F.lit("canonical"), F.col("p_type"), F.lit("relation_type"), F.col("p_brand"))
    status = F.when(F.col("p_size") % 2 == 0, "confirmed").otherwise("candidate")
    return read(spark, sf_dir, "part").select(F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("id"), kind.alias("kind"), value.alias("value"), status.alias("status"), F.lit(0.8).alias("confidence"), spans.alias("source_span_ids"), meta.alias("metadata"), F.array("p_brand").alias("entity_names"), "p_size")


@query(f"""WITH a AS (SELECT p_partkey AS k, ({ROUTES})[p_partkey % 10 + 1] AS kind, lower(trim(p_name)) AS name, lower(trim(p_type)) AS type, p_brand AS brand, p_size AS size, p_size % 2 = 0 AS sure, p_size % 3 <> 0 AS sourced FROM part),
 c AS (SELECT * FROM a WHERE kind IN ('claim', 'conclusion') OR kind IN ('measurement', 'geography') AND sourced OR kind IN ('material', 'process') AND sourced AND sure),
 measured AS (SELECT brand, size, count(*) AS n FROM c WHERE kind = 'measurement' GROUP BY ALL), other AS (SELECT m.n FROM measured m WHERE EXISTS (SELECT 1 FROM measured o WHERE o.brand = m.brand AND o.size <> m.size)),
 edges AS (SELECT count(*) FILTER (sourced) + count(*) + count(*) FILTER (sure) * 2 + count(*) FILTER (kind IN ('material', 'process')) + count(*) FILTER (kind IN ('measurement', 'geography')) + count(*) FILTER (kind IN ('claim', 'measurement')) AS n FROM c)
 SELECT 'documents' AS name, count(*) AS n_rows, 2 AS version FROM documents UNION ALL SELECT 'spans', count(*), 2 FROM documents
 UNION ALL SELECT 'entities', count(DISTINCT x), 2 FROM (SELECT 'Material:' || name AS x FROM a WHERE kind = 'material' UNION ALL SELECT 'Process:' || name FROM a WHERE kind = 'process' UNION ALL SELECT 'Material:' || type FROM a WHERE kind = 'alias' UNION ALL SELECT 'Entity:' || brand FROM a WHERE kind IN ('claim', 'measurement'))
 UNION ALL SELECT 'aliases', count(*), 2 FROM a WHERE kind = 'alias' UNION ALL SELECT 'measurements', count(*), 2 FROM a WHERE kind = 'measurement' UNION ALL SELECT 'geographies', count(DISTINCT name), 2 FROM a WHERE kind = 'geography'
 UNION ALL SELECT 'observations', count(*), 2 FROM a WHERE kind = 'conclusion' AND NOT sure UNION ALL SELECT 'experiments', 0, 2 UNION ALL SELECT 'classes', 0, 2
 UNION ALL SELECT 'candidates', count(*), 2 FROM a WHERE kind IN ('material', 'process', 'gadget') AND NOT sure UNION ALL SELECT 'relations', count(*), 2 FROM a WHERE kind = 'relation' UNION ALL SELECT 'review_decisions', count(*), 2 FROM a WHERE kind = 'review_decision'
 UNION ALL SELECT 'claims', count(*), 2 FROM c UNION ALL SELECT 'fact_versions', count(*) + count(*) FILTER (sure), 2 FROM c UNION ALL SELECT 'contradictions', coalesce(sum(n), 0)::BIGINT, 2 FROM other
 UNION ALL SELECT 'edges', (SELECT n FROM edges) + (SELECT count(*) FROM a WHERE kind = 'alias') + (SELECT count(*) FROM a WHERE kind = 'conclusion' AND NOT sure) + (SELECT count(*) FROM documents), 2""")
def pr14_sc19_committed_bundle(spark, sf_dir):
    """Two bundles, the second of the confirmed artifacts again, merged into a graph and committed: the tables of the last snapshot."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("title"))
    spans = docs.select(F.concat(F.lit("s"), "document_id").alias("span_id"), "document_id")
    artifacts, path = artifacts_of_parts(spark, sf_dir), storage.new_path(spark, "graph")
    bundles.written(spark, path, bundles.families(artifacts, docs, spans, "2024-01-01"))
    before = snapshots.opened(spark, path)["claims"]
    bundles.written(spark, path, bundles.families(artifacts.where("p_size % 2 = 0"), docs, spans, "2024-02-01", before))
    last = snapshots.commits(spark, path)
    return last.join(last.agg(F.max("version").alias("version")), "version").select("name", "n_rows", F.col("version").cast("int").alias("version"))


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(d.alias("document_id"), F.col("source").alias("title"), (F.col("n_chars") % 3).alias("source_spans_count"), (d % 2).alias("indexed_points_count"), F.when(d % 11 == 0, "pending").alias("deletion_status"))


@query("""SELECT doc_id AS document_id, CASE WHEN n_chars % 3 = 0 THEN 'no_source_spans' WHEN doc_id % 2 = 0 THEN 'no_index' ELSE 'completed' END AS status FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT DISTINCT doc_id + 500, 'failed' FROM documents WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0)""")
def pr07_j27_catalog(spark, sf_dir):
    rows = catalog.items(catalog_rows(spark, sf_dir)).select("document_id", "status")
    failed = read(spark, sf_dir, "documents").select((F.col("doc_id") + 500).alias("document_id")).distinct()
    return catalog.with_failed(rows, failed, "document_id")


@query("SELECT (SELECT count(*) FROM documents WHERE n_chars % 3 > 0 AND doc_id % 2 = 1) AS completed, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS no_index, (SELECT count(*) FROM documents WHERE n_chars % 3 = 0) AS no_source_spans, (SELECT count(*) FROM documents) AS total")
def f24_a10_catalog_counts(spark, sf_dir):
    kinds = ("completed", "no_index", "no_source_spans")
    return catalog_rows(spark, sf_dir).agg(*[F.count_if(catalog.in_status(k)).alias(k) for k in kinds], F.count_if(catalog.in_status(None)).alias("total"))


@query("""SELECT doc_id AS i, CASE WHEN doc_id % 4 = 0 THEN 'gap-' || doc_id ELSE 'g' END AS id, CASE WHEN doc_id % 3 = 0 THEN 'Пробел знаний ' || (doc_id + 1) ELSE substr(d, 1, 80) END AS title, CASE WHEN doc_id % 3 = 0 THEN 'Пробел знаний ' || (doc_id + 1) ELSE d END AS description,
 concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'output' END, CASE WHEN doc_id % 5 = 0 THEN 'medium' ELSE 'high' END, CASE WHEN doc_id % 7 <> 0 THEN 'Сущности: a, b, c' END) AS tags FROM (SELECT doc_id, 'no data on ' || repeat('x', 90) || doc_id AS d FROM documents)""")
def pr10_gap_labels(spark, sf_dir):
    d = F.col("doc_id")
    words = F.array(*[F.lit(w) for w in ("a", "", "b", "c", "d")])
    gaps = read(spark, sf_dir, "documents").select(d.alias("i"), F.when(d % 4 != 0, "g").alias("gap_id"), F.when(d % 3 == 0, " ").otherwise(F.concat(F.lit("no data on "), F.repeat(F.lit("x"), 90), d.cast("string"))).alias("description"), F.when(d % 2 == 0, "output").alias("expected_relation"), F.when(d % 7 != 0, words).alias("entity_ids"), F.when(d % 5 != 0, "high").alias("priority"))
    return catalog.gap_labels(gaps).withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT conv_id, place, 'Стр. ' || turn AS page, substr(t, 1, 160) AS snippet, 's' || turn AS span_id FROM (SELECT conv_id, turn, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE place <= 8""")
def pr08_evidence_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("s"), "turn").alias("span_id"), F.lit(None).cast("string").alias("document_id"), F.col("turn").alias("page"), "text")
    return catalog.evidence_rows(rows, "conv_id", "turn").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {Q}, {FLAGS} SELECT doc_id, len(string_split(s, '|')) AS n FROM (SELECT doc_id, s FROM (SELECT doc_id, concat_ws('|', CASE WHEN {CLASS} <> 'graph_centric' OR num OR geo OR tim THEN 'semantic' END, CASE WHEN n > 0 OR len(string_split(note, ' ')) <= 4 OR regexp_matches(note, '[A-Z]') THEN 'lexical' END,
 CASE WHEN {CLASS} IN ('numeric', 'comparative', 'mixed') THEN 'table' END, CASE WHEN num THEN 'numeric' END, CASE WHEN geo THEN 'geo' END, CASE WHEN tim THEN 'time' END, CASE WHEN {CLASS} IN ('graph_centric', 'comparative', 'mixed') OR gr THEN 'graph' END, 'skipped') AS s FROM f))""")
def pr11_trace_steps(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", F.size(catalog.trace_steps(planning.profiles(F.col("ir")))).cast("long").alias("n"))


@query("""SELECT o_orderkey AS document_id, coalesce(spans, 0) AS spans, coalesce(t, 0) AS table_spans, coalesce(c, 0) AS confirmed, coalesce(x, 0) AS candidates FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS spans, count(*) FILTER (l_linestatus = 'O') AS t FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) USING (o_orderkey)
 LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'A') AS c, count(*) FILTER (l_returnflag <> 'A') AS x FROM lineitem WHERE l_linenumber < 3 GROUP BY 1) USING (o_orderkey) WHERE spans IS NOT NULL OR c IS NOT NULL""")
def pr12_ingestion_report(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    spans = items.where("l_linenumber > 1").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linestatus") == "O", "table").otherwise("text").alias("source_type"))
    artifacts = items.where("l_linenumber < 3").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("candidate").alias("status"))
    return catalog.ingestion_report(spans, artifacts)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS rank FROM part WHERE p_size % 5 <> 0 AND p_partkey % 3 <> 0")
def pr13_notifiable(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, "claim").otherwise("").alias("kind"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("value"), F.when(F.col("p_size") % 2 == 0, "confirmed").alias("status"))
    return catalog.notifiable(rows).select("id", "rank")


@query("SELECT event_id AS id, CAST(greatest(coalesce(value, 0.0) / 100, 0.1) AS DOUBLE) AS confidence, 'confirmed' AS status FROM events")
def pr16_verification_artifacts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("span_id"), F.col("event_type").alias("text"), (F.col("value") / 100).alias("score"))
    return catalog.verification_artifacts(rows).select("id", "confidence", "status")


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS claim_id, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE '' END AS statement, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'candidate' END AS status, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber END AS page, CASE WHEN l_returnflag = 'A' THEN 'table' ELSE 'text' END AS source_type FROM lineitem""")
def pr06_evidence_records(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("claim_id"), F.when(n % 2 == 0, "x").alias("statement"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linestatus") == "F", "F").alias("status"), F.lit("s").alias("span_id"), F.when(n == 1, 0).otherwise(n).alias("page"), F.when(F.col("l_returnflag") == "A", "table").alias("source_type"), F.col("l_orderkey").alias("document_id"), F.lit("public").alias("access_level"))
    return catalog.evidence_records(rows).select("claim_id", "statement", "status", "page", "source_type")


@query("SELECT CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'table' WHEN l_linestatus = 'F' THEN 'semantic' ELSE 'exact' END AS method, count(*) AS n FROM lineitem GROUP BY 1")
def v22_table_method(spark, sf_dir):
    method = catalog.table_method(F.when(F.col("l_returnflag") == "A", "table").otherwise("text"), F.when(F.col("l_linestatus") == "F", "semantic").otherwise("exact"))
    return read(spark, sf_dir, "lineitem").groupBy(method.alias("method")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'schema_candidate' ELSE 'unsupported_claim' END AS reason_code FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 3 > 0")
def v19_graph_candidates(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "candidate").when(F.col("o_orderstatus") == "P", "extracted").otherwise("verified")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 3 > 0, "s").alias("statement"), F.lit(0.4).alias("confidence"), status.alias("status"))
    return catalog.graph_candidates(rows).select("id", "reason_code")


@query("""SELECT event_id AS id, unnest(CASE event_type WHEN 'error' THEN list_filter([CASE WHEN event_id % 2 = 0 THEN 'access_denied audit details missing ''reason''' END, 'access_denied audit details missing ''required_level'''], lambda e: e IS NOT NULL) WHEN 'view' THEN [] ELSE ['unsupported access audit action: ' || event_type] END) AS error FROM events""")
def f26_missing_details(spark, sf_dir):
    e = F.col("event_id")
    action = F.when(F.col("event_type") == "error", "access_denied").when(F.col("event_type") == "view", "policy_changed").otherwise(F.col("event_type"))
    details = F.when(F.col("event_type") == "view", F.create_map(F.lit("before"), F.lit("a"), F.lit("after"), F.lit("b"))).otherwise(F.create_map(F.lit("reason"), F.when(e % 2 == 0, "").otherwise("r")))
    return catalog.missing_details(read(spark, sf_dir, "events").select(e.alias("id"), action.alias("action"), details.alias("details")))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 10 = 3 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 40")
def f25_m17_audit(spark, sf_dir):
    import datetime

    events = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"), (F.col("user_id") % 10).alias("user_id"), F.lit("doc").alias("resource_type"), F.col("ts").alias("created_at"))
    found = catalog.audit(events, "view", 3, "doc", datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20))
    return found.orderBy(F.desc("created_at"), F.desc("event_id")).limit(40).select("event_id")


@query("SELECT count(*) FILTER (user_id = 7) AS own, count(*) AS every FROM events")
def f30_of_owner(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    own, every = catalog.of_owner(events, 7, False).agg(F.count("*").alias("own")), catalog.of_owner(events, 7, True).agg(F.count("*").alias("every"))
    return own.crossJoin(F.broadcast(every))  # one row each


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND contains(lower(p_name || ' SMALL ' || p_brand || ' Russia'), 'red') AND p_size % 2 = 0")
def f29_facets(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("material"), F.col("p_brand").alias("process"), F.when(F.col("p_size") % 2 == 0, "Russia").otherwise("International").alias("geo"))
    return catalog.facets(rows, " RED ", "SMALL", "all", "domestic").select("p_partkey")


@query("""WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'hydro' WHEN s_suppkey % 3 = 1 THEN 'pyro' END AS id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49.5) AS c, s_nationkey AS d FROM supplier)
 SELECT id, round_even(count(*) FILTER (c > 0) / count(*), 2) AS coverage, CAST(sum(d) AS BIGINT) AS documents FROM p WHERE id IS NOT NULL GROUP BY 1""")
def a05_directions(spark, sf_dir):
    counts = read(spark, sf_dir, "lineitem").where("l_quantity > 49.5").groupBy("l_suppkey").agg(F.count("*").alias("claim_count"))
    name = F.when(F.col("s_suppkey") % 3 == 0, "Leaching").when(F.col("s_suppkey") % 3 == 1, "Обжиг руды").otherwise("other")
    rows = read(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(name.alias("name"), F.coalesce("claim_count", F.lit(0)).alias("claim_count"), F.col("s_nationkey").cast("long").alias("document_count"))
    return catalog.directions(rows)


@query("SELECT p_brand AS brand, count(*) FILTER (p_type = 'SMALL') AS SMALL, count(*) FILTER (p_type = 'LARGE') AS LARGE FROM part WHERE p_type IN ('SMALL', 'LARGE') GROUP BY 1")
def a07_coverage_matrix(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where("p_type in ('SMALL', 'LARGE')").withColumnRenamed("p_brand", "brand")
    return catalog.coverage_matrix(rows, "brand", "p_type", ["SMALL", "LARGE"])


@query("SELECT count(*) AS documents, count(*) FILTER (doc_id % 3 = 2) AS restricted, (SELECT count(*) FROM events WHERE event_type = 'error') AS denied FROM documents")
def a08_admin_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("doc_id") % 3 == 2).alias("restricted"))
    return docs.crossJoin(F.broadcast(catalog.audit(read(spark, sf_dir, "events").withColumnRenamed("event_type", "action"), "error").agg(F.count("*").alias("denied"))))  # one row each


@query("SELECT event_type, user_id % 3 AS status, count(*) AS n, count(*) FILTER (value <= 10) AS le_0, count(*) FILTER (value <= 50) AS le_1 FROM events GROUP BY 1, 2")
def a22_requests(spark, sf_dir):
    return catalog.requests(read(spark, sf_dir, "events").withColumn("status", F.col("user_id") % 3), ["event_type", "status"], "value", [10.0, 50.0])


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def a24_joined_texts(spark, sf_dir):
    return catalog.joined_texts(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""WITH k AS (SELECT 'kind=measurement|property=measurement|material=' || l_partkey AS key, l_returnflag AS unit, l_quantity AS value, l_linenumber = 7 AS marked FROM lineitem WHERE l_linestatus = 'F'),
 g AS (SELECT key, min(unit) < max(unit) AS several, count(*) AS n, max(value) - min(value) > 0.000001 AND count(*) > 1 AS apart, count(*) FILTER (marked) AS m FROM k GROUP BY 1)
 SELECT key, 'needs_unit_check' AS reason, n AS artifacts FROM g WHERE several UNION ALL SELECT key, 'conflicting_values', n FROM g WHERE NOT several AND apart UNION ALL SELECT key, 'marked_conflict', m FROM g WHERE NOT several AND m > 0""")
def a14_x36_conflict_signals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "F", "measurement").otherwise("entity").alias("kind"), F.create_map(F.lit("material"), F.col("l_partkey").cast("string"), F.lit("process"), F.lit("")).alias("metadata"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value"), F.when(F.col("l_linenumber") == 7, F.array(F.lit("conflicting_values"))).alias("reason_codes"))
    return catalog.conflict_signals(rows)


@query("""SELECT 'material_has_name' AS rule, 'error' AS severity, count(*) AS n FROM part WHERE p_size % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'quantity_within_physical_range', 'warning', count(*) FROM part WHERE NOT p_retailprice BETWEEN 950 AND 1500 HAVING count(*) > 0
 UNION ALL SELECT 'source_has_span', 'error', count(*) FROM part WHERE p_size % 4 = 0 HAVING count(*) > 0 UNION ALL SELECT 'confidence_in_range', 'error', count(*) FROM part WHERE p_size > 45 HAVING count(*) > 0""")
def dq1_dq7_ontology(spark, sf_dir):
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part").select(F.when(size % 9 != 0, F.col("p_name")).alias("name"), F.lit("C").alias("unit"), F.col("p_retailprice").alias("value"), F.when(size % 4 != 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("source_span_ids"), (size / 45).alias("confidence"), F.lit("x").alias("location_name"), F.lit("t").alias("title"))
    return evaluation.violations(rows, catalog.ontology_rules(950, 1500))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 2 = 0)")
def dq_wrong_ends(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_suppkey").alias("src"), F.lit("USES").alias("rel_type"), F.concat(F.lit("m"), "l_partkey").alias("dst")).distinct()
    nodes = read(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("id"), F.lit("Process").alias("node_type"))
    nodes = nodes.union(read(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "Odd").otherwise("Material")))
    allowed = spark.createDataFrame([("USES", "Process", "Material")], "rel_type string, src_type string, dst_type string")
    return catalog.wrong_ends(edges, nodes, allowed).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def t10_review_queue(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30).select("o_orderkey", "o_orderdate")


@query("SELECT l_linenumber AS page, l_partkey AS span, row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_orderkey = 5")
def t11_spans_of_a_document(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = read(spark, sf_dir, "lineitem").where("l_orderkey = 5")  # one document's rows
    return rows.select(F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("span"), F.row_number().over(W.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("place"))


@query("SELECT user_id, max(ts) AS updated, count(*) AS messages FROM events GROUP BY 1 ORDER BY updated DESC, user_id LIMIT 20")
def t12_sessions(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated"), F.count("*").alias("messages")).orderBy(F.desc("updated"), "user_id").limit(20)


@query("SELECT user_id, event_type AS value, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id) = 1")
def w04_first_occurrences(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.lower("event_type").alias("low"), F.col("event_type").alias("value"), F.col("event_id").alias("pos"))
    return state.first_wins(events, ["user_id", "low"], "pos", "value", "pos").drop("low")


@query("""SELECT event_type AS kind, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r <= CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN 10 WHEN 'error' THEN 20 WHEN 'purchase' THEN 30 ELSE 120 END GROUP BY 1""")
def w08_caps(spark, sf_dir):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    cap = F.when(F.col("event_type") == "view", 8).when(F.col("event_type") == "click", 10).when(F.col("event_type") == "error", 20).when(F.col("event_type") == "purchase", 30).otherwise(120)
    rows = read(spark, sf_dir, "events").select("event_type", rank.alias("r")).where(F.col("r") <= cap)
    return rows.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'ring') UNION SELECT p_partkey FROM part WHERE contains(lower(p_brand), '1')")
def u02_union_distinct(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    pick = lambda c, w: part.where(F.lower(c).contains(w)).select(F.col("p_partkey").alias("id"))
    return pick("p_name", "ring").union(pick("p_brand", "1")).distinct()


@query("""WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, CASE WHEN p_size % 5 <> 0 THEN string_split(lower(p_type), ' ') END AS b, string_split(lower(p_brand), '#') AS c FROM part),
 u AS (SELECT *, list_concat(a, coalesce(b, []), a) AS every FROM p) SELECT p_partkey, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '|') AS ids,
 len(list_intersect(list_concat(a, c), list_concat(coalesce(b, []), c, a[1:1]))) AS common, NOT list_has_any(a, coalesce(b, [])) AS disjoint FROM u""")
def u03_u04_u06_sets(spark, sf_dir):
    """The words of a part's name and type: united in order, shared, and whether none is; every fifth part has no type."""
    words = lambda c, by=" ": F.split(F.lower(c), by)
    a, c, none = words("p_name"), words("p_brand", "#"), F.array().cast("array<string>")
    b = F.when(F.col("p_size") % 5 != 0, words("p_type"))
    known = F.coalesce(b, none)
    common = F.size(F.array_intersect(F.concat(a, c), F.concat(known, c, F.slice(a, 1, 1))))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.union_in_order(text.union_in_order(a, b), a), "|").alias("ids"), common.alias("common"), (~F.arrays_overlap(a, known)).alias("disjoint"))


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS claim, round(least(1.0, (1 - l_discount) * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.3 ELSE 0.4 END + CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 0.05 ELSE 0 END), 6) AS score FROM lineitem ORDER BY score DESC, claim LIMIT 40""")
def t04_x34_claim_scores(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "conflicting").otherwise("odd")
    score = verify.claim_score(1 - F.col("l_discount"), status, F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("claim"), score.alias("score")).orderBy(F.desc("score"), "claim").limit(40)


@query("SELECT o_orderkey, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS artifacts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j26_job_artifacts(spark, sf_dir):
    """A job has few artifacts: at most seven lines an order."""
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    names = F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["l_partkey"], x["l_linenumber"])), ",")
    return read(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left").select("o_orderkey", names.alias("artifacts"))
