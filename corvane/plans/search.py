"""Queries of the search index, verification and synthesis: documents with a closing note are spans, parts are table rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import entities, ids, quantities, terms, text, verify
from corvane.operators import retrieval, storage
from corvane.plans.extraction import FOUND, NOTE, NOTES, PATTERN, any_of, joined, named, notes, quoted
from corvane.plans.queries import LEVELS, TOKENS_SQL, query, read


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    spans = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.lit(0).alias("start_offset"), F.length(F.expr(NOTE)).alias("end_offset"), F.expr(NOTE).alias("text"), F.lit(None).cast("string").alias("table_block_id"), F.lit("text").alias("source_type"))
    allowed = F.when(F.expr(LEVELS) == "restricted", F.array(F.lit("auditor"))).otherwise(F.array().cast("array<string>"))
    known = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("source_type"), F.expr(LEVELS).alias("access_level"), allowed.alias("allowed_roles"), F.lit(None).cast("int").alias("year"), F.lit("v1").alias("dictionary_version_id"))
    links = docs.select(ids.span_id(F.col("doc_id"), F.lit(1), F.lit(0), F.length(F.expr(NOTE))).alias("span_id"), F.array(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("claim_ids"), F.array().cast("array<string>").alias("entity_ids"))
    return retrieval.payloads(spans, known, links)


ID = f"substr(sha1(doc_id || ':1:0:' || length({NOTE}) || ':'), 1, 16)"
VALUES = "list_transform(regexp_extract_all(note, '[-+]?[0-9]+(?:[,.][0-9]+)?'), lambda x: TRY_CAST(replace(replace(x, ',', '.'), '+', '') AS DOUBLE))"
YEARS = "CASE WHEN regexp_matches(note, '20[0-9][0-9]\\s*[-–—]\\s*20[0-9][0-9]') THEN CAST(right(regexp_extract(note, '20[0-9][0-9]\\s*[-–—]\\s*20[0-9][0-9]'), 4) AS INTEGER) ELSE TRY_CAST(nullif(regexp_extract(note, '\\b20[0-9][0-9]\\b'), '') AS INTEGER) END"
UNITS = f"list_distinct(list_transform(regexp_extract_all(note, {quoted('(?i)' + quantities.UNIT)}), lambda u: CASE lower(u) {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in terms.UNITS.items())} ELSE lower(u) END))"
BUCKET = f"CASE WHEN {any_of('low', terms.DOMESTIC)} THEN 'domestic' WHEN {any_of('low', terms.FOREIGN)} THEN 'foreign' ELSE 'unknown' END"
INDEX = f"""WITH {NOTES}, p AS (SELECT n.doc_id, n.note, n.low, {LEVELS.replace('doc_id', 'n.doc_id')} AS level, d.source, list_min({VALUES}) AS numeric_min, list_max({VALUES}) AS numeric_max, {UNITS} AS units, {BUCKET} AS bucket, {YEARS} AS year,
 substr(sha1(n.doc_id || ':1:0:' || length(note) || ':'), 1, 16) AS span_id FROM notes n JOIN documents d ON n.doc_id = d.doc_id)"""


@query(f"""{INDEX} SELECT span_id AS source_span_id, regexp_replace(substr(sha256(span_id), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS point_id, 'source_span' AS item_type, level AS access_level, numeric_min, numeric_max,
 {joined('units')} AS units, bucket AS geo_bucket, year AS published_year, 'c' || doc_id AS claims, len({TOKENS_SQL.replace("coalesce(text, '')", 'note')}) AS tokens FROM p""")
def pr01_payloads(spark, sf_dir):
    return index(spark, sf_dir).select("source_span_id", "point_id", "item_type", "access_level", "numeric_min", "numeric_max", F.array_join(F.array_sort("units"), "|").alias("units"), "geo_bucket", "published_year", F.array_join("claim_ids", "|").alias("claims"), F.size("lexical_tokens").cast("long").alias("tokens"))


@query(f"""{INDEX} SELECT span_id AS source_span_id FROM p WHERE level IN ('public', 'internal') AND numeric_max >= 12 AND numeric_min <= 18 AND (list_contains(units, 'mg/l') OR list_contains(units, '%')) AND bucket IN ('domestic', 'foreign') AND year BETWEEN 2018 AND 2024""")
def f02_f09_filtered_index(spark, sf_dir):
    holds = retrieval.asked_for(["researcher"], version="v1", low=12, high=18, units=["mg/l", "%"], places=["Domestic", "foreign"], years=(2018, 2024))
    return index(spark, sf_dir).where(holds).select("source_span_id")


@query(f"{INDEX} SELECT level, source, count(*) AS n FROM p WHERE level = 'public' AND source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents) GROUP BY 1, 2")
def f03_f05_levels_sources(spark, sf_dir):
    ends = read(spark, sf_dir, "documents").agg(F.min("source"), F.max("source")).first()
    found = index(spark, sf_dir).where(retrieval.asked_for(["partner"], source_types=list(ends)))
    return found.groupBy(F.col("access_level").alias("level"), F.col("document_source_type").alias("source")).agg(F.count("*").alias("n"))


@query(f"{INDEX} SELECT doc_id FROM p WHERE len(list_intersect({TOKENS_SQL.replace("coalesce(text, '')", 'note')}, ['flotation', 'slag'])) > 0 OR contains(low, 'россия') OR regexp_matches(note, '[0-9]') AND false OR list_contains(units, 'kg/t')")
def f16_any_match(spark, sf_dir):
    ask = verify.asked(numeric=F.array(F.struct(F.lit(None).cast("double").alias("value"), F.lit("kg/t").alias("unit"), F.lit("eq").alias("operator"), F.lit(None).cast("double").alias("range_min"), F.lit(None).cast("double").alias("range_max"))), places=F.array(F.lit("Россия")))
    loose = retrieval.any_match(["flotation", "slag"], F.col("text"), F.col("units"), F.col("geo_bucket"), F.lit(""), ask.dropFields("numeric").withField("numeric", F.array().cast("array<struct<value: double, unit: string, operator: string, range_min: double, range_max: double>>")))
    return index(spark, sf_dir).where(loose | F.array_contains("units", "kg/t")).select(F.col("document_id").cast("long").alias("doc_id"))


@query(f"WITH {NOTES} SELECT doc_id FROM notes WHERE len(list_intersect({TOKENS_SQL.replace("coalesce(text, '')", 'note')}, ['flotation', 'journal'])) > 0")
def f11_any_token(spark, sf_dir):
    return notes(spark, sf_dir).where(text.token_share(F.col("note"), ["flotation", "journal"]) > 0).select("doc_id")


@query(f"{INDEX} SELECT span_id AS source_span_id, doc_id FROM p WHERE span_id IN (SELECT span_id FROM p WHERE doc_id % 97 = 3)")
def f13_points_by_span(spark, sf_dir):
    points = index(spark, sf_dir)
    wanted = points.where(F.col("document_id").cast("long") % 97 == 3).select("source_span_id")
    return points.join(wanted, "source_span_id", "left_semi").select("source_span_id", F.col("document_id").cast("long").alias("doc_id"))


@query("SELECT count(*) AS points, count(DISTINCT doc_id) AS documents, 0 AS table_rows FROM documents WHERE doc_id % 3 <> 1")
def f14_sc18_delete_status(spark, sf_dir):
    points = index(spark, sf_dir).select("document_id", "item_type")
    return retrieval.status(retrieval.without_documents(points, points.where(F.col("document_id").cast("long") % 3 == 1)))


@query("""WITH p AS (SELECT count(DISTINCT doc_id) AS n FROM documents), t(step, state, times) AS (VALUES (0, 'missing', 0), (1, 'green', 0), (2, 'green', 1), (3, 'green', 1), (4, 'green', 0))
 SELECT step, state, times * n AS points, times * n AS documents, times * (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 3 = 0) AS table_rows FROM t, p""")
def sc18_index_lifecycle(spark, sf_dir):
    """An index made, filled, filled again with the same points, and emptied; its state after each step."""
    folder, row = storage.new_path(spark, "index"), F.col("doc_id") % 3 == 0
    points = read(spark, sf_dir, "documents").select(F.concat(F.lit("s"), "doc_id").alias("source_span_id"), F.col("doc_id").cast("string").alias("document_id"), F.when(row, "table_row").otherwise("source_span").alias("item_type")).distinct()
    steps = [lambda: None, lambda: retrieval.bootstrapped(spark, folder, points.schema), lambda: retrieval.upserted_points(folder, points), lambda: retrieval.upserted_points(folder, points), lambda: retrieval.reset(spark, folder)]
    states = []
    for number, step in enumerate(steps):
        step()
        states.append(retrieval.index_status(spark, folder).select(F.lit(number).alias("step"), "*"))
    return functools.reduce(DataFrame.unionByName, states)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def sc17_upserted_points(spark, sf_dir):
    points = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_span_id"), F.lit("old").alias("state"))
    return retrieval.replaced(points, points.where("source_span_id % 5 = 0").withColumn("state", F.lit("new"))).withColumnRenamed("source_span_id", "doc_id")


@query("""SELECT 't' || p_partkey AS document_id, i AS start_offset, i + length(r) AS end_offset, r AS text, 'b' || p_partkey || ':row:' || i AS table_block_id FROM (SELECT p_partkey, 0 AS i, CASE WHEN p_size > 25 THEN p_brand || '. ' ELSE '' END || 'name: ' || p_name || '; size: ' || p_size || '; col_3: ' || p_type AS r FROM part
 UNION ALL SELECT p_partkey, 1, CASE WHEN p_size > 25 THEN p_brand || '. ' ELSE '' END || 'name: x' FROM part)""")
def pr02_table_row_spans(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    row = F.array("p_name", F.col("p_size").cast("string"), "p_type")
    caption = F.when(F.col("p_size") > 25, F.col("p_brand"))
    tables = part.select(F.concat(F.lit("b"), "p_partkey").alias("id"), F.concat(F.lit("t"), "p_partkey").alias("document_id"), F.lit(1).alias("page"), caption.alias("caption"), F.array(F.lit("name"), F.lit("size")).alias("headers"), F.array(row, F.array(F.lit("x"))).alias("rows"))
    return retrieval.table_rows(tables).select("document_id", "start_offset", "end_offset", "text", "table_block_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page, 0 AS start_offset, length(coalesce(text, '')) AS end_offset, CASE WHEN doc_id % 4 = 1 THEN 'table' ELSE 'text' END AS source_type FROM documents")
def pr04_spans_of_payloads(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 4 == 1, "table").when(F.col("doc_id") % 4 == 2, "odd")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("page"), F.lit(None).cast("int").alias("start_offset"), F.lit(0).alias("end_offset"), "text", F.lit("").alias("table_block_id"), kind.alias("source_type"))
    return retrieval.span_of(rows).select("document_id", "page", "start_offset", "end_offset", "source_type")


@query("""SELECT 's' || l_orderkey AS span_id, array_to_string(list_sort(list_distinct(list(CASE WHEN l_linenumber % 2 = 0 THEN 'a' || l_partkey END))), '|') AS claims, array_to_string(list_sort(list_distinct(list(CASE WHEN l_linenumber % 2 = 1 THEN 'a' || l_partkey END))), '|') AS entities FROM lineitem GROUP BY 1""")
def j17_span_links(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    artifacts = items.select(F.concat(F.lit("a"), "l_partkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "claim").otherwise("material").alias("kind"), F.array(F.concat(F.lit("s"), "l_orderkey")).alias("source_span_ids"))
    return retrieval.span_links(artifacts).select("span_id", F.array_join("claim_ids", "|").alias("claims"), F.array_join("entity_ids", "|").alias("entities"))


@query(f"""{INDEX} SELECT span_id AS source_span_id FROM p WHERE doc_id % 7 = 0 AND level IN ('public', 'internal')""")
def j18_j19_visible_again(spark, sf_dir):
    points = index(spark, sf_dir)
    return retrieval.visible_again(points.where(F.col("document_id").cast("long") % 7 == 0).select("source_span_id"), points, "source_span_id", ["analyst"])


@query("""WITH i AS (SELECT doc_id AS id, 0.9 AS score FROM documents WHERE doc_id % 4 = 0), g AS (SELECT l_orderkey AS id, min('c' || l_orderkey || '-' || l_linenumber) AS claim FROM lineitem WHERE l_orderkey < 2000 GROUP BY 1),
 c AS (SELECT id, claim, (SELECT min(1 - l_discount) FROM lineitem WHERE 'c' || l_orderkey || '-' || l_linenumber = claim) AS confidence FROM g)
 SELECT id, CAST(score AS DOUBLE) AS score, 'semantic' AS method, '' AS claims FROM i UNION ALL SELECT id, greatest(round(confidence, 6), 0.55), 'exact', claim FROM c WHERE id NOT IN (SELECT id FROM i)""")
def j20_graph_evidence(spark, sf_dir):
    items = read(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.lit(0.9).alias("score"))
    lines = read(spark, sf_dir, "lineitem").where("l_orderkey < 2000").groupBy("l_orderkey", "l_linenumber").agg(F.round(1 - F.max("l_discount"), 6).alias("confidence"))
    graph = lines.select(F.col("l_orderkey").alias("id"), "confidence", F.concat(F.lit("c"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("claim_id"))
    return retrieval.with_graph_evidence(items, graph, "id").select("id", "score", "method", F.array_join("claim_ids", "|").alias("claims"))


@query("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'little' WHEN 'LARGE' THEN 'great' ELSE p_type END AS canonical FROM part")
def j23_canonical(spark, sf_dir):
    names = spark.createDataFrame([("small", "little"), ("Large", "great")], "alias string, canonical string")
    return retrieval.canonical(read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("value")), names).select("p_partkey", "canonical")


@query("SELECT DISTINCT p_partkey, c AS canonical FROM part, (VALUES ('ring', 'Ring'), ('red', 'Red'), ('re', 'Red'), ('bolt', 'Bolt')) AS n(a, c) WHERE contains(lower(p_name), a)")
def j24_enriched_questions(spark, sf_dir):
    names = spark.createDataFrame([("RING", "Ring"), ("red", "Red"), ("re", "Red"), ("bolt", "Bolt"), ("", "none")], "alias string, canonical string")
    return retrieval.enriched(read(spark, sf_dir, "part"), names, "p_partkey", "p_name")


INTERESTS = "('u1', 'materials', 0.45, ['шлак', 'Cu']), ('u2', 'processes', 0.65, ['Flotation', 'нет']), ('u3', 'kind', 1.0, ['mixed'])"


@query(f"""WITH {NOTES}, i AS (SELECT *, list_distinct(list_transform(list_concat([label], words), lambda w: lower(w))) AS w FROM (VALUES {INTERESTS}) AS t(user_id, label, weight, words)),
 a AS (SELECT doc_id, 'claim ' || low || ' ' || '{{"kind": "x"}}' AS t, '{{"kind": "x"}}' AS m, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.55 END * CASE WHEN doc_id % 3 = 0 THEN 0.88 ELSE 1.0 END AS penalty FROM notes),
 h AS (SELECT user_id, label, doc_id AS id, weight, penalty, len(list_filter(w, lambda x: contains(t, x))) AS hits, len(list_filter(w, lambda x: contains(m, x))) AS more FROM a, i)
 SELECT user_id, label, id, round(CAST(least(1.0, weight * (0.45 + 0.12 * hits + least(0.25, 0.08 * more)) * 0.8 * penalty) AS DOUBLE), 6) AS score FROM h WHERE hits > 0""")
def j22_matched_interests(spark, sf_dir):
    own = spark.createDataFrame([("u1", "materials", 0.45, ["шлак", "Cu"]), ("u2", "processes", 0.65, ["Flotation", "нет"]), ("u3", "kind", 1.0, ["mixed"])], "user_id string, label string, weight double, source_terms array<string>")
    codes = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    artifacts = notes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("claim").alias("kind"), F.col("note").alias("value"), F.when(F.col("doc_id") % 2 == 0, "confirmed").otherwise("candidate").alias("status"), F.lit(0.8).alias("confidence"), codes.alias("reason_codes"), F.lit('{"kind": "x"}').alias("metadata"))
    return retrieval.matched_interests(own, artifacts)


def asks() -> Column:
    """What the question of a document asks for, by its number."""
    numeric = lambda v, u, o, a, b: F.array(F.struct(F.lit(v).cast("double").alias("value"), F.lit(u).alias("unit"), F.lit(o).alias("operator"), F.lit(a).cast("double").alias("range_min"), F.lit(b).cast("double").alias("range_max")))
    q = F.col("doc_id") % 3
    none = F.array().cast("array<string>")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    numbers = F.when(q == 0, numeric(5, "%", "eq", None, None)).when(q == 1, numeric(None, "MG/L", "range", 12, 18))
    return verify.asked(numeric=numbers, places=F.when(q == 0, words("Россия")).when(q == 2, words("norilsk", "Норильский регион")).otherwise(none), start_year=F.when(q == 1, 2019), end_year=F.when(q == 1, 2021), has_time=q == 1, source_types=F.when(q == 2, words("Journal")).otherwise(none), named=F.when(q == 0, words("никель", "Cu")).otherwise(none), aliases=F.when(q == 2, words("SL")).otherwise(none))


YEAR = "list_transform(regexp_extract_all(regexp_replace(note, '([^\\p{L}\\p{N}\\p{M}_])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{N}\\p{M}_])((?:19|20)[0-9]{2})(?:$|[^\\p{L}\\p{N}\\p{M}_])', 1), lambda y: CAST(y AS INTEGER))"
FORM = "trim(regexp_replace(translate(low, '–—‑', '---'), '\\s+', ' ', 'g'))"
CODES = f"""{NOTES}, {FOUND}, cover AS (SELECT doc_id, count(*) AS n, bool_or(unit = '%' AND abs(a - 5) <= 0.05) AS c0, bool_or(unit = 'mg/l' AND CASE WHEN b IS NULL THEN a BETWEEN 12 AND 18 ELSE least(a, b) <= 12 AND greatest(a, b) >= 18 END) AS c1,
 bool_or(unit = '%') AS u0, bool_or(unit = 'mg/l') AS u1 FROM found GROUP BY 1),
 x AS (SELECT n.doc_id, n.note, n.low, {FORM} AS form, {named(terms.PLACES)} AS places, n.doc_id % 3 AS q, coalesce(c.n, 0) AS k, coalesce(c.c0, false) AS c0, coalesce(c.c1, false) AS c1, coalesce(c.u0, false) AS u0, coalesce(c.u1, false) AS u1, {YEAR} AS years FROM notes n LEFT JOIN cover c USING (doc_id)),
 codes AS (SELECT doc_id, q, note, form, concat_ws(',', CASE WHEN q = 0 AND NOT c0 THEN CASE WHEN k > 0 AND NOT u0 THEN 'unit_mismatch' ELSE 'unsupported_claim' END WHEN q = 1 AND NOT c1 THEN CASE WHEN k > 0 AND NOT u1 THEN 'unit_mismatch' ELSE 'unsupported_claim' END END,
  CASE WHEN q = 0 AND NOT (contains(form, 'россия') OR list_contains(places, 'Россия')) OR q = 2 AND NOT (contains(form, 'norilsk') AND (contains(form, 'норильский регион') OR list_contains(places, 'Норильский регион'))) THEN 'geo_mismatch' END,
  CASE WHEN q = 1 AND len(list_filter(years, lambda y: y BETWEEN 2019 AND 2021)) = 0 THEN 'outside_time_range' END, CASE WHEN q = 2 AND NOT contains(low, 'journal') THEN 'inaccessible_source' END,
  CASE WHEN q = 0 AND NOT (contains(low, 'никель') OR contains(low, 'cu')) THEN 'unresolved_alias' END) AS codes FROM x)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = asks()
    rows = text.once(notes(spark, sf_dir), "codes", verify.reason_codes(F.col("doc_id").cast("string"), F.col("note"), ask))
    return rows.withColumn("layer", verify.layer(F.col("codes")))


@query(f"WITH {CODES} SELECT doc_id, codes FROM codes")
def f18_f22_reason_codes(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", F.array_join("codes", ",").alias("codes"))


LAYER = "CASE WHEN codes = '' THEN 'verified' WHEN regexp_matches(codes, 'conflicting_values|needs_unit_check') THEN 'conflicting' WHEN regexp_matches(codes, 'missing_source_span|unsupported_claim|inaccessible_source') THEN 'unsupported' ELSE 'candidate' END"


@query(f"WITH {CODES} SELECT q, {LAYER} AS layer, count(*) AS n FROM codes GROUP BY 1, 2")
def v13_layers(spark, sf_dir):
    return judged(spark, sf_dir).groupBy((F.col("doc_id") % 3).alias("q"), "layer").agg(F.count("*").alias("n"))


@query(f"WITH {CODES} SELECT doc_id, codes = '' AS verified FROM codes WHERE doc_id % 2 = 0")
def v12_partition(spark, sf_dir):
    return judged(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", (F.size("codes") == 0).alias("verified"))


SNIPPET = "CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 177)) || '...' END"


@query(f"""WITH {CODES}, l AS (SELECT doc_id % 20 AS question, doc_id, {LAYER} AS layer, trim(regexp_replace(note, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS t FROM codes),
 n AS (SELECT question, count(*) FILTER (layer = 'verified') AS verified, count(*) FILTER (layer <> 'verified') AS others FROM l GROUP BY 1), s AS (SELECT question, string_agg({SNIPPET}, ' | ' ORDER BY doc_id) AS s FROM (SELECT * FROM l WHERE layer = 'verified' QUALIFY row_number() OVER (PARTITION BY question ORDER BY doc_id) <= 3) GROUP BY 1)
 SELECT n.question, CASE WHEN verified = 0 THEN {quoted(verify.NO_EVIDENCE)} ELSE {quoted(verify.ANSWER)} || s || CASE WHEN others > 0 THEN {quoted(verify.WITH_GAPS)} ELSE '' END END AS answer, verified AS sources FROM n LEFT JOIN s USING (question)""")
def v14_answers(spark, sf_dir):
    """Three snippets a question are kept by rank; all rows are only counted."""
    from pyspark.sql import Window as W

    rows = judged(spark, sf_dir).withColumn("question", F.col("doc_id") % 20)
    counts = rows.groupBy("question").agg(F.count_if(F.col("layer") == "verified").alias("sources"), F.count_if(F.col("layer") != "verified").alias("others"))
    rank = F.row_number().over(W.partitionBy("question").orderBy("doc_id"))
    first = rows.where("layer = 'verified'").select("question", "doc_id", "note").withColumn("rank", rank).where("rank <= 3")
    snippets = first.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", text.snippet(F.col("note")).alias("s")))).alias("s"))
    found = F.coalesce(F.transform("s", lambda x: x["s"]), F.array().cast("array<string>"))
    return counts.join(snippets, "question", "left").select("question", verify.answer(found, F.col("others") > 0, F.lit(False)).alias("answer"), "sources")


@query(f"""WITH {CODES}, n AS (SELECT doc_id % 20 AS question, count(*) FILTER ({LAYER} = 'candidate') AS c, count(*) FILTER ({LAYER} = 'unsupported') AS u, count(*) FILTER ({LAYER} = 'conflicting') AS x FROM codes GROUP BY 1)
 SELECT question, concat_ws('|', CASE WHEN c > 0 THEN 'candidate_evidence_requires_review' END, CASE WHEN u > 0 THEN 'unsupported_claims_excluded' END, CASE WHEN x > 0 THEN 'conflicting_evidence_requires_resolution' END) AS limitations,
 concat_ws('|', CASE WHEN u > 0 THEN 'collect_or_link_missing_sources' END, CASE WHEN x > 0 THEN 'resolve_conflicting_measurements_or_conditions' END, CASE WHEN c > 0 THEN 'review_candidate_reason_codes' END) AS follow_up FROM n""")
def v15_payloads(spark, sf_dir):
    of = lambda name: F.count_if(F.col("layer") == name)
    counts = judged(spark, sf_dir).groupBy((F.col("doc_id") % 20).alias("question")).agg(of("candidate").alias("c"), of("unsupported").alias("u"), of("conflicting").alias("x"))
    columns = [F.col(x) for x in ("c", "u", "x")]
    return counts.select("question", F.array_join(verify.limitations(*columns), "|").alias("limitations"), F.array_join(verify.follow_up(F.lit(False), F.lit(False), *columns), "|").alias("follow_up"))


@query(f"""WITH {CODES} SELECT doc_id, concat_ws('|', CASE WHEN q IN (0, 1) AND (contains(codes, 'unit_mismatch') OR contains(codes, 'unsupported_claim')) THEN 'missing_numeric_constraint:high' END, CASE WHEN contains(codes, 'geo_mismatch') THEN 'missing_geo:medium' END,
 CASE WHEN contains(codes, 'outside_time_range') THEN 'missing_time:medium' END, CASE WHEN contains(codes, 'inaccessible_source') THEN 'candidate_review:medium' END, CASE WHEN contains(codes, 'unresolved_alias') THEN 'candidate_review:medium' END, CASE WHEN doc_id % 5 = 0 THEN 'conflict_review:high' END) AS gaps FROM codes""")
def v16_gaps(spark, sf_dir):
    found = verify.gaps(F.lit(1), F.col("note"), asks(), F.lit(0), F.col("doc_id") % 5 == 0)
    return notes(spark, sf_dir).select("doc_id", F.array_join(F.transform(found, lambda g: F.concat_ws(":", g["gap_type"], g["priority"])), "|").alias("gaps"))


@query(f"""WITH {CODES} SELECT doc_id, round(CAST(CASE q WHEN 0 THEN 0.45 * CAST(regexp_matches(note, {PATTERN}) AS INTEGER) + 0.25 * CAST(contains(lower(note), 'россия') AS INTEGER) WHEN 1 THEN 0.45 * CAST(regexp_matches(note, {PATTERN}) AS INTEGER)
 + 0.15 * CAST(len(list_filter(years, lambda y: y >= 2000)) > 0 AS INTEGER) ELSE 0.25 * CAST(contains(lower(note), 'norilsk') OR contains(lower(note), 'норильский регион') AS INTEGER) + 0.15 * CAST(contains(lower(note), 'sl') AS INTEGER) END AS DOUBLE), 6) AS score FROM codes JOIN (SELECT doc_id, years FROM x) USING (doc_id)""")
def x33_constraint_scores(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.round(verify.constraint_score(F.col("note"), asks()), 6).alias("score"))


@query(f"""WITH {CODES} SELECT doc_id, concat_ws(',', CASE WHEN q IN (0, 1) AND NOT regexp_matches(note, '[0-9]') THEN 'unit_mismatch' END, CASE WHEN q = 0 AND NOT contains(low, 'россия') OR q = 2 AND NOT (contains(low, 'norilsk') OR contains(low, 'норильский регион')) THEN 'geo_mismatch' END,
 CASE WHEN q = 1 AND len(years) = 0 THEN 'outside_time_range' END) AS codes FROM x""")
def f21_local_codes(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.array_join(verify.local_codes(F.col("note"), asks()), ",").alias("codes"))


@query(f"""WITH t AS (SELECT doc_id, doc_id % 3 AS q, {TOKENS_SQL.replace("coalesce(text, '')", 'note')} AS tokens, note, low FROM (SELECT doc_id, {NOTE} AS note, lower({NOTE}) AS low FROM documents))
 SELECT doc_id, least(1.0, round(len(list_intersect(tokens, ['the', 'flotation', 'slag', 'journal'])) / 4.0 + CASE WHEN q = 0 AND (contains(low, 'россия') OR regexp_matches(note, '[0-9]')) OR q = 1 AND regexp_matches(note, '[0-9]') OR q = 2 AND (contains(low, 'norilsk') OR contains(low, 'норильский регион')) THEN 0.25 ELSE 0 END, 6)) AS score FROM t""")
def t05_evidence_scores(spark, sf_dir):
    share = text.token_share(F.col("note"), ["the", "flotation", "slag", "journal"])
    return notes(spark, sf_dir).select("doc_id", verify.evidence_score(share, F.col("note"), asks()).alias("score"))


@query("""SELECT doc_id, CASE WHEN k THEN 'confirmed' ELSE 'candidate' END AS status, CAST(CASE WHEN k THEN c ELSE least(c, 0.68) END AS DOUBLE) AS confidence, CASE WHEN k THEN '' ELSE coalesce(nullif(concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'Odd' END, CASE WHEN doc_id % 3 = 0 THEN 'missing_source_span' END, CASE WHEN c < 0.72 THEN 'low_confidence' END), ''), 'schema_candidate') END AS codes
 FROM (SELECT doc_id, CAST((doc_id % 100) / 100.0 AS DOUBLE) AS c, doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND (doc_id % 100) / 100.0 >= 0.72 AS k FROM documents)""")
def f31_normalised_artifacts(spark, sf_dir):
    d = F.col("doc_id")
    spans = F.when(d % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("s"), F.lit("x")))
    codes = F.when(d % 7 == 0, F.array(F.lit("Odd"), F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    own = verify.normalised(F.when(d % 5 == 0, "candidate").otherwise("confirmed"), (d % 100) / 100.0, spans, F.array(F.lit("s")), codes)
    return read(spark, sf_dir, "documents").select("doc_id", own.alias("a")).select("doc_id", "a.status", "a.confidence", F.array_join("a.reason_codes", ",").alias("codes"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-10 00:00:00', 3000) ORDER BY ts DESC, event_id DESC LIMIT 25)
 SELECT event_id, user_id, (SELECT count(*) FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-10 00:00:00', 3000)) > 25 AS more FROM p""")
def t08_page_before(spark, sf_dir):
    import datetime

    after = (datetime.datetime(2024, 1, 10), 3000)
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return retrieval.page_after(events, "ts", "event_id", after, 25).select("event_id", "user_id", "more")


@query("SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'view') > 30 AS more FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 30")
def t09_feed_after(spark, sf_dir):
    events = read(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "user_id", "ts")
    return retrieval.page_after(events, "ts", "event_id", None, 30, newest_first=False).select("event_id", "user_id", "more")
