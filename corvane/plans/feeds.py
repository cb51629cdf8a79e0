"""Queries of files, exports and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import extract
from corvane.operators import storage
from corvane.plans.extraction import NOTE
from corvane.plans.queries import query, read
from corvane.sinks import exports
from corvane.sources import files
from corvane.streaming import feeds


def as_files(df: DataFrame, name, content) -> DataFrame:
    return df.select(name.alias("path"), content.cast("binary").alias("content"), F.length(content.cast("binary")).cast("long").alias("length"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return as_files(docs, F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.coalesce("text", F.lit("")))


STRIPPED = r"regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')"


@query(f"""SELECT '/in/' || doc_id || '.txt' AS path, substr(sha256(sha256(coalesce(text, ''))), 1, 32) AS document_id, 1 AS page, 0 AS start_offset, length({STRIPPED}) AS end_offset FROM documents WHERE length({STRIPPED}) > 0""")
def sc01_sc06_texts(spark, sf_dir):
    docs = files.documents(files.normalised(texts(spark, sf_dir)))
    return docs.select("path", "document_id", F.inline("spans")).select("path", "document_id", "page", "start_offset", "end_offset")


@query("""SELECT p_partkey, 2 AS spans, 'name | size' AS header, p_name || ' | ' || p_size AS row, length('name | size') + 2 AS start_offset FROM part""")
def sc07_sc11_csv(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    content = F.concat(F.lit('name, size \n"'), "p_name", F.lit('" , '), F.col("p_size").cast("string"), F.lit("\n , \n"))
    content = F.replace(content, F.lit('" ,'), F.lit('",'))
    docs = files.documents(files.normalised(as_files(part, F.concat(F.col("p_partkey").cast("string"), F.lit(".csv")), content)))
    key = F.substring_index("path", ".", 1).cast("long").alias("p_partkey")
    return docs.select(key, F.size("spans").alias("spans"), F.array_join(F.col("tables")[0]["headers"], " | ").alias("header"), F.array_join(F.col("tables")[0]["rows"][0], " | ").alias("row"), F.col("spans")[1]["start_offset"].alias("start_offset"))


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'given' ELSE 'many' END AS title, CASE doc_id % 3 WHEN 0 THEN 'json' ELSE 'normalized' END AS parser, CASE doc_id % 3 WHEN 0 THEN {STRIPPED} ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 4 <> 3
 UNION ALL SELECT doc_id, 'empty_document:' || doc_id || '.json', 'warning', NULL FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 3 = 0 AND {STRIPPED} = '' UNION ALL SELECT doc_id, 'invalid_json:' || doc_id || '.json', 'warning', NULL FROM documents WHERE doc_id % 4 = 3""")
def sc08_json(spark, sf_dir):
    """Whole texts as JSON of each shape; some files are cut off."""
    d, text = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    said = lambda title: F.struct(d.alias("id"), F.lit(title).alias("title"), F.array(F.struct(text.alias("text"), F.lit(3).alias("start_offset"))).alias("source_spans"))
    one = F.to_json(F.struct(F.concat(F.lit("T"), d).alias("title"), text.alias("content")))
    given, many = F.to_json(said("given")), F.to_json(F.struct(F.array(said("many")).alias("normalized_documents")))
    content = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, given).otherwise(many)
    content = F.when(F.col("doc_id") % 4 == 3, F.substring(content, 1, F.length(content) - 1)).otherwise(content)
    normal = files.normalised(as_files(read(spark, sf_dir, "documents"), F.concat(d, F.lit(".json")), content))
    key = F.substring_index("path", ".", 1).cast("long").alias("doc_id")
    own = F.when(F.col("parser") == "json", F.col("content")).otherwise(F.col("spans")[0]["text"])
    good = files.documents(normal).select(key, "title", "parser", own.alias("text"))
    return good.unionByName(files.warnings(normal).select(key, F.col("warning").alias("title"), F.lit("warning").alias("parser"), F.lit(None).cast("string").alias("text")))


@query("SELECT min('/in/' || doc_id || '.txt') AS path, sha256(coalesce(text, '')) AS sha256 FROM documents GROUP BY 2")
def sc14_stored_once(spark, sf_dir):
    return files.stored_once(texts(spark, sf_dir)).select("path", "sha256")


@query("""WITH d AS (SELECT doc_id, doc_id // 10 AS request, strlen(coalesce(text, '')) AS n, sha256(coalesce(text, '')) AS sha FROM documents), t AS (SELECT request, sum(n) AS total, min(n) AS least FROM d GROUP BY request)
 SELECT request, 'uploads/' || request || '/' || substr(sha, 1, 32) || '-' || doc_id || '.txt' AS object_key, n AS length, 'stored' AS outcome FROM d JOIN t USING (request) WHERE least > 0 AND total <= 20000
 UNION ALL SELECT request, NULL, total::BIGINT, CASE WHEN least = 0 THEN 'empty_file' ELSE 'upload_too_large' END FROM t WHERE least = 0 OR total > 20000""")
def sc14_stored_requests(spark, sf_dir):
    """Ten documents a request, those beyond 20,000 bytes refused whole; what is stored is read back and checked."""
    requests = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("request"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    folder = storage.new_path(spark, "objects")
    refused = files.stored(requests, folder, 20_000)
    found = files.read_back(spark, folder).select("request", "object_key", "length", F.when(F.col("intact"), "stored").otherwise("damaged").alias("outcome"))
    return found.unionByName(refused.select("request", F.lit(None).cast("string").alias("object_key"), F.col("total").alias("length"), F.col("reason").alias("outcome")))


@query("SELECT '/in/' || doc_id || '.txt' AS path, doc_id % 3 <> 0 AS intact FROM documents")
def sc15_intact(spark, sf_dir):
    own = texts(spark, sf_dir)
    damaged = F.when(F.regexp_extract("path", "([0-9]+)", 1).cast("int") % 3 == 0, F.lit("other").cast("binary")).otherwise(F.col("content"))
    return files.intact(own.withColumn("content", damaged), files.with_checksums(own).select("path", "sha256", "length"))


@query("""WITH RECURSIVE f AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, row_number() OVER (ORDER BY '/in/' || doc_id || '.txt') AS i FROM documents),
 b AS (SELECT i, doc_id, n AS size, 0 AS batch FROM f WHERE i = 1 UNION ALL SELECT f.i, f.doc_id, CASE WHEN b.size + f.n > 20000 THEN f.n ELSE b.size + f.n END, CASE WHEN b.size + f.n > 20000 THEN b.batch + 1 ELSE b.batch END FROM b JOIN f ON f.i = b.i + 1)
 SELECT '/in/' || doc_id || '.txt' AS path, CAST(batch AS BIGINT) AS batch FROM b""")
def sc22_batches(spark, sf_dir):
    return files.batches(texts(spark, sf_dir).select("path", "length"), 20000).select("path", "batch")


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN p_size % 5 = 0 THEN 'path' END, CASE WHEN p_size % 3 = 0 THEN 'kind' END, 'sha256', CASE WHEN p_size % 7 = 0 THEN 'aliases' END], lambda x: x IS NOT NULL)) AS problem FROM part""")
def f27_dictionary_entries(spark, sf_dir):
    size = F.col("p_size")
    entries = read(spark, sf_dir, "part").select("p_partkey", F.when(size % 5 == 0, " ").otherwise("p").alias("path"), F.when(size % 3 == 0, "odd").otherwise("units").alias("kind"), F.lit("ABC").alias("sha256"), F.col("p_name").alias("canonical"), F.when(size % 7 == 0, F.array(F.lit("a"), F.lit(""))).alias("aliases"))
    return files.invalid_entries(entries, "p_partkey")


@query("""SELECT doc_id, '# Title ' || doc_id || chr(10) || chr(10) || coalesce(text || chr(10) || chr(10), '') || '## Sources' || chr(10) || chr(10) || '- s1' || chr(10) || '- s' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## Gaps' || chr(10) || chr(10) || '- none yet' ELSE '' END || chr(10) AS text FROM documents""")
def sk01_markdown(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    none = F.array().cast("array<string>")
    gaps = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("none yet"))).otherwise(none)
    text = exports.markdown(F.concat(F.lit("Title "), d), F.col("text"), F.array(F.lit("s1"), F.concat(F.lit("s"), d)), gaps, none)
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("""SELECT doc_id, 'ex:answer:' || doc_id AS id, '"a" ' || text AS text, 'ex:source-span:s' || doc_id AS span, CAST(doc_id % 5 AS INTEGER) AS page, 2 AS keys FROM documents""")
def sk02_jsonld(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    item = F.struct(F.concat(F.lit("s"), d).alias("id"), d.alias("document_id"), (F.col("doc_id") % 5).cast("int").alias("page"), F.lit(0).alias("start_offset"), F.lit(9).alias("end_offset"), F.lit("text").alias("source_type"), words("c").alias("claim_ids"), words("e").alias("entity_ids"), F.lit(0.5).alias("score"), F.lit("semantic").alias("method"), F.lit("t").alias("text"))
    body = exports.jsonld(d, F.lit("2024-01-01T00:00:00Z"), F.concat(F.lit('"a" '), "text"), F.lit(0.5), F.lit("q?"), F.lit("compare"), words("e"), words(), words(), F.array(item), "https://example.org/ontology#").alias("j")
    rows = read(spark, sf_dir, "documents").select("doc_id", body).withColumn("v", F.parse_json("j"))
    get = lambda path, kind="string": F.variant_get("v", path, kind)
    return rows.select("doc_id", get("$['@id']").alias("id"), get("$['schema:text']").alias("text"), get("$['ex:evidence'][0]['@id']").alias("span"), get("$['ex:evidence'][0]['ex:page']", "int").alias("page"), F.size(F.json_object_keys(F.get_json_object("j", "$['@context']"))).alias("keys"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ',' || event_type || ',' || user_id || ',"a ""b"", c",' || event_id || ',"{""k"":""' || (event_id % 7) || '"",""z"":""1""}"' AS line FROM events""")
def sk03_sk04_audit_csv(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    details = F.create_map(F.lit("z"), F.lit("1"), F.lit("k"), (F.col("event_id") % 7).cast("string"))
    rows = exports.audit_rows(events.select(F.col("ts").alias("created_at"), F.col("event_type").alias("action"), "user_id", F.lit('a "b", c').alias("resource_type"), F.col("event_id").alias("resource_id"), details.alias("details")))
    return exports.csv_lines(rows).select(F.split("line", ",").alias("p"), "line").select(F.regexp_extract("line", ',"a ""b"", c",([0-9]+),', 1).cast("long").alias("event_id"), "line")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def st3_once(spark, sf_dir):
    events = feeds.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.finished(feeds.once(events, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "once")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'event' ELSE 'match' END AS kind FROM events WHERE event_id % 3 < 2 AND event_id % 10 <> 9")
def st1_dispatch(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "event").when(F.col("event_id") % 3 == 1, "match").otherwise("odd")
    good = F.to_json(F.struct(kind.alias("kind"), "user_id", F.col("event_id").cast("string").alias("reference_id"), F.col("ts").cast("timestamp").alias("created")))
    lines = feeds.table_stream(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 9, "{broken").otherwise(good).alias("value"))
    both = feeds.decoded(lines)
    rows = feeds.dispatched(both, "event").unionByName(feeds.dispatched(both, "match"))
    return feeds.finished(rows.select(F.col("reference_id").cast("long").alias("event_id"), "kind"), "dispatch")


@query(f"""SELECT doc_id AS id, round(0.9 * (0.45 + 0.12) * 0.95, 6)::DOUBLE AS score FROM documents WHERE doc_id % 2 = 0 AND contains(lower({NOTE}), 'flotation')""")
def st2_news(spark, sf_dir):
    interests = spark.createDataFrame([("u", "flotation", 0.9, ["Flotation"])], "user_id string, label string, weight double, source_terms array<string>")
    docs = feeds.table_stream(spark, sf_dir, "documents")
    artifacts = docs.select(F.col("doc_id").alias("id"), F.lit("claim").alias("kind"), F.expr(NOTE).alias("value"), F.when(F.col("doc_id") % 2 == 0, "confirmed").otherwise("candidate").alias("status"), F.lit(0.95).alias("confidence"), F.array().cast("array<string>").alias("reason_codes"), F.lit("{}").alias("metadata"))
    return feeds.finished(feeds.news(artifacts, interests).select("id", "score"), "news")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT user_id, event_id, us AS start, 1 AS n, i FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.us >= r.start + 86400000000 THEN e.us ELSE r.start END, CASE WHEN e.us >= r.start + 86400000000 THEN 1 ELSE r.n + 1 END, e.i FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
 SELECT user_id, event_id, n <= 2 AS allowed, CAST(greatest(0, 2 - n) AS INTEGER) AS remaining FROM r""")
def st6_rate_limit(spark, sf_dir):
    events = feeds.table_stream(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return feeds.finished(feeds.limited(events, ["user_id"], "ts", "event_id", 2, 86400), "limits")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY")
def st8_live(spark, sf_dir):
    import datetime

    return feeds.live(read(spark, sf_dir, "events"), "ts", datetime.datetime(2024, 1, 20), 5 * 86400).select("event_id")


@query("SELECT conv_id, turn, CAST(ceil(length(text) / 48.0) AS BIGINT) AS n, substr(text, 49, 48) AS second, CAST(48 * ceil(length(text) / 48.0) - 48 AS INTEGER) AS last_at FROM conversations WHERE length(text) > 96")
def st7_x39_messages(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where(F.length("text") > 96).withColumn("m", extract.messages(F.col("text")))
    return rows.select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.col("m")[1]["piece"].alias("second"), F.element_at("m", -1)["at"].alias("last_at"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), starts AS (SELECT user_id, min(ts) AS start FROM e GROUP BY 1
 UNION ALL SELECT s.user_id, (SELECT min(ts) FROM e WHERE e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 6 HOUR) FROM starts s WHERE s.start IS NOT NULL),
 entries AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next FROM starts WHERE start IS NOT NULL),
 firsts AS (SELECT user_id, ts AS start, min(event_id) AS event_id FROM e GROUP BY ALL)
 SELECT e.user_id, e.event_id, e.ts AS ts, CASE WHEN f.event_id IS NOT NULL AND n.start IS NOT NULL THEN 'miss' ELSE 'hit' END AS outcome FROM e LEFT JOIN firsts f ON f.user_id = e.user_id AND f.start = e.ts AND f.event_id = e.event_id LEFT JOIN entries n ON n.user_id = e.user_id AND n.start = e.ts
 UNION ALL SELECT user_id, NULL, start + INTERVAL 6 HOUR, 'expired' FROM entries WHERE next IS NOT NULL OR start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""")
def m19_st8_cache(spark, sf_dir):
    """A user's entry is written at the first event and lives for six hours: what each event finds, and when entries end."""
    requests = feeds.table_stream(spark, sf_dir, "events").select("event_id", "user_id", "ts").where("user_id is not null and ts is not null")
    found = feeds.finished(feeds.cached(requests, ["user_id"], "ts", "event_id", 6 * 3600, "1 hour"), "cache")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
