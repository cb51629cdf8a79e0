"""Queries over the test tables: documents are spans, line items are claims on parts by suppliers, events are audit rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import access, evidence, ids
from corvane.functions.text import token_share
from corvane.operators import graph, measures, ranking, retrieval, storage, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ["the", "and", "tion", "license", "der"]
TERM_SQL = "['the','and','tion','license','der']"
LEVELS = "CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END"
TOKENS_SQL = "list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_%/.-]+'), lambda t: trim(t, '.,;:()[]{}')), lambda t: length(t) >= 2))"
OVERLAP_SQL = f"len(list_intersect({TOKENS_SQL}, {TERM_SQL})) / 5.0"


def query(sql: str | None):
    """Registers a query and its SQL twin; one that SQL can't express has none, and tests hold it against brute force."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visible(spark: SparkSession, sf_dir: str, roles: list[str]) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("level", F.expr(LEVELS))
    allowed = F.when(F.col("level") == "restricted", F.array(F.lit("auditor"))).otherwise(F.array().cast("array<string>"))
    return docs.where(access.may_see(F.col("level"), allowed, roles))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    return item.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim"), F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("supplier"), "l_shipdate")


@query("SELECT doc_id, substr(sha1(concat_ws(':', doc_id, 1, 0, n_chars, '')), 1, 16) AS span_id FROM documents")
def ids_spans(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ids.span_id(F.col("doc_id"), F.lit(1), F.lit(0), F.col("n_chars")).alias("span_id"))


@query("SELECT p_partkey, substr(sha1('Material:' || lower(trim(p_name))), 1, 16) AS entity_id FROM part")
def ids_entities(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ids.entity_id(F.lit("Material"), F.col("p_name")).alias("entity_id"))


@query("SELECT doc_id, regexp_replace(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id FROM documents")
def ids_points(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ids.point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query(f"SELECT level, count(*) AS n FROM (SELECT {LEVELS} AS level FROM documents) WHERE level IN ('public', 'internal') GROUP BY level")
def f01_access(spark, sf_dir):
    return visible(spark, sf_dir, ["researcher"]).groupBy("level").agg(F.count("*").alias("n"))


def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' tokens, sorted, written at a session's first use."""
    path = storage.kept(spark, f"tokens {sf_dir}", lambda path: retrieval.token_index(read(spark, sf_dir, "documents"), "doc_id", "text", path))
    return spark.read.schema("token string, doc_id long").parquet(path)


@query(f"SELECT doc_id, round({OVERLAP_SQL}, 6) AS score FROM documents WHERE {OVERLAP_SQL} > 0 ORDER BY score DESC, doc_id LIMIT 50")
def t02_lexical(spark, sf_dir):
    return retrieval.lexical_from_index(token_index(spark, sf_dir), "doc_id", TERMS, 50)


QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
COSINE_SQL = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}::DOUBLE[])"


@query(f"SELECT vec_id, round({COSINE_SQL}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50")
def t01_dense(spark, sf_dir):
    return ranking.dense(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 50)


def cells(spark: SparkSession, sf_dir: str) -> str:
    """The vectors' index, written at a session's first use."""
    return storage.kept(spark, f"cells {sf_dir}", lambda path: vectors.stored(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", path))


@query(None)
def t01_cells(spark, sf_dir):
    """The search of t01_dense, from the index: the cells in which 0.98 of the neighbours of its sample lay."""
    path = cells(spark, sf_dir)
    return vectors.nearest(spark, path, "vec_id", QUERY_VECTOR, 50, vectors.probes_for(spark, path, 0.98))


@query(None)
def t01_cells_of_each(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 50, against all vectors, from the index."""
    path = cells(spark, sf_dir)
    asked = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return vectors.nearest_of_each(spark, path, "vec_id", asked, "embedding", 10, vectors.probes_for(spark, path, 0.95))


ROW_TEXT = "p_brand || '. name: ' || p_name || '; type: ' || p_type"
ROW_TERMS = ["red", "small", "ring", "large"]


@query(f"""WITH v AS (SELECT doc_id FROM documents WHERE doc_id % 3 < 2),
 lex AS (SELECT 'd' || doc_id AS id, round({OVERLAP_SQL}, 6) AS score, 0 AS o, [] AS ids FROM documents WHERE doc_id % 3 < 2 AND {OVERLAP_SQL} > 0 ORDER BY score DESC, id LIMIT 60),
 den AS (SELECT 'd' || vec_id AS id, round({COSINE_SQL}, 6) AS score, 1 AS o, ['e' || label] AS ids FROM embeddings WHERE vec_id IN (SELECT doc_id FROM v) ORDER BY score DESC, id LIMIT 60),
 tab AS (SELECT 't' || p_partkey AS id, round(len(list_intersect({TOKENS_SQL.replace("coalesce(text, '')", ROW_TEXT)}, {ROW_TERMS})) / 4.0, 6) AS score, 2 AS o, [] AS ids FROM part WHERE score > 0 ORDER BY score DESC, id LIMIT 60),
 gra AS (SELECT 'd' || doc_id AS id, 1.0 AS score, 3 AS o, ['c' || doc_id] AS ids FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM v) ORDER BY score DESC, id LIMIT 60),
 r AS (SELECT id, o, ids, row_number() OVER (PARTITION BY o ORDER BY score DESC, id) AS rank FROM (SELECT * FROM lex UNION ALL SELECT * FROM den UNION ALL SELECT * FROM tab UNION ALL SELECT * FROM gra))
 SELECT id, round(sum(1 / (60 + rank)), 9) AS rrf, count(*) AS channels, array_to_string(flatten(list(ids ORDER BY o)), '|') AS ids FROM r GROUP BY id ORDER BY rrf DESC, id LIMIT 20""")
def w01_hybrid(spark, sf_dir):
    """Four channels, each under access before it is ranked: words, vectors, table rows and the graph's claims."""
    docs = visible(spark, sf_dir, ["researcher"])
    ident = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    points = read(spark, sf_dir, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").withColumn("id", ident("d", "vec_id"))
    dense = ranking.dense(points, "id", "embedding", QUERY_VECTOR, 60).join(points.select("id", F.array(ident("e", "label")).alias("claim_ids")), "id")
    rows = read(spark, sf_dir, "part").select(ident("t", "p_partkey").alias("id"), F.concat("p_brand", F.lit(". name: "), "p_name", F.lit("; type: "), "p_type").alias("row"))
    claims = read(spark, sf_dir, "labels").where("quality = 1").join(docs.select("doc_id"), "doc_id", "left_semi").select(ident("d", "doc_id").alias("id"), F.lit(1.0).alias("score"), F.array(ident("c", "doc_id")).alias("claim_ids"))
    channels = {
        "lexical": retrieval.lexical_from_index(token_index(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("id", ident("d", "doc_id")), "id", TERMS, 60),
        "dense": dense,
        "table": ranking.lexical(rows, "id", "row", ROW_TERMS, 60),
        "graph": ranking.top(claims, "score", "id", 60),
    }
    return retrieval.fused(channels, "id", 20).select("id", "rrf", "channels", F.array_join("claim_ids", "|").alias("ids"))


@query(f"""WITH s AS (SELECT doc_id, round(least(1.0, 0.45 * ({OVERLAP_SQL}) + 0.35 * (CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) + 0.2 * ((doc_id % 7) / 7.0)), 6) AS score FROM documents)
 SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 25""")
def t03_rerank(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")  # every document is scored: one pass over the texts is less than an index of them
    scored = docs.select("doc_id", token_share(F.col("text"), TERMS).alias("overlap"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("constraint"), (F.col("doc_id") % 7 / 7.0).alias("base"))
    return ranking.reranked(scored, "doc_id", 25)


@query("SELECT coalesce(l_returnflag, 'default') AS dimension, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def a01_measures(spark, sf_dir):
    return measures.by_dimension(claims(spark, sf_dir), F.col("unit"), "value")


@query("SELECT round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS mean_a, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS mean_b, round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS delta FROM lineitem")
def a02_compare(spark, sf_dir):
    return measures.compared(claims(spark, sf_dir), "unit", "value", "A", "R")


@query("SELECT count(*) AS claims, count(*) FILTER (l_linestatus = 'F') AS verified, count(*) FILTER (l_linestatus = 'O') AS candidates, count(DISTINCT l_partkey) AS entities FROM lineitem")
def a03_graph_stats(spark, sf_dir):
    return claims(spark, sf_dir).agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "F").alias("verified"), F.count_if(F.col("status") == "O").alias("candidates"), F.countDistinct("entity").alias("entities"))


@query("SELECT s_suppkey AS process, count(DISTINCT l_partkey) AS entities, count(DISTINCT l_orderkey) AS documents FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def a04_directions(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    kinds = lambda c, name: items.select("l_suppkey", c).distinct().groupBy("l_suppkey").agg(F.count(c).alias(name))
    joined = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")).join(kinds("l_partkey", "entities"), "l_suppkey", "left").join(kinds("l_orderkey", "documents"), "l_suppkey", "left")
    return joined.select(F.col("l_suppkey").alias("process"), F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("documents", F.lit(0)).alias("documents"))


@query("""SELECT l_partkey AS entity, l_returnflag AS unit, count(*) AS claims, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE l_returnflag <> '' GROUP BY 1, 2 HAVING min(l_quantity) < max(l_quantity)""")
def j11_contradictions(spark, sf_dir):
    return graph.contradictions(claims(spark, sf_dir))


@query("""WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS claim, l_partkey AS entity, l_returnflag AS unit, l_quantity AS value FROM lineitem)
 SELECT * FROM (SELECT claim, entity, unit, count(*) OVER (PARTITION BY entity, unit) - count(*) OVER (PARTITION BY entity, unit, value) AS others FROM c WHERE unit <> '') WHERE others > 0""")
def j09_conflicts(spark, sf_dir):
    return graph.contradicting(claims(spark, sf_dir))


@query("""SELECT p_type, s_nationkey FROM (SELECT DISTINCT p_type FROM part) CROSS JOIN (SELECT DISTINCT s_nationkey FROM supplier)
 WHERE (p_type, s_nationkey) NOT IN (SELECT p_type, s_nationkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R')""")
def j10_missing(spark, sf_dir):
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    found = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("p_type", "s_nationkey").distinct()
    return graph.missing(part.select("p_type").distinct(), supplier.select("s_nationkey").distinct(), found)


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of lines, written at a session's first use."""
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    path = storage.kept(spark, f"adjacency {sf_dir}", lambda path: graph.stored_adjacency(edges, path))
    return spark.read.schema("src string, dst string").parquet(path)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), b AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e),
 h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'p1'), h2 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM h1))
 SELECT node, min(hop) AS hop FROM (SELECT 'p1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node""")
def j03_neighbours(spark, sf_dir):
    return graph.neighbours(adjacency(spark, sf_dir), spark.createDataFrame([("p1",)], "node string"), 2)


@query("SELECT p_partkey, p_brand || '. size: ' || p_size || '; type: ' || p_type AS row_text FROM part")
def pr02_table_rows(spark, sf_dir):
    cells = F.array_join(F.array(F.concat(F.lit("size: "), F.col("p_size").cast("string")), F.concat(F.lit("type: "), "p_type")), "; ")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(". "), cells).alias("row_text"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value BETWEEN 10 AND 60 GROUP BY 1")
def f25_audit_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").where(F.col("value").between(10, 60)).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w05_latest(spark, sf_dir):
    last = F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("last")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "last.*")


@query("SELECT event_id, user_id, ts FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def t08_keyset(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_id > 100").orderBy("event_id").limit(50).select("event_id", "user_id", "ts")


@query("SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE i = round_even((n - 1) * 0.95, 0)")
def a17_percentile(spark, sf_dir):
    return measures.nearest_rank(read(spark, sf_dir, "events"), "value", 0.95)


@query("SELECT * FROM (SELECT unnest([10.0, 50.0, 100.0, 'inf'::DOUBLE]) AS le) b, LATERAL (SELECT count(*) AS n FROM events WHERE value <= b.le) c")
def a22_histogram(spark, sf_dir):
    return measures.histogram(read(spark, sf_dir, "events"), "value", [10.0, 50.0, 100.0])


@query("SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def a16_mean_metrics(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j27_unlabelled(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations")
def t12_chat(spark, sf_dir):
    """Messages in order, a row each: a long conversation is sorted, never gathered."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", place.cast("long").alias("place"))


@query("SELECT n_name AS geography, count(*) AS claims, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(n_name), 'a') GROUP BY 1")
def j06_geography(spark, sf_dir):
    joined = claims(spark, sf_dir).join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("supplier")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return joined.where(F.lower("n_name").contains("a")).groupBy(F.col("n_name").alias("geography")).agg(F.count("*").alias("claims"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity * (1 - l_discount) <= 30 AND l_quantity >= 20 AND l_returnflag = 'A' GROUP BY 1")
def f07_interval(spark, sf_dir):
    low = F.col("l_quantity") * (1 - F.col("l_discount"))
    rows = read(spark, sf_dir, "lineitem").where(evidence.overlaps(low, F.col("l_quantity"), 20, 30) & (F.col("l_returnflag") == "A"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1")
def f10_relative_years(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(evidence.within_years(F.col("o_orderdate"), 2, 1998)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') ORDER BY p_name, p_partkey LIMIT 50")
def f17_entity_search(spark, sf_dir):
    found = read(spark, sf_dir, "part").where(evidence.named_like(F.col("p_name"), "1"))
    return found.orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("SELECT CASE WHEN l_linestatus = 'F' AND 1 - l_discount < 0.95 THEN 'candidate' WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'disputed' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def f23_demotion(spark, sf_dir):
    status = F.when(F.col("status") == "F", "confirmed").otherwise("disputed")
    return claims(spark, sf_dir).groupBy(evidence.demoted(status, F.col("confidence"), 0.95).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)
 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)""")
def f28_induced_links(spark, sf_dir):
    parts = read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("node"))
    suppliers = read(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("node"))
    links = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.induced(links, parts, suppliers).select(F.col("src").alias("l_partkey"), F.col("dst").alias("l_suppkey"))


@query("SELECT doc_id, substr(text, 6, 25) AS highlight FROM documents")
def pr03_highlight(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", evidence.highlighted(F.col("text"), F.lit(10), F.lit(15), F.lit(40)).alias("highlight"))


@query("""SELECT CASE WHEN l_linestatus = 'F' THEN CASE WHEN 1 - l_discount >= 0.9 THEN 'verified' ELSE 'auto_verified' END ELSE 'conflicting' END AS status, count(*) AS n
 FROM lineitem GROUP BY 1""")
def pr15_claim_status(spark, sf_dir):
    status = F.when(F.col("status") == "F", "confirmed").otherwise("disputed")
    return claims(spark, sf_dir).groupBy(evidence.claim_status(status, F.col("confidence")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, role, CAST(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
 - length(coalesce(text, '')) - 2 AS BIGINT) AS start_offset, length(coalesce(text, '')) AS size FROM conversations""")
def sc12_offsets(spark, sf_dir):
    start = evidence.running_start(F.col("text"), "conv_id", "turn", "role", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", start.alias("start_offset"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


@query("SELECT p_partkey, concat_ws(' | ', p_name, p_brand, p_type) AS row_text FROM part")
def sc13_row_spans(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array("p_name", "p_brand", "p_type"), " | ").alias("row_text"))
